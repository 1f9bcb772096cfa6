import pytest

from pairloom.llm import line_dedup as L


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [r.n_dropped for r in L.deduplicate(df, find=L.relative_lines).orderBy("doc_id").collect()]


def name(k):
    return "".join(chr(97 + int(d)) for d in str(k))


@pytest.mark.parametrize("n", [40, 400, 4000])
def test_fields_stay_variable_on_larger_data(spark, n):
    texts = [f"please read our terms signed by author {name(i % 40)} from office {name(i // 40 % 40 if n > 40 else i)} every time you use this service" for i in range(n)]
    assert sum(dropped(spark, texts)) == n


def test_lines_that_share_too_little_stay(spark):
    texts = [" ".join(f"{name(i)}{c}" if k < 4 else c for k, c in enumerate("abcdefghij")) for i in range(20)]
    assert sum(dropped(spark, texts)) == 0


@pytest.mark.parametrize("line", ["Page 3 of 12", "(c) 2024 Acme", "2024-05-01 10:00:00 17 ok", "+1 555 123 4567", "$12.99"])
def test_repeats_with_digits_go(spark, line):
    assert sum(dropped(spark, [line] * 20)) == 20


def test_digits_vary_but_numbers_alone_do_not(spark):
    assert sum(dropped(spark, [f"Page {i} of {i + 5}" for i in range(20)])) == 20
    assert sum(dropped(spark, [f"{i} {i * 7}" for i in range(20)])) == 0


@pytest.mark.parametrize("line", ["Posted by {} on the company board", "{} posted on the company board"])
def test_fields_among_the_leading_tokens(spark, line):
    assert sum(dropped(spark, [line.format(name(i)) for i in range(20)])) == 20
