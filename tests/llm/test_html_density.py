import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import html_text
from pairloom.llm.html_text import main_text

LONG = "A paragraph that is long enough to surge over the threshold of the window, with many more words than a menu has."
CASES = [
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><article><p>A card</p></article>", f"{LONG}\n\n{LONG}\n\nA card"),
    ("<body><div><p>A short article.</p><p>Two lines.</p></div></body>", "A short article.\n\nTwo lines."),
    (f"<body><p>{LONG}</p><p><a href=1>A whole line of link</a></p><p>{LONG}</p></body>", f"{LONG}\n\nA whole line of link\n\n{LONG}"),
    (f"<body><p>Short.</p><p><a href=1>link</a></p><p>{LONG}</p></body>", f"Short.\n\nlink\n\n{LONG}"),
    (f"<body><p>{LONG}</p><div class=ad>buy</div><p>{LONG}</p><ul><li><a href=1>Home</a></ul></body>", f"{LONG}\n\n{LONG}"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_density_decides(page, text):
    assert main_text(page) == text


def test_fixture_does_not_need_article_tags(spark):
    """Without article and main tags, surge and dive find the same text on every page of the table."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    texts = [main_text(r.html) for r in rows]
    assert [main_text(re.sub(r"</?(article|main)\b[^>]*>", "", r.html or "")) for r in rows] == texts and sum(map(bool, texts)) > 200


def plain_windows(weights, least):
    """Surge and dive in the words of the method, line by line."""
    kept, i, n = set(), 0, len(weights)
    window = lambda j: sum(weights[j : j + html_text.WINDOW])
    while i < n:
        if not (weights[i] and window(i) >= least):
            i += 1
            continue
        begin = end = i
        while end < n and window(end) > 0:
            end += 1
        back, seen = i, 0
        while back > 0 and back - 1 not in kept and seen < html_text.WINDOW:
            back, seen = back - 1, seen + 1
            if weights[back]:
                begin, seen = back, 0
        kept |= set(range(begin, end))
        i = end + 1
    return [j in kept for j in range(n)]


@given(st.lists(st.sampled_from([0, 0, 0, 5, 30, 79, 80, 200]), max_size=40), st.sampled_from([1, 30, 80, 160]))
@settings(max_examples=300, deadline=None)
def test_windows_against_a_plain_version(weights, least):
    assert html_text._between(weights, least) == plain_windows(weights, least)


def test_method_decides(monkeypatch):
    """Without surges nothing is kept, whatever the tags say."""
    page = f"<main><article><p>{LONG}</p></article></main>"
    assert main_text(page) == LONG
    monkeypatch.setattr(html_text, "_between", lambda weights, least: [False] * len(weights))
    assert main_text(page) == ""


@pytest.mark.parametrize("part", ['<a "', "<a ", "<a '\"", "<!", "<!--", "<!-- --", "<script>", "<?", "</script ", "<p class=\"x", "<", "&", "&amp", "<div>", "<a href=1>", "</div>", "< ", "<textarea>x</textare>", "<b title='>", "x "])
def test_malformed_markup_takes_one_pass(part):
    began = time.time()
    main_text(f"<p>{LONG}</p>" + part * (1_500_000 // len(part)))
    main_text(f"<p>{LONG}</p>" + part * (500_000 // len(part)) + f"\"'><p>{LONG}</p>")
    assert time.time() - began < 20
