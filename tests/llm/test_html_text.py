import pytest

from pairloom.llm.html_text import extract, main_text

LONG = "A paragraph that is long enough to surge over the threshold of the window, with many more words than a menu has."
CASES = [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words without any markup are short", ""),
    ("<html><body><nav>Home</nav><article><h1>T</h1><p>a &amp; b<p>c<br>d</article><footer>f</footer>", "T\n\na & b\n\nc d"),
    ("<article><p>x</p><aside><p>side</p></aside><div class='ad'>buy</div><p>y &lt;z&gt;</p><script>var a='</p>'</script></article>", "x\n\ny <z>"),
    ("<main><p>one</p><form><p>name</p><input></form><p>two</p><section class='comments'><article><p>no</p></article></section></main>", "one\n\ntwo"),
    (f"<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div id=content><h2>Head</h2><p>{LONG}</p><p>Short.</p></div><div class=cookie-notice><p>{LONG}</p></div></body>", f"Head\n\n{LONG}\n\nShort."),
    ("<nav><div>left open<article><p>kept</p></article>", "kept"),
    ("<article><p>a<p class=notice>careful<p>b</p><p class='promo'>buy</p>c</article>", "a\n\nb\n\nc"),
    ("<article>&nbsp;a\n\t b&#39;s<!-- <p>no</p> --> 1 < 2</article>", "a b's 1 < 2"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_frame(spark):
    rows = [(i, None if i == 2 else f"u{i}", page, "x") for i, (page, _) in enumerate(CASES)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(i, t, len(t)) for i, (_, t) in enumerate(CASES)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
