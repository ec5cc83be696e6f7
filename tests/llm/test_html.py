"""HTML extraction: blocks, held-out accuracy, odd pages."""

import pytest

from linkforge.llm import html_blocks, html_text


@pytest.fixture(scope="module")
def field():
    return html_text.model()


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<div>x < y & z</div>", ["x < y & z"]),
        ("<p>a&nbsp;&amp;\n b<br>c</p><!-- <p>no --><script>'<p>no</p>'</script>", ["a & b c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>one <b>two</b>three</p> tail", ["one twothree", "tail"]),
        ("<p>cut off &am", ["cut off &am"]),
        ("<textarea>x</textarea><select><option>y</select><p>z", ["z"]),
        ("</div></p><p>a</section>b", ["a", "b"]),
        ("<p title='a > b'>x</p><p", ["x"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in html_blocks.blocks(page)] == texts


def test_reader_is_linear():
    for page in ("<p" * 100_000, "<" * 200_000, '<a href="' * 20_000, "<div>" * 50_000, "&amp" * 100_000, "<b>x" * 50_000):
        html_blocks.blocks(page)


def test_held_out_pages(field):
    hit = wrong = missed = 0
    for i in range(150):
        _, own, labels = html_text.labelled_page(50_000_000 + i)
        for a, b in zip(field.decode(own), labels, strict=True):
            hit, wrong, missed = hit + (a & b), wrong + (a > b), missed + (b > a)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_article_without_surroundings(field):
    page = """<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
    <article><h1>Title here</h1><p>First paragraph of the story, long enough to be read.</p><div class=ad>Buy now!</div><p>Second one.</p></article>
    <section class="comments"><h3>Comments</h3><p>I do not agree with this story at all, says a reader.</p></section><form><p>Subscribe</p><input></form>
    <aside class="sidebar"><p>Other stories you may like today.</p></aside><footer>&copy; 2024 Site</footer></body></html>"""
    assert html_text.extract(page, field) == "Title here\nFirst paragraph of the story, long enough to be read.\nSecond one."


def test_depth_changes_nothing(field):
    body = "<article><h1>Title here</h1><p>First paragraph of the story, long enough to be read.</p></article><select><option>Choose a country now</option></select><button>Press here</button>"
    texts = {html_text.extract("<div>" * n + body + "</div>" * n, field) for n in (10, 600, 2000)}
    assert texts == {"Title here\nFirst paragraph of the story, long enough to be read."}


def test_two_written_pages(field):
    plain = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><div id="menu"><a href="/">Start</a> <a href="/b">Other</a></div>
    <div class="content"><h1>Bread at home</h1><p>Flour &amp; water are <em>all</em> that it takes.</p><p>Wait
    a day&hellip;</p></div><div class="comments"><p>I tried this last week and it failed.</p></div><div id="footer">Copyright 2020 Baker</div></body>"""
    assert html_text.extract(plain, field) == "Bread at home\nFlour & water are all that it takes.\nWait a day…"
    main = """<body><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><main><article><h1>Rivers</h1><p>They run to the sea, slowly.</p><aside class=ad><p>Buy shoes now!</p></aside>
    <ul><li>One river is long.</li><li>One is short.</li></ul></article></main><footer><p>All rights reserved.</p></footer></body>"""
    assert html_text.extract(main, field) == "Rivers\nThey run to the sea, slowly.\nOne river is long.\nOne is short."


def test_pages_table(spark, sf, field):
    rows = html_text.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)


def test_odd_pages(spark, field):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, None, "t", 1), (None, "u", "", "t", 1), (2, "u", "<p>" + "long words here. " * 50_000, "t", 1), (2, "u", "<p>x", "t", 1), (2, "u", "<p>x", "t", 1)]
    out = html_text.extract_pages(spark.createDataFrame(rows, schema), field).collect()
    assert len(out) == 5 and out[0]["text"] == "" and {r["n_chars"] for r in out} >= {0}
    assert html_text.extract_pages(spark.createDataFrame([], schema), field).count() == 0
