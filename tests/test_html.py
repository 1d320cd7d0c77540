import pytest

from skein.html.extract import ExtractOptions, extract, extract_one, links_of, units_of
from skein.html.listing import is_headline
from skein.html.tree import Document, repair

PROSE = "Rivers carry sediment, and the sediment settles where the current slows; deltas grow from it over centuries."
PAGE = f"""<html lang="en"><head><title>Deltas - The Atlas</title><meta property="og:site_name" content="The Atlas">
<meta name="author" content="A. Writer"><script>if (1<2) {{ var t="</p>"; }}</script>
<script type="application/ld+json">{{"@graph":[{{"datePublished":"2020-01-02","description":"About deltas"}}]}}</script></head><body>
<nav><a href="/a">First menu entry</a><a href="/b">Second menu entry</a></nav><div class="ad-slot">Buy cheap boats today from us</div>
<main><article><h1>Deltas</h1><p>{PROSE}<p>{PROSE} See <a href="/wiki/nile">the Nile</a> with <b>care</b> and 10<sup>23</sup> grains<sup>[1]</sup>.</p>
<h2>Kinds</h2><ul><li>Arcuate<ul><li>Nile</li></ul></li><li>Cuspate</li></ul><pre class="language-python"><code>print("```")</code></pre>
<blockquote>{PROSE}</blockquote><table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table>
<p>Formula <math><annotation encoding="application/x-tex">x^2</annotation><mi>x2</mi></math> shown here for everyone.</p></article></main>
<aside class="related">More stories that you may want to read soon</aside><footer>Copyright by the publisher of this atlas</footer></body></html>"""


def test_article():
    got = extract_one(PAGE, "https://a.example/x")
    md = got["markdown"]
    assert got["meta"] | {} == {"title": "Deltas", "description": "About deltas", "byline": "A. Writer", "published": "2020-01-02", "language": "en", "canonical": None, "site_name": "The Atlas"}
    assert "[the Nile](https://a.example/wiki/nile)" in md and "**care**" in md and "10^23 grains." in md
    assert "- Arcuate" in md and "  - Nile" in md and "````python\nprint" in md and f"> {PROSE}" in md
    assert "| a | b |\n| --- | --- |\n| 1\\|2 |  |" in md and "$x^2$" in md
    for gone in ("menu entry", "cheap boats", "More stories", "Copyright", "var t"):
        assert gone not in md
    heads = [u["heading_path"] for u in got["units"] if u["text"] == "Cuspate"]
    assert heads == [["Deltas", "Kinds"]]
    assert got["kind"] == "article" and got["stats"]["nodes_dropped"] > 0
    assert [u["position"] for u in got["units"]] == list(range(len(got["units"])))


def test_listing():
    cards = "".join(f'<div class="card"><h3><a href="/story-{i}">Story number {i} about towns</a></h3><p>A standfirst that says more about story {i}.</p></div>' for i in range(6))
    got = extract_one(f"<html><body><nav><a href='/story-0'>Story number 0 about towns</a></nav><main><h2>News</h2>{cards}</main></body></html>", "https://a.example/")
    assert got["kind"] == "index"
    assert [x["url"] for x in got["links"]] == [f"https://a.example/story-{i}" for i in range(1, 6)]  # the first was met in the menu
    assert got["links"][0]["heading_path"] == ["News"] and "standfirst" in got["links"][0]["snippet"]
    assert got["units"][0]["markdown"] == "## News"
    assert extract_one(PAGE, None, ExtractOptions(index_mode="never"))["links"] == []


@pytest.mark.parametrize("text, yes", [("13 hours ago", False), ("10 years of rust in production", True), ("example.com", False), ("Subscribe", False), ("GPT-6 Astra", True), ("Short", False), ("더보기", False)])
def test_headlines(text, yes):
    assert is_headline(text) is yes


@pytest.mark.parametrize("source", ["", "<", "<p", "plain", "</div></p>", "<table><tr><td>" * 50, "<b>" * 3000 + "x", "&#xfffffff;", "<p>a<table>b", "<a href='http://[bad'>x</a>" * 8])
def test_broken_markup_is_borne(source):
    assert isinstance(extract_one(source, None)["units"], list)


def test_repair():
    assert repair("<script>a<b</script><p>1 <3 <?php x ?>") == "<script></script><p>1 &lt;3 "
    assert repair('<script type="application/json">{"a":"<b>"}</script>') == '<script type="application/json">{"a":"&lt;b>"}</script>'


def test_unclosed_inline_does_not_swallow():
    doc = Document("<div><p>one <b>bold<br><p>two</div><footer>f</footer>")
    assert [x.name for x in doc.root.children] == ["div", "footer"]
    assert [x.inner_text() for x in doc.root.children[0].children] == ["one bold", "two"]


def test_same_under_any_partitioning(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("Deltas", f"Deltas {i}")) for i in range(12)] + [(100, None, None), (101, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, final_url string, body string")
    one, four = (extract(pages.repartition(n)).orderBy("page_id").collect() for n in (1, 4))
    assert one == four
    got = extract(pages)
    assert {r.page_id: r.error.message for r in got.where("error is not null").collect()} == {100: "no content extracted", 101: "no content extracted"}
    assert units_of(got).where("source_id = 3 and kind = 'heading'").count() == 2
    assert links_of(got).count() == 0
