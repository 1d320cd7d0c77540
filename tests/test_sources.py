import json

import pytest
from pyspark.sql import functions as F

from skein.sources import crawl
from skein.sources import documents as D
from skein.sources.payloads import parse_hits


def payloads(spark, rows):
    return spark.createDataFrame([(1, p, i, b, a) for i, (p, b, a) in enumerate(rows)], "query_id long, provider string, provider_pos int, body string, arg string")


def test_providers(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://r.example/1</link><description>&lt;b&gt;x&lt;/b&gt; & y</description><pubDate>Mon</pubDate></item><item><title>none</title></item></channel></rss>"
    atom = "<feed><entry><title> Paper </title><id>http://arxiv.example/abs/1</id><published>2021-05-01</published><summary>Sum</summary><author><name>Ann</name></author></entry></feed>"
    rows = [
        ("wiki:de", json.dumps({"query": {"search": [{"title": "Foo bar", "snippet": "<b>x</b> &amp; y"}]}}), "de"),
        ("openalex", json.dumps({"results": [{"title": "T", "doi": "https://doi.org/1", "publication_date": "2020-01-01", "authorships": [{"author": {"display_name": "A"}}], "abstract_inverted_index": {"b": [1], "a": [0]}}]}), None),
        ("crossref", json.dumps({"message": {"items": [{"title": ["C"], "URL": "http://c.example", "author": [{"given": "G", "family": "F"}], "issued": {"date-parts": [[1999]]}, "abstract": "<jats:p>abs</jats:p>"}]}}), None),
        ("pubmed", json.dumps({"resultList": {"result": [{"id": "7", "source": "MED", "title": "E", "authorString": "A, B", "firstPublicationDate": "2001-01-01", "abstractText": "t"}]}}), None),
        ("hn", json.dumps({"hits": [{"objectID": "9", "title": "H", "points": 3, "num_comments": 2}]}), None),
        ("stackoverflow", json.dumps({"items": [{"title": "Q &quot;x&quot;", "link": "http://s.example", "answer_count": 1, "accepted_answer_id": 5, "tags": ["a", "b"]}]}), None),
        ("gh", json.dumps({"items": [{"full_name": "o/r", "html_url": "http://g.example", "description": "d", "language": "Go", "stargazers_count": 4}]}), None),
        ("searx", json.dumps({"results": [{"title": "S", "url": "http://x.example", "content": "c"}]}), None),
        ("searxng", '<article class="result"><h3><a href="http://y.example">Y</a></h3><p class="content">told</p></article>', None),
        ("ddg", '<div class="result"><a class="result__a" href="//d/l/?uddg=https%3A%2F%2Fz.example%2F">Z</a><a class="result__snippet">snip</a></div>', None),
        ("rss", rss, None),
        ("arxiv", atom, None),
        ("github", "{broken", None),
        ("ddg", "<p>nothing</p>", None),
        ("martian", "{}", None),
        ("stackexchange", json.dumps({"error_message": "slow down"}), None),
    ]
    hits, failures = parse_hits(payloads(spark, rows))
    got = {(r.provider_pos): (r.title, r.url, r.snippet) for r in hits.collect()}
    assert got == {
        0: ("Foo bar", "https://de.wikipedia.org/wiki/Foo_bar", "x & y"),
        1: ("T", "https://doi.org/1", "A (2020). a b"),
        2: ("C", "http://c.example", "G F (1999). abs"),
        3: ("E", "https://europepmc.org/article/MED/7", "A, B (2001). t"),
        4: ("H", "https://news.ycombinator.com/item?id=9", "3 points, 2 comments"),
        5: ('Q "x"', "http://s.example", "1 answers, accepted. a, b"),
        6: ("o/r", "http://g.example", "d — Go, 4 stars"),
        7: ("S", "http://x.example", "c"),
        8: ("Y", "http://y.example", "told"),
        9: ("Z", "https://z.example/", "snip"),
        10: ("A & B", "http://r.example/1", "x & y"),
        11: ("Paper", "https://arxiv.example/abs/1", "Ann (2021). Sum"),
    }
    assert sorted(r.provider for r in failures.collect()) == ["duckduckgo", "github", "martian", "stackexchange"]


def test_search_is_partial_and_strict(spark):
    from skein.pipeline import ProviderError, search

    good, bad = ("searx", json.dumps({"results": [{"title": "S", "url": "http://x.example", "content": "c"}]}), None), ("gh", "{broken", None)
    results, failures = search(payloads(spark, [good, bad]), strict=True)
    assert (results.count(), failures.count()) == (1, 1)
    with pytest.raises(ProviderError):
        search(payloads(spark, [bad]), strict=True)


def test_headlines_in_columns_as_in_python(spark):
    from skein.functions.text import is_headline
    from skein.html import listing

    texts = ["13 hours ago", "10 years of rust in production", "example.com", "Subscribe", "GPT-6 Astra", "Short", "더보기", "1501 comments", "Elections", "Longer-single-word", "...--- ---...", "x" * 201]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(is_headline(F.col("t"), tuple(listing.CONTROLS), tuple(listing.COUNTED)).alias("x"))
    assert [r.x for r in got.collect()] == [listing.is_headline(t) for t in texts]


def test_feeds_and_sitemaps():
    atom = '<a:feed xmlns:a="x"><a:entry><a:title><![CDATA[T & <i>t</i>]]></a:title><a:link rel="self" href="http://no"/><a:link href="http://yes"/><a:updated>2020</a:updated></a:entry></a:feed>'
    assert D.feed_items(atom) == [{"title": "T & t", "link": "http://yes", "summary": "", "published": "2020"}]
    assert D.sitemap("<sitemapindex><sitemap><loc> http://a/s.xml </loc></sitemap><url><loc>ftp://x</loc></url></sitemapindex>") == {"urls": [], "sitemaps": ["http://a/s.xml"]}
    with pytest.raises(ValueError):
        D.feed_items("no markup")


ROBOTS = "User-agent: *\nDisallow: /private\nCrawl-delay: 5\n\nUser-agent: Skein\nUser-agent: b\nAllow: /private/open  # yes\nDisallow: /private\nDisallow: /*.pdf$\nDisallow:\nSitemap: http://a/m.xml"


def test_robots(spark):
    files = spark.createDataFrame([("http://a.example", ROBOTS), ("http://b.example", "User-agent: *\nDisallow: /x?y=1\nCrawl-delay: -1")], "origin string, body string")
    rules = crawl.robots_rules(files, "skein/1.0")
    urls = ["http://a.example/private/open/1", "http://a.example/private/x", "http://a.example/f.pdf", "http://a.example/f.pdf2", "http://a.example", "http://c.example/private", "http://b.example/x?y=1"]
    got = {r.url: r.allowed for r in crawl.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == dict(zip(urls, [True, False, False, True, True, True, True]))
    strict = crawl.robots_allowed(spark.createDataFrame([(urls[-1],)], "url string"), rules, with_query=True).first()
    assert strict.allowed is False
    assert D.robots(ROBOTS, "other") == {"rules": [{"allow": False, "pattern": "/private"}], "crawl_delay": 5.0, "sitemaps": ["http://a/m.xml"]}


def test_schedule_and_retry(spark):
    urls = spark.createDataFrame([("http://a.example/2",), ("http://a.example/1",), ("http://b.example/1",)], "url string")
    rules = spark.createDataFrame([("http://a.example", 2.0)], "origin string, crawl_delay double")
    got = {r.url[-9:]: r.start_offset_s for r in crawl.crawl_schedule(urls, rules).collect()}
    assert got == {"example/1": 0.0, "example/2": 2.0}
    row = spark.range(1).select(
        crawl.retryable(F.lit(503)).alias("a"), crawl.retryable(F.lit(404)).alias("b"), crawl.retry_delay(F.lit(2), F.lit(None).cast("double")).alias("c"), crawl.retry_delay(F.lit(2), F.lit(61.0)).alias("d")
    ).first()
    assert (row.a, row.b, row.c, row.d) == (True, False, 1.6, None)


@pytest.mark.parametrize(
    "body, target",
    [
        ('<meta http-equiv="refresh" content="0; url=/next">', "http://a.example/next"),
        ('<meta http-equiv="refresh" content="5; url=/next">', None),
        ("<script>location.replace('http://b.example/')</script>", "http://b.example/"),
        ("<script>location.href = target</script>", None),
        ('<meta http-equiv="refresh" content="0; url=http://a.example">', None),
        ("x" * 5000 + "<script>location.replace('/y')</script>", None),
    ],
)
def test_html_redirect(body, target):
    assert D.html_redirect(body, "http://a.example/") == target


def test_redirect_chains(spark):
    hops = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")]
    got = {r.url: r.final_url for r in crawl.follow_redirects(spark.createDataFrame(hops, "url string, target string")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": None, "y": None}


def test_decode():
    assert D.decode("안녕".encode("cp949"), None, "http://x.kr/") == "안녕"
    assert D.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1", None) == "é"
    assert D.decode(b'<meta charset="shift_jis">' + "日本".encode("shift_jis"), None, None).endswith("日本")
    assert D.decode("héé".encode()[:-1], None, None) == "hé"


def test_recorded_pages(spark, tmp_path):
    from skein.sources.recorded import register

    register(spark)
    (tmp_path / "a.jsonl").write_text('{"url": "http://a", "status": 200, "body": "<p>x"}\n\n{"url": "http://b", "content_type": "image/png"}\n')
    got = spark.read.format("recorded_pages").option("path", str(tmp_path)).option("textual", "true").load().collect()
    assert [(r.url, r.final_url, r.rendered) for r in got] == [("http://a", "http://a", False)]


def test_sql_names(spark):
    from skein.api import register

    register(spark)
    row = spark.sql("SELECT count_tokens('abcde 한') AS a, normalize_ws(' a  b ') AS b, strip_markdown('**x**') AS c").first()
    assert (row.a, row.b, row.c) == (3, "a b", "x")
    assert spark.sql("SELECT count(*) AS n FROM extract_units('<h1>T</h1><p>Some words in a paragraph.</p>', 'http://a')").first().n == 2
    assert spark.sql("SELECT link FROM feed_items('<rss><item><link>http://l</link></item></rss>')").first().link == "http://l"


def test_needs_javascript(spark):
    shell = "<div id=\"app\"></div>" + "<!-- -->" * 80
    row = spark.range(1).select(crawl.needs_javascript(F.lit(shell), F.lit("")).alias("a"), crawl.needs_javascript(F.lit("<p>x"), F.lit("x")).alias("b"), crawl.needs_javascript(F.lit(shell), F.lit("x" * 2500)).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, False)
