"""Rules of extraction, listings as sources, citations, nearest vectors and the one extraction of research."""

import math
import random

from pyspark.sql import functions as F

from skein.html.extract import ExtractOptions, extract, extract_one
from skein.operators import quality
from skein.operators.chunking import chunk
from skein.operators.vectors import cosine_topk
from skein.pipeline import research, search
from skein.sources.documents import decode_entities
from skein.sources.recorded import read_recorded

LONG = "The old mill by the river was built of grey stone, and people there still grind their corn in it every autumn, as they always did. "


def test_furniture_without_body():
    page = f'<html><h1>Mill</h1><p>{LONG * 3}</p><div class="sponsored">Buy a new mill today, cheaper than ever before in this town</div></html>'
    for source in (page, page.replace("<html>", "<html><body>").replace("</html>", "</body></html>")):
        got = extract_one(source, "https://a.example/")["text"]
        assert "grey stone" in got and "Buy a new mill" not in got


def test_paragraphs_forge_no_heading():
    got = extract_one(f"<body><p>## not a heading {LONG}</p><p>{LONG}</p></body>", None)["units"]
    assert got[0]["kind"] == "paragraph" and got[0]["markdown"].startswith("\\## not")
    assert extract_one(f"<body><h2># real</h2><p>{LONG}</p></body>", None)["units"][0]["markdown"].startswith("## ")


def test_size_limit_counts_bytes(spark):
    rows = spark.createDataFrame([(1, "u", "é" * 60), (2, "u", "e" * 60)], "page_id long, final_url string, body string")
    got = {r.page_id: r.error.message for r in extract(rows, ExtractOptions(max_bytes=100)).collect() if r.error}
    assert got[1] == "body too large" and got.get(2) != "body too large"


def test_furniture_in_any_case(spark):
    assert spark.sql("SELECT 'COOKIE and privacy policy, LOG IN' AS t").select(quality.furniture_hits(F.col("t"))).first()[0] == 3


def test_chunks_are_cited(spark):
    rows = [(1, i, "paragraph", LONG, LONG, ["A"], 30, "https://a.example/", "Mill") for i in range(3)]
    units = spark.createDataFrame(rows, "source_id long, unit_idx int, kind string, text string, markdown string, heading_path array<string>, tokens int, url string, title string")
    assert {(r.url, r.title) for r in chunk(units, 64, 0).collect()} == {("https://a.example/", "Mill")}
    assert {(r.url, r.title) for r in chunk(units.drop("url", "title"), 64, 0).collect()} == {(None, None)}


def test_listings_answer_the_question(spark):
    item = "<item><title>{0}</title><link>https://a.example/{1}</link></item>"
    feed = "<rss>" + "".join(item.format(t, i) for i, t in enumerate(["cats", "about rivers", "dogs", "rivers and rivers"])) + "</rss>"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://m.example/{i}.xml</loc></sitemap>" for i in range(4)) + "</sitemapindex>"
    rows = [(1, "rss", 0, feed, None), (2, "rss", 0, feed, None), (1, "sitemap", 1, index, None)]
    answers = spark.createDataFrame(rows, "query_id long, provider string, provider_pos int, body string, arg string")
    files = spark.createDataFrame([(f"https://m.example/{i}.xml", f"<urlset><url><loc>https://b.example/{w}</loc></url></urlset>") for i, w in enumerate(["river-rivers", "cats", "rivers", "rivers-four"])], "url string, body string")
    queries = spark.createDataFrame([(1, "rivers"), (2, "?!")], "query_id long, q string")
    results, failures = search(answers, queries=queries, files=files)
    got: dict[int, list] = {}
    for r in results.orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.url)
    assert set(got[1]) == {"https://a.example/3", "https://a.example/1", "https://b.example/river-rivers", "https://b.example/rivers"}
    assert got[2] == [f"https://a.example/{i}" for i in range(4)] and failures.count() == 0
    first = search(answers, files=files)[0].where("query_id = 1").count()
    assert first == 7  # unranked: every entry of the feed, and three of the four children


def test_nearest_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)] + [(100, [0.0] * 6), (101, None), (102, [1.0]), (103, [])]
    rows += [(200, rows[0][1]), (201, [2 * x for x in rows[0][1]])]  # ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id < 9 or vec_id = 100").select(F.col("vec_id").alias("query_id"), "embedding")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    got: dict[int, list] = {}
    for r in cosine_topk(vectors.repartition(3), asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(round(r.cosine, 9))
    want = {q: sorted((round(cosine(a, b), 9) for v, b in rows if v != q), reverse=True)[:4] for q, a in rows if q < 9 or q == 100}
    assert {q: [x + 0.0 for x in v] for q, v in got.items()} == {q: [x + 0.0 for x in v] for q, v in want.items()}
    assert cosine_topk(vectors, asked.limit(0)).count() == 0 and cosine_topk(vectors.limit(0), asked).count() == 0


def test_pages_are_extracted_once(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x", "https://a.example/x", f"<body><h1>Mill</h1><p>{LONG * 2}</p></body>")], "page_id long, url string, final_url string, body string")
    hits = spark.createDataFrame([(1, 1, "p", 0, 0, "Mill", "https://a.example/x", "s")], "hit_id long, query_id long, provider string, provider_pos int, rank int, title string, url string, snippet string")
    got = research(spark.createDataFrame([(1, "old mill")], "query_id long, q string"), hits, pages)
    rows = got.contexts.collect()
    assert len(rows) == 1 and "grey stone" in rows[0].markdown
    for frame in (got.contexts, got.failures, got.articles):  # they read what one extraction wrote
        assert "MapInArrow" not in frame._jdf.queryExecution().executedPlan().toString()


def test_recorded_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "https://a.example/", "body": "x", "status": 200}\n\nbroken\n{"url": "https://b.example/", "content_type": "image/png", "rendered": true}\n')
    assert {(r.url, r.final_url, r.rendered) for r in read_recorded(spark, str(tmp_path)).collect()} == {("https://a.example/", "https://a.example/", False), ("https://b.example/", "https://b.example/", True)}
    assert [r.url for r in read_recorded(spark, str(tmp_path), textual=True).collect()] == ["https://a.example/"]


def test_entities():
    assert decode_entities("&lt;&#62;&nix; & &amp;amp;") == "<>&nix; & &amp;"
