import math
from collections import Counter

import pandas as pd
import pytest

from skein.operators import chunking, ranking
from skein.operators.slim import SlimConfig, estimate, slim


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_against_brute_force(spark):
    docs = ["red fox red", "blue fox", "green tree and a fox", "한국어 검색"]
    units = frame(spark, [(i, 0, t.split()) for i, t in enumerate(docs)], "source_id long, unit_idx int, tokens array<string>")
    queries = frame(spark, [(1, "red fox fox"), (2, "none")], "query_id long, q string")
    got = {r.source_id: r.bm25 for r in ranking.bm25_score(units, queries).where("query_id = 1").collect()}
    lists = [d.split() for d in docs]
    n, avg = len(lists), sum(map(len, lists)) / len(lists)
    for i, words in enumerate(lists):
        score = 0.0
        for term, q in Counter("red fox fox".split()).items():
            tf, df = words.count(term), sum(term in w for w in lists)
            score += q * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg)) if tf else 0
        assert got.get(i, 0.0) == pytest.approx(score)


def hits(spark, rows):
    return frame(spark, rows, "hit_id long, query_id long, provider string, provider_pos int, rank int, title string, url string, snippet string")


def test_rrf(spark):
    h = hits(
        spark,
        [
            (1, 1, "a", 0, 0, "", "https://x.example/1?utm_source=z", "short"),
            (2, 1, "b", 1, 1, "One", "http://www.x.example/1/", "longer one"),
            (3, 1, "a", 0, 1, "Two", "https://x.example/2", None),
            (4, 1, "a", 0, 2, "no key", "mailto:x", "x"),
        ],
    )
    first, second = ranking.rrf_fuse(h).orderBy("position").collect()
    assert (first.key, first.title, first.snippet, first.providers, first.best_rank) == ("x.example/1", "One", "longer one", ["a", "b"], 0)
    assert first.score == pytest.approx(1 / 60 + 1 / 61)
    assert second.score == pytest.approx(1 / 61)


def test_rank_hits_and_empty_query(spark):
    h = hits(spark, [(1, 1, "a", 0, 0, "apples", "http://a.example/x", ""), (2, 1, "a", 0, 1, "pears", "http://a.example/pears", ""), (3, 2, "a", 0, 0, "x", "http://a.example/y", "")])
    q = frame(spark, [(1, "pears"), (2, "")], "query_id long, q string")
    got = sorted((r.query_id, r.hit_id) for r in ranking.rank_hits(h, q).collect())
    assert got == [(1, 2), (2, 3)]


UNITS = "query_id long, source_id long, unit_idx int, kind string, level int, text string, markdown string, heading_path array<string>, tokens int, title string, url string"


def article(query, source, title, texts):
    rows = [(query, source, 0, "heading", 1, title, f"# {title}", [], estimate(f"# {title}"), title, f"https://e.example/{source}")]
    return rows + [(query, source, i + 1, "paragraph", 0, t, t, [title], estimate(t), title, f"https://e.example/{source}") for i, t in enumerate(texts)]


TEXTS = [
    "Photosynthesis turns light into sugar inside 70 to 100 chloroplasts of every leaf cell.",
    "Chlorophyll absorbs red light at 680 nanometres and reflects green wavelengths instead.",
    "The ferry to the northern island leaves at 8:15 and costs 12 crowns for each passenger.",
    "We use cookies. Read our privacy policy and click here to subscribe to our newsletter.",
]


@pytest.mark.parametrize("budget", [0, 5, 20, 30, 40, 50, 60, 80, 120, 200, 500])
def test_slim_keeps_the_budget(spark, budget):
    rows = article(1, 1, "Leaves", TEXTS) + article(1, 2, "Copy", TEXTS)
    got = slim(frame(spark, rows, UNITS), frame(spark, [(1, "how do leaves absorb light")], "query_id long, q string"), SlimConfig(max_tokens=budget)).first()
    assert estimate(got.markdown) == got.tokens <= budget
    assert "cookies" not in got.markdown
    assert got.markdown.count("Photosynthesis turns") <= 1  # the mirror collapses


def test_slim_cites_and_prefers_relevance(spark):
    rows = article(1, 1, "Leaves", TEXTS[:2]) + article(1, 2, "Boats", TEXTS[2:])
    got = slim(frame(spark, rows, UNITS), frame(spark, [(1, "chlorophyll light")], "query_id long, q string"), SlimConfig(max_tokens=60)).first()
    assert got.markdown.startswith("## Leaves\n<https://e.example/1>")
    assert [s.source_id for s in got.sources] == [1]


def test_slim_without_match_and_options(spark):
    rows = article(1, 1, "Leaves", TEXTS)
    units, queries = frame(spark, rows, UNITS), frame(spark, [(1, "zzz")], "query_id long, q string")
    base = {r.unit_idx: r for r in ranking.score_units(units, queries).collect()}
    row = base[1]
    assert row.relevance == 0
    assert row.base == pytest.approx(0.85 * row.density + 0.15 * (1 - 0.7 * 1 / 5))
    with pytest.raises(ValueError):
        SlimConfig(diversity=1.5)
    with pytest.raises(ValueError):
        ranking.score_units(units, queries, vectors=units)


def test_vectors_lift(spark):
    rows = article(1, 1, "Leaves", TEXTS[:3])
    units, queries = frame(spark, rows, UNITS), frame(spark, [(1, "light")], "query_id long, q string")
    vectors = frame(spark, [(1, 3, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "source_id long, unit_idx int, embedding array<float>")
    asked = frame(spark, [(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    plain = {r.unit_idx: r.relevance for r in ranking.score_units(units, queries).collect()}
    mixed = {r.unit_idx: r.relevance for r in ranking.score_units(units, queries, 0.5, vectors, asked).collect()}
    assert mixed[3] == pytest.approx(0.5 * plain[3] + 0.5) and mixed[1] == pytest.approx(0.5 * plain[1])


def test_chunks(spark):
    assert chunking.runs([10, 10, 10], [False] * 3, 20, 0) == [[0, 1], [2]]
    assert chunking.runs([10, 10, 10], [False] * 3, 20, 10) == [[0, 1], [1, 2]]
    assert chunking.runs([50, 1], [False] * 2, 20, 0) == [[0], [1]]
    assert chunking.runs([5, 5], [False, True], 20, 0) == [[0], [1]]
    assert chunking.runs([], [], 20, 0) == []
    rows = [(1, i, "paragraph", f"t{i}", f"t{i}", ["h"], 10) for i in range(5)] + [(2, 0, "paragraph", "x", "x", [], None)]
    units = frame(spark, rows, "source_id long, unit_idx int, kind string, text string, markdown string, heading_path array<string>, tokens int")
    got = chunking.chunk(units, 30, 10, 5).orderBy("source_id", "chunk_idx").collect()
    assert [r.units for r in got] == [[0, 1, 2], [2, 3, 4], [0]]
    with pytest.raises(ValueError):
        chunking.chunk(units, 10, 10)


def test_cosine_and_quality(spark):
    from pyspark.sql import functions as F

    from skein.operators import quality

    one = spark.range(1).select(quality.shingle_f1(F.lit("a b c d e f"), F.lit("a b c d e x")).alias("q"), quality.furniture_hits(F.lit("Cookie Donate")).alias("h")).first()
    assert (one.q.recall, one.q.precision, one.q.f1, one.h) == (0.5, 0.5, 0.5, 2)
    contexts = spark.createDataFrame(pd.DataFrame({"query_id": [1], "markdown": ["has 42"]}))
    answers = spark.createDataFrame([(1, "42"), (1, "43"), (2, "x")], "query_id long, pattern string")
    assert {r.query_id: r.found for r in quality.answer_presence(contexts, answers).collect()} == {1: 0.5, 2: 0.0}


def test_vectors_beyond_the_first_are_used(spark, monkeypatch):
    from skein.plans import catalog

    tables = {
        "embeddings": spark.range(1200).selectExpr("id AS vec_id", "array(1.0D, 0.5D) AS embedding"),
        "queries": spark.range(1200).selectExpr("id AS query_id", "'q' AS q"),
    }
    units = spark.range(9000).selectExpr("0L AS query_id", "id AS source_id", "0 AS unit_idx")
    given = []
    monkeypatch.setattr(catalog, "table", lambda _, d, name: tables[name])
    monkeypatch.setattr(catalog, "_per_query", lambda *_: units)
    monkeypatch.setattr(catalog.ranking, "score_units", lambda u, q, w, v, a: given.extend((v, a)) or u.selectExpr("*", "0.0D AS relevance"))
    catalog.QUERIES["hybrid_relevance"](spark, "")
    assert given[0].count() == 9000 and given[0].selectExpr("max(vec_id)").first()[0] > 1100
    assert given[1].count() == 1200 and given[1].selectExpr("max(vec_id)").first()[0] == 1199
