import math
import random
from collections import Counter

import pytest

from skein.operators import postings, ranking

UNITS = "source_id long, unit_idx int, tokens array<string>"


def tables(spark, n=400):
    """Units with skewed words, equal ones, one without tokens, one of null; queries with repeated, unknown and no words."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    units = [(i // 7, i % 7, [words[int(60 * draw.random() ** 3)] for _ in range(draw.randrange(1, 12))]) for i in range(n)]
    units += [(1000 + i, 0, ["w0", "w1", "w0"]) for i in range(30)] + [(2000, 0, []), (2001, 0, None), (2002, 1, ["w1", None])]
    asked = [(q, " ".join(draw.choice([*words, "none"]) for _ in range(draw.randrange(1, 6)))) for q in range(25)] + [(90, "w0 w0 w1"), (91, ""), (92, None), (93, "absent")]
    return units, asked, spark.createDataFrame(units, UNITS).repartition(5), spark.createDataFrame(asked, "query_id long, q string")


def brute(units, asked):
    n, avg = len(units), max(1.0, sum(len(t) for *_, t in units if t is not None) / sum(t is not None for *_, t in units))
    df = Counter(w for *_, t in units for w in {*(t or [])} if w)
    out = {}
    for q, text in asked:
        for s, u, t in units:
            score = 0.0
            for w, qtf in Counter((text or "").split()).items():
                if tf := (t or []).count(w):
                    score += qtf * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if score:
                out[q, s, u] = score
    return out


@pytest.fixture(params=["one pass", "many passes"])
def sizes(request, monkeypatch):
    if request.param == "many passes":
        monkeypatch.setattr(postings, "PAIRS", 20)
        monkeypatch.setattr(postings, "BLOCK", 2)


def test_scores_are_those_of_all_pairs(spark, sizes):
    units, asked, a, b = tables(spark)
    rows = ranking.bm25_score(a, b).collect()
    got = {(r.query_id, r.source_id, r.unit_idx): r.bm25 for r in rows}
    assert len(rows) == len(got) and got == pytest.approx(brute(units, asked))


def test_scores_are_not_shuffled(spark):
    _, _, a, b = tables(spark)
    got = ranking.bm25_score(a, b)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["query_id", "source_id", "unit_idx", "bm25"]


def test_no_query_gives_no_score(spark):
    _, _, a, b = tables(spark)
    assert ranking.bm25_score(a, b.where("query_id in (91, 92)")).count() == 0
    assert ranking.bm25_score(a.limit(0), b).count() == 0


def test_topk_with_ties(spark, sizes):
    units, asked, a, b = tables(spark)
    by_query = {}
    for (q, s, u), score in brute(units, asked).items():
        by_query.setdefault(q, []).append((-round(score, 9), s, u))
    got = {}
    for r in ranking.bm25_topk(a, b, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.source_id, r.unit_idx))
    assert got == {q: sorted(x)[:4] for q, x in by_query.items()}


def test_topk_shuffles_the_best_of_each_task(spark):
    _, _, a, b = tables(spark)
    best = ranking.bm25_topk(a, b, 2)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    passed = postings.scores(a, ranking.query_terms(b), lambda idf, tf, length, avgdl: idf * tf, 2)
    assert passed.count() <= 2 * b.count() * spark.sparkContext.defaultParallelism < ranking.bm25_score(a, b).count()
