"""Lexical ranking, fusion and unit scores.

Rows are identified by (source_id, unit_idx) and query_id; order is always an explicit column.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scoring
from skein.functions.text import tokenize
from skein.functions.url import canonical_url, slug_words
from skein.operators import postings

K1, B = 1.2, 0.75
#: Rank damping of reciprocal rank fusion.
RRF_K = 60


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a query's distinct terms and how often it repeats them."""
    return queries.select("query_id", F.explode(tokenize(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_stats(units: DataFrame) -> DataFrame:
    """One row (n, avgdl) over ``units`` with a ``tokens`` array; avgdl is at least 1."""
    return units.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0))).alias("avgdl"))


def _weight(idf: Column, tf: Column, length: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def bm25_score(units: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, source_id, unit_idx, bm25) of every unit that shares a term with the query.

    Statistics are over all of ``units`` (source_id, unit_idx, tokens; each unit once). A unit's scores are made
    where its tokens are: only term frequencies are summed over the table.
    """
    return postings.scores(units, query_terms(queries), partial(_weight, k1=k1, b=b))


def bm25_topk(units: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best units of every query with their ``rank`` from 0; ties by source and unit."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "source_id", "unit_idx")
    best = postings.scores(units, query_terms(queries), partial(_weight, k1=K1, b=B), max(1, k))
    return best.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def rrf_fuse(hits: DataFrame, limit: int | None = 10, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, per query.

    ``hits``: query_id, provider, provider_pos, rank (from 0), title, url, snippet. Hits merge by
    canonical URL; those without one are dropped but keep their rank. Result: query_id, key, url and
    title (first met), snippet (longest by bytes, then first), providers (in order), score, best_rank, position.
    """
    arrival = F.struct("provider_pos", "rank")
    keyed = hits.withColumn("key", canonical_url(F.col("url"))).where("key is not null").withColumn("arrival", arrival)
    size = F.octet_length(F.coalesce("snippet", F.lit("")))
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col("arrival"))
    fused = keyed.groupBy("query_id", "key").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.min("rank").alias("best_rank"),
        F.min("arrival").alias("arrival"),
        F.min_by("url", "arrival").alias("url"),
        F.coalesce(F.min_by("title", titled), F.lit("")).alias("title"),
        F.max_by(F.coalesce("snippet", F.lit("")), F.struct(size, -F.col("provider_pos"), -F.col("rank"))).alias("snippet"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("provider_pos", "rank", "provider"))), lambda p: p["provider"])).alias("providers"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "arrival", "key")
    ranked = fused.withColumn("position", F.row_number().over(order) - 1)
    ranked = ranked if limit is None else ranked.where(F.col("position") < limit)
    return ranked.select("query_id", "key", "url", "title", "snippet", "providers", "score", "best_rank", "position")


def rank_hits(hits: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Each query's hits by BM25 of title, snippet and the URL's words, best first, only above zero.

    The collection is the query's own hits. An empty query keeps the first hits in order.
    """
    w = Window.partitionBy("query_id")
    text = F.concat_ws(" ", "title", "snippet", slug_words(F.col("url")))
    own = hits.select("query_id", "hit_id", "provider_pos", "rank", "title", "snippet", "url").withColumn("tokens", tokenize(text)).withColumn("seq", F.struct("provider_pos", "rank", "hit_id"))
    own = own.withColumn("n", F.count("*").over(w)).withColumn("avgdl", F.greatest(F.lit(1.0), F.avg(F.size("tokens")).over(w)))
    cells = own.join(query_terms(queries), "query_id").withColumn("tf", F.size(F.filter("tokens", lambda t: t == F.col("term"))))
    cells = cells.withColumn("df", F.count_if(F.col("tf") > 0).over(Window.partitionBy("query_id", "term")))
    part = F.col("qtf") * _weight(scoring.bm25_idf(F.col("n"), F.col("df")), F.col("tf"), F.size("tokens"), F.col("avgdl"), K1, B)
    scores = cells.groupBy("query_id", "hit_id").agg(F.sum(part).alias("score"))
    empty = queries.where(F.size(tokenize(F.col("q"))) == 0).select("query_id", F.lit(True).alias("empty"))
    joined = own.join(scores, ["query_id", "hit_id"], "left").join(empty, "query_id", "left")
    kept = joined.where(F.coalesce("empty", F.lit(False)) | (F.col("score") > 0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "seq")
    return kept.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < limit).select("query_id", "hit_id", "score", "position")


def candidates(units: DataFrame) -> DataFrame:
    """Units worth considering: with markdown, and a heading, code or at least 24 characters."""
    return units.where(F.col("kind").isin("heading", "code") | (F.char_length("text") >= 24)).where(F.coalesce("markdown", F.lit("")) != "")


def score_units(units: DataFrame, queries: DataFrame, semantic_weight: float = 0.5, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """Relevance, density and base score of each query's candidate units.

    ``units``: query_id, source_id, unit_idx, kind, text, markdown and anything else, which is kept.
    BM25 statistics are over the query's candidates. With ``vectors`` (source_id, unit_idx, embedding)
    and ``query_vectors`` (query_id, embedding) relevance is blended with the cosine. Where no query
    term matches, relevance has no weight and density takes it over.
    """
    if not 0 <= semantic_weight <= 1:
        raise ValueError("semantic_weight must lie in [0, 1]")
    if (vectors is None) != (query_vectors is None):
        raise ValueError("give both vectors and query_vectors, or neither")
    w = Window.partitionBy("query_id")
    sized = units.withColumn("source_units", F.count("*").over(Window.partitionBy("query_id", "source_id")))
    own = candidates(sized).withColumn("terms", tokenize(F.col("text")))
    own = own.withColumn("units_considered", F.count("*").over(w)).withColumn("avgdl", F.greatest(F.lit(1.0), F.avg(F.size("terms")).over(w)))
    cells = own.select("query_id", "source_id", "unit_idx", "terms", F.col("units_considered").alias("n"), "avgdl").join(query_terms(queries), "query_id")
    cells = cells.withColumn("tf", F.size(F.filter("terms", lambda t: t == F.col("term"))))
    cells = cells.withColumn("df", F.count_if(F.col("tf") > 0).over(Window.partitionBy("query_id", "term")))
    part = F.col("qtf") * _weight(scoring.bm25_idf(F.col("n"), F.col("df")), F.col("tf"), F.size("terms"), F.col("avgdl"), K1, B)
    scores = cells.groupBy("query_id", "source_id", "unit_idx").agg(F.sum(part).alias("raw"))
    joined = own.join(scores, ["query_id", "source_id", "unit_idx"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    joined = joined.withColumn("top", F.max("raw").over(w))
    lexical = F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.lit(0.0))
    relevance = lexical
    if vectors is not None:
        joined = joined.join(vectors.select("source_id", "unit_idx", F.col("embedding").alias("_v")), ["source_id", "unit_idx"], "left")
        joined = joined.join(query_vectors.select("query_id", F.col("embedding").alias("_q")), "query_id", "left")
        close = F.greatest(F.lit(0.0), scoring.cosine(F.col("_v"), F.col("_q")))
        relevance = F.when(F.col("_v").isNull() | F.col("_q").isNull(), lexical).otherwise((1 - semantic_weight) * lexical + semantic_weight * close)
    joined = joined.withColumn("relevance", relevance).withColumn("d", scoring.density(F.col("text"), F.col("terms")))
    place = 1 - 0.7 * F.col("unit_idx") / F.greatest(F.lit(1), F.col("source_units"))
    matched = F.col("top") > 0
    base = F.when(matched, 0.60 * F.col("relevance") + 0.25 * F.col("d.score")).otherwise(0.85 * F.col("d.score")) + 0.15 * place
    out = joined.withColumn("base", base * scoring.prior(F.col("kind"))).withColumn("density", F.col("d.score")).withColumn("boilerplate", F.col("d.boilerplate_hits"))
    return out.drop("d", "raw", "top", "avgdl", "source_units", "_v", "_q")
