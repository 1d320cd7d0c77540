"""From questions to contexts: fused hits, the pages they name, their units, and what fits the budget."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.durable import cut
from skein.functions.url import canonical_url
from skein.html.extract import ExtractOptions, extract, units_of
from skein.operators.ranking import rrf_fuse
from skein.operators.slim import SlimConfig, slim
from skein.sources.payloads import parse_hits, ranked, with_children


class Research(NamedTuple):
    contexts: DataFrame  # query_id, markdown, tokens, units_considered, selected, sources
    results: DataFrame  # fused hits
    articles: DataFrame  # page_id, url, article, error of the pages read
    failures: DataFrame  # query_id, url, message


def search(payloads: DataFrame, max_results: int = 10, strict: bool = False, queries: DataFrame | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, failures): recorded answers of all providers, read and fused per query.

    With ``queries`` (query_id, q) entries of feeds, sitemaps and listings are ranked by the question first; with
    ``files`` (url, body) the sitemaps that an index names are read.

    A provider that failed is a failure row beside the others' hits. ``strict`` raises if every
    provider of some query failed.
    """
    most = max(max_results, 10)
    hits, failures = parse_hits(payloads if files is None else with_children(payloads, files), most if queries is None else None)
    if queries is not None:
        hits = ranked(hits, queries, most).where(F.col("rank") < most)
    if strict and not failures.join(hits.select("query_id").distinct(), "query_id", "left_anti").isEmpty():
        raise ProviderError("every provider failed")
    return rrf_fuse(hits, max_results), failures


class ProviderError(RuntimeError):
    """No provider could answer."""


def page_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id): the pages that an address leads to, by either of a page's URLs; one page per key."""
    both = F.explode(F.array_distinct(F.array(canonical_url(F.col("url")), canonical_url(F.col("final_url")))))
    return pages.select("page_id", both.alias("key")).where("key is not null").groupBy("key").agg(F.min("page_id").alias("page_id"))


def research(queries: DataFrame, hits: DataFrame, pages: DataFrame, cfg: SlimConfig = SlimConfig(), max_results: int = 10, max_sources: int = 5, options: ExtractOptions = ExtractOptions()) -> Research:
    """Answer every query from recorded hits and pages.

    The cut to ``max_sources`` comes before pages are read, and each page is extracted once however many queries it
    answers and however often the result is used: extracted articles are written to the shared folder. A result without a page, and a page without content, are failures of their queries, not
    of the job.
    """
    results = rrf_fuse(hits, max_results)
    reading = results.where(F.col("position") < max_sources)
    found = reading.join(page_keys(pages), "key", "left").select("query_id", "position", F.col("url").alias("hit_url"), "page_id")
    wanted = found.select("page_id").where("page_id is not null").distinct()
    own = pages.select("page_id", "final_url", "body").join(wanted, "page_id", "left_semi").dropDuplicates(["page_id"])
    articles = cut(extract(own, options))
    title = F.coalesce("article.meta.title", F.get(F.filter("article.units", lambda u: u["kind"] == "heading"), F.lit(0))["text"])
    units = units_of(articles.withColumn("title", title), "page_id", "url", "title")
    per_query = found.select("query_id", F.col("page_id").alias("source_id")).where("source_id is not null").distinct().join(units, "source_id")
    contexts = slim(per_query, queries, cfg)
    told = articles.select("page_id", F.col("error.message").alias("message"))
    failures = found.join(told, "page_id", "left").select("query_id", F.col("hit_url").alias("url"), F.when(F.col("page_id").isNull(), F.lit("page not found")).otherwise(F.col("message")).alias("message"))
    return Research(contexts, results, articles, failures.where("message is not null"))
