"""Crawl rules over recorded data: robots, schedules, redirects, and which pages are worth fetching again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.url import origin, part
from skein.sources import documents as D

ROBOTS = "struct<rules:array<struct<allow:boolean,pattern:string>>,crawl_delay:double,sitemaps:array<string>>"
# Statuses worth another try; marks of pages that scripts build; types that are text.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
SCRIPTED = ("__next_data__", 'id="root"', 'id="app"', "ng-app", "data-reactroot")
TEXTUAL = r"^\s*(?:text/|application/(?:xhtml\+xml|xml|rss\+xml|atom\+xml|json|ld\+json))"


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, rules, crawl_delay, sitemaps) from robots files (origin, body)."""

    @F.pandas_udf(ROBOTS)  # type: ignore[call-overload]
    def parse(body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([D.robots(b or "", agent) for b in body], columns=["rules", "crawl_delay", "sitemaps"])

    return files.select("origin", parse("body").alias("r")).select("origin", "r.*")


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: ``*`` is any run, a final ``$`` the end, all else literal."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substr(pattern, F.lit(1), F.char_length(pattern) - 1)).otherwise(pattern)
    literal = F.regexp_replace(body, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(""))


def robots_allowed(urls: DataFrame, rules: DataFrame, with_query: bool = False) -> DataFrame:
    """``urls`` (url and anything else) with ``allowed``: the longest matching pattern decides, Allow on ties, yes by default.

    Joined on the origin first; patterns see the path, and the query only if asked for.
    """
    query = part(F.col("url"), 5)
    path = F.concat(F.coalesce(F.nullif(part(F.col("url"), 4), F.lit("")), F.lit("/")), F.when(F.lit(with_query) & (query != ""), F.concat(F.lit("?"), query)).otherwise(""))
    joined = urls.withColumn("origin", origin(F.col("url"))).withColumn("_path", path).join(rules.select("origin", "rules"), "origin", "left")
    hits = F.filter("rules", lambda r: F.regexp_like(F.col("_path"), pattern_regex(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.octet_length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_path", "rules", "origin")


def crawl_schedule(urls: DataFrame, rules: DataFrame | None = None, per_host_delay: float = 0.25, most_delay: float = 30.0) -> DataFrame:
    """``urls`` (url) with ``host`` and ``start_offset_s``: each host's requests in order of url, one delay apart.

    The delay is the larger of the given one and the site's own, which counts up to ``most_delay``.
    """
    host = F.lower(part(F.col("url"), 2))
    own = urls.withColumn("host", host)
    delay = F.lit(per_host_delay)
    if rules is not None:
        asked = rules.select(F.col("origin").alias("_origin"), F.col("crawl_delay").alias("_delay"))
        own = own.join(asked, origin(F.col("url")) == F.col("_origin"), "left").drop("_origin")
        delay = F.greatest(delay, F.least(F.coalesce("_delay", F.lit(0.0)), F.lit(most_delay)))
    w = Window.partitionBy("host").orderBy("url")
    return own.withColumn("start_offset_s", (F.row_number().over(w) - 1) * delay).drop("_delay")


def retryable(status: Column) -> Column:
    """whether a status is worth another try; null (no answer) is."""
    return F.coalesce(status.isin(*RETRYABLE), F.lit(True))


def retry_delay(attempt: Column, retry_after: Column, base: float = 0.4, most: float = 60.0) -> Column:
    """seconds before try ``attempt`` (from 0): the server's wish if it is short enough, null if too long, else doubling."""
    return F.when(retry_after > most, F.lit(None)).when(retry_after.isNotNull(), retry_after).otherwise(base * F.pow(F.lit(2.0), attempt))


def fetchable(content_type: Column, body: Column, most_bytes: int = 8 << 20) -> Column:
    """whether a page is of a textual type (or of none stated) and within the size limit."""
    return (content_type.isNull() | F.lower(content_type).rlike(TEXTUAL)) & (F.coalesce(F.octet_length(body), F.lit(0)) <= most_bytes)


def html_redirects(pages: DataFrame, body: str = "body", base: str = "final_url") -> DataFrame:
    """``pages`` with ``redirect``: where a stub page sends its reader, or null. Large pages never reach Python."""

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def find(body: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([D.html_redirect(b, u or "") for b, u in zip(body, base)], dtype=object)

    small = F.when((F.octet_length(body) <= 4096) & F.lower(F.col(body)).rlike("http-equiv|location"), F.col(body))
    return pages.withColumn("redirect", find(small, F.col(base)))


def follow_redirects(hops: DataFrame, most: int = 5) -> DataFrame:
    """(url, final_url, hops) over recorded hops (url, target): up to ``most`` steps; a chain that is longer or loops has a null final_url."""
    step = hops.where("target is not null").select(F.col("url").alias("_from"), F.col("target").alias("_to")).groupBy("_from").agg(F.min("_to").alias("_to"))
    out = hops.select("url", F.col("url").alias("at"), F.lit(0).alias("hops")).distinct()
    for _ in range(most):
        out = out.join(step, out["at"] == step["_from"], "left").select("url", F.coalesce("_to", "at").alias("at"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    open_ = out.join(step, out["at"] == step["_from"], "left")
    return open_.select("url", F.when(F.col("_to").isNull(), F.col("at")).alias("final_url"), "hops")


def needs_javascript(body: Column, text: Column) -> Column:
    """F8: whether a page looks like a shell for scripts, from its body and its extracted text."""
    size, chars = F.octet_length(body), F.char_length(F.coalesce(text, F.lit("")))
    marked = F.lit(False)
    for mark in SCRIPTED:
        marked = marked | F.contains(F.lower(body), F.lit(mark))
    return F.coalesce((size >= 512) & (chars <= 2000) & ((chars < 120) | (chars * 200 < size) | marked), F.lit(False))


def decoded(pages: DataFrame, raw: str = "raw", content_type: str = "content_type", url: str = "url") -> DataFrame:
    """``pages`` with ``body``: the bytes of ``raw`` as text."""

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(raw: pd.Series, kind: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else D.decode(bytes(r), k, u) for r, k, u in zip(raw, kind, url)], dtype=object)

    return pages.withColumn("body", run(raw, content_type, url))

