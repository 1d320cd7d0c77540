"""All queries of the core over the test tables, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import pipeline
from skein.functions import scoring
from skein.functions import text as T
from skein.functions import url as U
from skein.html.extract import extract, links_of, units_of
from skein.html.tree import repair
from skein.operators import chunking, quality, ranking
from skein.operators.slim import slim
from skein.operators.vectors import cosine_topk as nearest
from skein.pipeline import research
from skein.plans import oracles
from skein.sources import crawl, payloads
from skein.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _units(spark: SparkSession, d: str, *columns: Column | str) -> DataFrame:
    return spread(table(spark, d, "units")).select("source_id", "unit_idx", *columns)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "units").select("source_id", "unit_idx", "text").dropDuplicates(["source_id", "unit_idx"])
    return own.select("source_id", "unit_idx", T.tokenize(F.col("text")).alias("tokens"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, F.array_join(T.tokenize(F.col("text")), " ").alias("words"))


@query
def count_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, T.count_tokens(F.col("text")).alias("n_tokens"))


@query
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, F.md5(T.normalize_ws(F.col("text"))).alias("hash"), T.visible_len(F.col("text")).alias("chars"))


@query
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("body"))).alias("hash"))


@query
def defuse_headings(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, F.md5(T.defuse_headings(F.col("markdown"))).alias("hash"))


@query
def escape_inline(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, F.md5(T.escape_inline(F.col("markdown"))).alias("hash"))


@query
def code_fence(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, T.code_fence(F.col("markdown")).alias("fence"))


@query
def slug_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "searchresults").select("hit_id", U.slug_words(F.col("url")).alias("words"))


@query
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "searchresults").select("hit_id", U.canonical_url(F.col("url")).alias("key"))


@query
def valid_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "searchresults").select("hit_id", U.valid_url(F.col("url")).alias("valid"), U.origin(F.col("url")).alias("origin"))


@query
def strip_site_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("source_id", T.strip_site_suffix(F.concat_ws(" | ", "title", "site_name"), F.col("site_name")).alias("head"))


@query
def scholarly_snippet(spark: SparkSession, d: str) -> DataFrame:
    told = T.scholarly_snippet(F.array("byline"), F.col("published"), F.col("description"))
    return table(spark, d, "articles").select("source_id", told.alias("snippet"))


@query
def density(spark: SparkSession, d: str) -> DataFrame:
    got = _units(spark, d, scoring.density(F.col("text")).alias("d"))
    return got.select("source_id", "unit_idx", *(F.floor(F.col(f"d.{c}") * 10000 + 0.001).cast("int").alias(c) for c in ("content_ratio", "numeric_ratio", "type_token_ratio", "score")), "d.boilerplate_hits")


@query
def boilerplate_hits(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, scoring.boilerplate_hits(F.col("text")).alias("hits"))


@query
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    units = _tokens(spark, d)
    n = ranking.bm25_stats(units).select("n").scalar()
    wanted = ranking.query_terms(table(spark, d, "queries")).select("term").distinct()
    df = units.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(scoring.bm25_idf(n, F.col("df")), 6).alias("idf"))


@query
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.bm25_score(_tokens(spark, d), table(spark, d, "queries"))
    # As round(bm25, 6), without a decimal for each of very many rows.
    return got.select("query_id", "source_id", "unit_idx", (F.floor(F.col("bm25") * 1e6 + 0.5) / 1e6).alias("bm25"))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.bm25_topk(_tokens(spark, d), table(spark, d, "queries"), 10)
    return got.select("query_id", "rank", F.round("bm25", 5).alias("bm25"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "searchresults").dropDuplicates(["hit_id"])


@query
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.rrf_fuse(_hits(spark, d), 10)
    return got.select("query_id", "key", "url", "title", "snippet", F.array_join("providers", ",").alias("providers"), F.round("score", 9).alias("score"), "best_rank", "position")


@query
def rank_hits(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.rank_hits(_hits(spark, d), table(spark, d, "queries"), 10)
    return got.select("query_id", "position", F.round("score", 5).alias("score"))


@query
def slim_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ranking.candidates(table(spark, d, "units")).groupBy("source_id").agg(F.count("*").alias("units_considered"))


def _per_query(spark: SparkSession, d: str) -> DataFrame:
    """The stored units of the articles that each query's first results name."""
    reading = ranking.rrf_fuse(_hits(spark, d), 10).where("position < 5").select("query_id", "key")
    heads = table(spark, d, "articles").select("source_id", "url", "title").dropDuplicates(["source_id"]).withColumn("key", U.canonical_url(F.col("url")))
    units = table(spark, d, "units").dropDuplicates(["source_id", "unit_idx"]).withColumn("tokens", T.count_tokens(F.col("markdown")))
    found = reading.join(heads, "key").dropDuplicates(["query_id", "source_id"]).drop("key")
    return found.join(units, "source_id")


@query
def unit_base_score(spark: SparkSession, d: str) -> DataFrame:
    got = ranking.score_units(_per_query(spark, d), table(spark, d, "queries"))
    return got.select("query_id", "source_id", "unit_idx", F.round("relevance", 6).alias("relevance"), F.round("base", 6).alias("base"))


@query
def hybrid_relevance(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    many = max(1, vectors.count())
    units = _per_query(spark, d)
    place = F.pmod(F.xxhash64("source_id", "unit_idx"), F.lit(many)).alias("vec_id")
    with_vectors = units.select("source_id", "unit_idx").distinct().withColumn("vec_id", place).join(vectors, "vec_id")
    asked = table(spark, d, "queries").select("query_id", F.pmod("query_id", F.lit(many)).alias("vec_id")).join(vectors, "vec_id")
    got = ranking.score_units(units, table(spark, d, "queries"), 0.5, with_vectors, asked)
    return got.select("query_id", "source_id", "unit_idx", F.round("relevance", 6).alias("relevance"))


@query
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("tokens").over(Window.partitionBy("source_id").orderBy("unit_idx"))
    pairs = _tokens(spark, d).withColumn("before", before).where("before is not null")
    return pairs.select("source_id", "unit_idx", F.round(scoring.overlap(F.col("before"), F.col("tokens")), 6).alias("overlap"))


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(spread(vectors), asked, 10).select("query_id", "rank", F.round("cosine", 4).alias("cosine"))


@query
def slim_select(spark: SparkSession, d: str) -> DataFrame:
    got = slim(_per_query(spark, d), table(spark, d, "queries"))
    return got.select("query_id", F.posexplode("selected").alias("pos", "s")).select("query_id", "pos", "s.source_id", "s.unit_idx", "s.tokens", F.round("s.score", 6).alias("score"))


@query
def slim_context(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: recorded hits and raw pages to cited contexts."""
    got = research(table(spark, d, "queries"), _hits(spark, d), spread(table(spark, d, "pages")))
    return got.contexts.select("query_id", "markdown", "tokens", "units_considered", F.size("sources").alias("n_sources"), F.size("selected").alias("n_selected"))


@query
def research_failures(spark: SparkSession, d: str) -> DataFrame:
    return research(table(spark, d, "queries"), _hits(spark, d), table(spark, d, "pages")).failures


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return extract(spread(table(spark, d, "pages").select("page_id", "final_url", "body")))


@query
def extract_articles(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("page_id", "url", "article.kind", F.size("article.units").alias("n_units"), "article.markdown", F.col("error.message").alias("error"))


@query
def page_kind(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("page_id", "article.kind")


@query
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("page_id", "article.meta.language", "article.meta.site_name")


@query
def page_head(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("page_id", "article.meta.*")


@query
def denoise_stats(spark: SparkSession, d: str) -> DataFrame:
    got = _articles(spark, d).select("page_id", "article.stats.*")
    return got.select("*", F.round(T.compression(F.col("html_bytes"), F.col("markdown_bytes")), 6).alias("compression"))


@query
def units(spark: SparkSession, d: str) -> DataFrame:
    return units_of(_articles(spark, d))


@query
def links(spark: SparkSession, d: str) -> DataFrame:
    return links_of(_articles(spark, d))


@query
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    return units_of(_articles(spark, d)).select("source_id", "unit_idx", F.array_join("heading_path", " › ").alias("trail"))


@query
def repair_markup(spark: SparkSession, d: str) -> DataFrame:
    @F.udf("string", useArrow=True)
    def run(html: str | None) -> str | None:
        return None if html is None else repair(html)

    return table(spark, d, "pages").select("page_id", F.md5(run("body")).alias("hash"))


@query
def needs_javascript(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").dropDuplicates(["page_id"])
    text = extract(pages).select("page_id", "article.text")
    return pages.join(text, "page_id").select("page_id", crawl.needs_javascript(F.col("body"), F.col("text")).alias("needs"))


@query
def fetchable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", crawl.fetchable(F.col("content_type"), F.col("body")).alias("fetchable"))


@query
def retryable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", crawl.retryable(F.col("status")).alias("retry"))


@query
def crawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "pages").select("url").distinct()
    return crawl.crawl_schedule(urls).select("url", "host", F.round("start_offset_s", 3).alias("start_offset_s"))


def _robots_files(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "pages").select(U.origin(F.col("final_url")).alias("origin")).where("origin is not null").distinct()
    body = F.lit("User-agent: *\nDisallow: /docs/\nAllow: /docs/b*\nDisallow: /*/m*$\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /\nSitemap: https://x.example/map.xml\n")
    return sites.withColumn("body", body)


@query
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "pages").select("page_id", F.col("final_url").alias("url"))
    return crawl.robots_allowed(urls, crawl.robots_rules(_robots_files(spark, d), "skein")).select("page_id", "allowed")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The recorded hits written as answers of two providers: one read natively, one in Arrow batches."""
    hit = F.struct("rank", F.col("hit_id").cast("string").alias("objectID"), F.coalesce("title", F.lit("")).alias("title"), "url", F.coalesce("snippet", F.lit("")).alias("content"))
    lists = _hits(spark, d).where("url <> ''").groupBy("query_id", "provider_pos").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    name = F.when(F.col("provider_pos") % 2 == 0, F.lit("searx")).otherwise(F.lit("hn"))
    body = F.to_json(F.struct(F.col("hits").alias("results"), F.col("hits").alias("hits")))
    return lists.select("query_id", name.alias("provider"), "provider_pos", body.alias("body"), F.lit(None).cast("string").alias("arg"))


@query
def search(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.search(_payloads(spark, d))[0].select("query_id", "key", "position")


@query
def parse_hits(spark: SparkSession, d: str) -> DataFrame:
    return payloads.parse_hits(_payloads(spark, d))[0].select("query_id", "provider_pos", "rank", "provider", "title", "url")


@query
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    def clean(c: str) -> Column:
        return F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    item = F.concat(F.lit("<item><title>"), clean("title"), F.lit("</title><link>"), clean("url"), F.lit("</link><description>"), clean("description"), F.lit("</description></item>"))
    sites = table(spark, d, "articles").dropDuplicates(["source_id"]).groupBy(F.lower(U.part(F.col("url"), 2)).alias("host")).agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"))
    feeds = sites.select(F.lit(1).alias("query_id"), F.lit("feed").alias("provider"), F.lit(0).alias("provider_pos"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("body"), F.col("host").alias("arg"))
    return payloads.parse_hits(feeds)[0].select("title", "url")


@query
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.col("final_url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = table(spark, d, "pages").dropDuplicates(["page_id"]).groupBy(F.lower(U.part(F.col("final_url"), 2)).alias("host")).agg(F.array_join(F.collect_list(loc), "").alias("body"))
    files = maps.select(F.lit(1).alias("query_id"), F.lit("sitemap").alias("provider"), F.lit(0).alias("provider_pos"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("body"), F.col("host").alias("arg"))
    return payloads.parse_hits(files)[0].select("url")


@query
def chunks(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "units").dropDuplicates(["source_id", "unit_idx"])
    return chunking.chunk(own, overlap_tokens=0)


@query
def chunks_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(table(spark, d, "units").dropDuplicates(["source_id", "unit_idx"]))


@query
def shingle_f1(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").dropDuplicates(["page_id"])
    got = extract(pages).select("page_id", "article.text")
    stored = table(spark, d, "articles").dropDuplicates(["source_id"]).select(F.col("source_id").alias("page_id"), F.col("text").alias("stored"))
    return got.join(stored, "page_id").select("page_id", quality.shingle_f1(F.col("text"), F.col("stored")).alias("q")).select("page_id", *(F.round(f"q.{c}", 6).alias(c) for c in ("recall", "precision", "f1")))


@query
def furniture_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("source_id", quality.furniture_hits(F.col("text")).alias("hits"))


@query
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("source_id"), "body").dropDuplicates(["source_id"])
    own = table(spark, d, "articles").select("source_id", "markdown", "text").dropDuplicates(["source_id"])
    picked = ranking.candidates(table(spark, d, "units").dropDuplicates(["source_id", "unit_idx"])).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", "markdown"))), lambda u: u["markdown"]), "\n\n").alias("slim"))
    cost = quality.token_cost(F.col("body"), F.col("markdown"), F.coalesce("slim", F.lit("")))
    return pages.join(own, "source_id").join(picked, "source_id", "left").select("source_id", cost.alias("c")).select("source_id", "c.*")


@query
def answer_presence(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "queries").select("query_id", F.explode(F.array_distinct(T.words(F.col("q")))).alias("w")).select("query_id", F.concat(F.lit(r"(?i)\Q"), "w", F.lit(r"\E")).alias("pattern"))
    contexts = slim(_per_query(spark, d), table(spark, d, "queries"))
    return quality.answer_presence(contexts, asked)
