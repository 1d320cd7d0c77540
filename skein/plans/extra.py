"""Queries of single functions and providers, each beside the DuckDB statement that checks it.

The statements state values of their own; nothing is imported from what they check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.durable import cut, shared_dir
from skein.functions import text as T
from skein.functions import url as U
from skein.html.listing import CONTROLS, COUNTED
from skein.html.markdown import plain
from skein.pipeline import search
from skein.sources import crawl, payloads
from skein.sources.documents import decode_entities as entities
from skein.sources.recorded import read_recorded
from skein.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WS = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_HITS = "(SELECT DISTINCT ON (hit_id) * FROM searchresults)"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def checked(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Text and URLs ------------------------------------------------------------------------------------


@checked(
    "SELECT source_id, unit_idx, CASE WHEN text IS NOT NULL THEN c BETWEEN 4352 AND 4607 OR c BETWEEN 12352 AND 12543 OR c BETWEEN 13312 AND 19903 OR c BETWEEN 19968 AND 40959"
    " OR c BETWEEN 43360 AND 43391 OR c BETWEEN 44032 AND 55215 OR c BETWEEN 63744 AND 64255 OR c BETWEEN 65382 AND 65437 OR c BETWEEN 131072 AND 195103 END AS cjk"
    " FROM (SELECT *, unicode(substring(text, 1, 1)) AS c FROM units)"
)
def is_cjk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("source_id", "unit_idx", T.is_cjk(F.substring("text", 1, 1)).alias("cjk"))


@checked("SELECT source_id, unit_idx, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '…' ELSE text END AS short, substring(text, 1, 30) AS clamped FROM units")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("source_id", "unit_idx", T.truncate(F.col("text"), 40).alias("short"), T.clamp(F.col("text"), 30).alias("clamped"))


@checked(
    "SELECT hit_id, CASE WHEN regexp_full_match(n, '[a-z0-9+#-]{1,16}') THEN n END AS code, CASE WHEN n IN ('python', 'rust', 'sql') THEN n END AS known"
    " FROM (SELECT hit_id, lower(CASE hit_id % 4 WHEN 0 THEN provider WHEN 1 THEN 'Python' WHEN 2 THEN 'two words' ELSE 'rust' END) AS n FROM searchresults)"
)
def normalize_language(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("hit_id", F.lit(4))
    name = F.when(k == 0, F.concat(F.lit(' "'), "provider", F.lit('"'))).when(k == 1, " Python ").when(k == 2, "two words").otherwise('"rust"')
    return table(spark, d, "searchresults").select("hit_id", T.normalize_language(name).alias("code"), T.normalize_language(name, True).alias("known"))


@checked("SELECT page_id, CASE WHEN status < 400 THEN greatest(CAST(elapsed_ms - 100 AS DOUBLE), 0.0) END AS seconds FROM pages")
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    header = F.when(F.col("status") < 400, F.concat(F.lit(" "), (F.col("elapsed_ms") - 100).cast("string"), F.lit("\t"))).otherwise("Wed, 21 Oct 2015 07:28:00 GMT")
    return table(spark, d, "pages").select("page_id", T.retry_after(header).alias("seconds"))


@checked("SELECT page_id, CASE WHEN elapsed_ms > 600 AND page_id % 2 = 0 THEN NULL WHEN page_id % 2 = 0 THEN elapsed_ms / 10.0::DOUBLE ELSE 0.4::DOUBLE * pow(2, page_id % 5) END AS seconds FROM pages")
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    wish = F.when(F.col("page_id") % 2 == 0, F.col("elapsed_ms") / 10)
    return table(spark, d, "pages").select("page_id", crawl.retry_delay(F.col("page_id") % 5, wish).alias("seconds"))


@checked(f"SELECT query_id, {_ws("translate(q || ' what?*  now *', '?*', '  ')")} AS term FROM queries")
def search_term(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", T.search_term(F.concat("q", F.lit(" what?*  now *"))).alias("term"))


@checked(f"SELECT source_id, {_ws("coalesce(description, '')")} AS abstract FROM articles")
def inverted_abstract(spark: SparkSession, d: str) -> DataFrame:
    """The words of each description as a map of positions, put together again."""
    words = F.split(T.normalize_ws(F.coalesce("description", F.lit(""))), " ")
    own = table(spark, d, "articles").select("source_id", words.alias("words"))
    places = F.transform(F.array_distinct("words"), lambda w: F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i) == w))
    return own.select("source_id", T.inverted_abstract(F.map_from_arrays(F.array_distinct("words"), places)).alias("abstract"))


@checked(
    "SELECT source_id, 'https://' || CASE WHEN l = '' THEN 'en' ELSE l END || '.wikipedia.org/wiki/' || replace(replace(url_encode(replace(title, ' ', '_')), '%2F', '/'), '%3A', ':') AS page"
    " FROM (SELECT *, substring(regexp_replace(lower(coalesce(language, '')), '[^a-z0-9-]', '', 'g'), 1, 12) AS l FROM articles)"
)
def wiki_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("source_id", U.wiki_url(F.col("language"), F.col("title")).alias("page"))


@checked("SELECT hit_id, CASE WHEN hit_id % 3 = 0 THEN 'https://x.example/a' ELSE nullif(url, '') END AS target FROM searchresults")
def unwrap_redirect(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.when(F.col("url") != "", F.concat(F.lit("//r.example/l/?uddg="), F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("&rut=1"))).otherwise("/l/?x=1")
    href = F.when(F.col("hit_id") % 3 == 0, "//x.example/a").otherwise(wrapped)
    return table(spark, d, "searchresults").select("hit_id", U.unwrap_redirect(href).alias("target"))


@checked("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'socks5://***@10.0.0.1:9' ELSE 'http://10.0.0.1:9' END AS shown FROM pages")
def mask_proxy(spark: SparkSession, d: str) -> DataFrame:
    proxy = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("socks5://user:"), F.col("page_id").cast("string"), F.lit("@10.0.0.1:9"))).otherwise("http://10.0.0.1:9")
    return table(spark, d, "pages").select("page_id", U.mask_proxy(proxy).alias("shown"))


@checked(
    "SELECT source_id, round(CASE WHEN strlen(body) > 0 THEN 1 - least(1.0, strlen(markdown) / strlen(body)) ELSE 0 END, 6) AS share"
    " FROM (SELECT DISTINCT ON (source_id) * FROM articles) JOIN (SELECT DISTINCT ON (page_id) * FROM pages) ON source_id = page_id WHERE body IS NOT NULL AND markdown IS NOT NULL"
)
def compression(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "articles").dropDuplicates(["source_id"]).join(table(spark, d, "pages").dropDuplicates(["page_id"]).select("page_id", "body"), F.col("source_id") == F.col("page_id"))
    return own.where("body is not null and markdown is not null").select("source_id", F.round(T.compression(F.octet_length("body"), F.octet_length("markdown")), 6).alias("share"))


@checked("SELECT source_id, unit_idx, md5(text || ' & © é') AS hash FROM units")
def decode_entities(spark: SparkSession, d: str) -> DataFrame:
    """Texts written with entities, decoded again."""
    coded = F.col("text")
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;"), ("'", "&#x27;")):
        coded = F.replace(coded, F.lit(char), F.lit(code))

    @F.udf("string", useArrow=True)
    def run(text: str | None) -> str | None:
        return None if text is None else entities(text)

    return table(spark, d, "units").select("source_id", "unit_idx", F.md5(run(F.concat(coded, F.lit(" & &copy; &eacute;")))).alias("hash"))


@checked(
    f"SELECT source_id, unit_idx, md5({_ws("regexp_replace(t, '[*`~#>]', '', 'g')")} || ' link_#1 [x] end') AS hash"
    " FROM (SELECT *, regexp_replace(regexp_replace(text, '[\\\\]', '', 'g'), '[\\[\\]]', '', 'g') || '.' AS t FROM units)"
)
def strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Texts with emphasis, a link and escapes around them, made plain again."""

    @F.udf("string", useArrow=True)
    def run(text: str | None) -> str | None:
        return None if text is None else plain(text)

    bare = F.regexp_replace("text", r"[\\\[\]]", "")
    marked = F.concat(F.lit("**"), bare, F.lit(r".** [link_#1](https://a.example/(b)) \[x\] *end*"))
    return table(spark, d, "units").select("source_id", "unit_idx", F.md5(run(marked)).alias("hash"))


@checked("SELECT doc_id, md5(text) AS hash FROM documents")
def charset_decode(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes: UTF-8 with and without a header, and UTF-16 by its header."""
    wide = F.col("doc_id") % 3 == 0
    raw = F.when(wide, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(wide, "text/html; charset=utf-16").when(F.col("doc_id") % 3 == 1, "text/html; charset='UTF-8'")
    pages = table(spark, d, "documents").select("doc_id", raw.alias("raw"), kind.alias("content_type"), "url")
    return crawl.decoded(pages).select("doc_id", F.md5("body").alias("hash"))


@checked(
    r"SELECT page_id, h IN ('localhost', 'internal', 'fd00::1', '::1') OR ends_with(h, '.internal') OR starts_with(h, '10.') OR starts_with(h, '192.168.') OR regexp_matches(h, '^172\.(1[6-9]|2[0-9]|3[01])\.') AS internal"
    r" FROM (SELECT page_id, coalesce(CASE page_id % 9 WHEN 0 THEN 'localhost' WHEN 1 THEN '10.1.2.3' WHEN 2 THEN '192.168.0.9' WHEN 3 THEN '172.20.1.1' WHEN 4 THEN '172.32.1.1' WHEN 5 THEN 'a.internal' WHEN 6 THEN 'fd00::1'"
    r" ELSE lower(regexp_extract(final_url, '://([^/:?#]+)', 1)) END, '') AS h FROM pages WHERE final_url IS NOT NULL)"
)
def internal_host(spark: SparkSession, d: str) -> DataFrame:
    names = ("localhost", "10.1.2.3", "192.168.0.9", "172.20.1.1", "172.32.1.1", "A.internal.", "[fd00::1]")
    url = F.col("final_url")
    for k, name in enumerate(names):
        url = F.when(F.col("page_id") % 9 == k, F.lit(f"http://{name}:8080/x")).otherwise(url)
    return table(spark, d, "pages").where("final_url is not null").select("page_id", U.internal_host(url).alias("internal"))


@checked(
    f"WITH h AS (SELECT hit_id, {_ws("coalesce(title, '')")} AS t FROM searchresults), w AS (SELECT *, lower(t) AS l, length(t) AS n, string_split(lower(t), ' ') AS w FROM h)"
    r" SELECT hit_id, n BETWEEN 8 AND 200 AND (n >= 12 OR len(w) > 1) AND regexp_matches(t, '\p{L}') AND NOT (l IN ('advertisement', 'skip to content', 'newsletter', 'read more', 'subscribe', 'settings', 'register'))"
    r" AND NOT (len(w) = 1 AND contains(t, '.'))"
    r" AND NOT (len(w) <= 3 AND regexp_matches(w[1], '^[^\p{L}\p{N}]*[0-9][0-9.,]*[^\p{L}\p{N}]*$') AND len(list_filter(w[2:], lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g') IN"
    " ('comment', 'comments', 'point', 'points', 'vote', 'votes', 'reply', 'replies', 'view', 'views', 'minutes', 'hours', 'days', 'years', 'ago'))) > 0) AS headline FROM w"
)
def headline_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "searchresults").select("hit_id", T.is_headline(F.coalesce("title", F.lit("")), tuple(sorted(CONTROLS)), tuple(sorted(COUNTED))).alias("headline"))


# Crawl --------------------------------------------------------------------------------------------


_STEP = "(SELECT url AS f, min(final_url) AS t FROM pages WHERE url <> final_url GROUP BY 1)"


@checked(
    f"WITH RECURSIVE s AS {_STEP}, w AS (SELECT DISTINCT url, url AS here, 0 AS hops FROM pages WHERE url IS NOT NULL UNION ALL SELECT url, t, hops + 1 FROM w JOIN s ON here = f WHERE hops < 5),"
    " e AS (SELECT url, max(hops) AS hops FROM w GROUP BY 1)"
    " SELECT e.url, CASE WHEN s.t IS NULL THEN w.here END AS final_url, CAST(e.hops AS INTEGER) AS hops FROM e JOIN w USING (url, hops) LEFT JOIN s ON w.here = s.f"
)
def follow_redirects(spark: SparkSession, d: str) -> DataFrame:
    hops = table(spark, d, "pages").where("url is not null").select("url", F.when(F.col("url") != F.col("final_url"), F.col("final_url")).alias("target"))
    return crawl.follow_redirects(hops).select("url", "final_url", "hops")


@checked("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://moved.example/' || page_id END AS redirect FROM pages")
def html_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Every other page as a stub that sends its reader on at once; the others wait or send nobody."""
    goal = F.concat(F.lit("https://moved.example/"), F.col("page_id").cast("string"))
    refresh = F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), goal, F.lit('">'))
    script = F.concat(F.lit("<script>window.location.replace('"), goal, F.lit("')</script>"))
    slow = F.concat(F.lit('<p>Stay.</p><meta http-equiv="refresh" content="30; url='), goal, F.lit('">'))
    k = F.col("page_id") % 4
    body = F.when(k == 0, refresh).when(k == 2, script).when(k == 1, slow).otherwise("<p>location unknown</p>")
    return crawl.html_redirects(table(spark, d, "pages").select("page_id", F.lit("https://from.example/").alias("final_url"), body.alias("body"))).select("page_id", "redirect")


_ORIGINS = "(SELECT DISTINCT lower(regexp_extract(final_url, '^([A-Za-z]+://[^/?#]+)', 1)) AS origin FROM pages WHERE regexp_matches(final_url, '^[Hh][Tt][Tt][Pp][Ss]?://'))"


@checked(
    f"SELECT origin, allow, pattern, delay AS crawl_delay FROM {_ORIGINS}, (VALUES (0, false, '/docs/', 2.0::DOUBLE), (0, true, '/docs/b*', 2.0::DOUBLE), (1, false, '/own/', 0.5::DOUBLE)) r(k, allow, pattern, delay) WHERE length(origin) % 2 = k"
)
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Files that differ by host: half have a group of the agent's own, which beats the wildcard's."""
    sites = table(spark, d, "pages").select(U.origin(F.col("final_url")).alias("origin")).where("origin is not null").distinct()
    every = "User-agent: *\nDisallow: /docs/ # all of it\nAllow: /docs/b*\nDisallow:\nCrawl-delay: 2\n\n"
    body = F.when(F.length("origin") % 2 == 1, F.lit(every + "User-Agent: other\nuser-agent: Skein\nDisallow: /own/\nCrawl-delay: 0.5\n")).otherwise(every + "User-agent: other\nDisallow: /\n")
    got = crawl.robots_rules(sites.withColumn("body", body), "skein")
    return got.select("origin", F.explode("rules").alias("r"), "crawl_delay").select("origin", "r.allow", "r.pattern", "crawl_delay")


@checked("SELECT url, final_url, CAST(status AS INTEGER) AS status, content_type, md5(body) AS hash, coalesce(rendered, false) AS rendered FROM pages WHERE content_type IS NULL OR regexp_matches(lower(content_type), '^\\s*(text/|application/(xhtml|xml|json))')")
def recorded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as JSON lines into the shared folder and read by the recorded source, textual ones only."""
    path = f"{shared_dir(spark).rstrip('/')}/skein-recorded"
    table(spark, d, "pages").select("url", "final_url", "status", "content_type", "body", "elapsed_ms", "rendered").write.mode("overwrite").json(path)
    return cut(read_recorded(spark, path, textual=True)).select("url", "final_url", "status", "content_type", F.md5("body").alias("hash"), "rendered")


# Providers ----------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str, provider: str, hit: Column, wrap: Callable[[Column], Column]) -> DataFrame:
    """Hits of one provider's recorded answers: each query's stored hits in its format, in order of hit."""
    hits = table(spark, d, "searchresults").dropDuplicates(["hit_id"]).where("url <> ''").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("snippet", F.coalesce("snippet", F.lit("")))
    lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hit_id", hit.alias("h"))), lambda a, b: F.sign(a["hit_id"] - b["hit_id"]).cast("int")), lambda x: x["h"]).alias("hits"))
    own = lists.select("query_id", F.lit(provider).alias("provider"), F.lit(0).alias("provider_pos"), wrap(F.col("hits")).alias("body"), F.lit("de").alias("arg"))
    return payloads.parse_hits(own)[0].select("query_id", "rank", "title", "url", "snippet")


def _expected(url: str = "url", snippet: str = _ws("coalesce(snippet, '')"), title: str = _ws("coalesce(title, '')")) -> str:
    return (
        f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit_id) - 1 AS INTEGER) AS rank, {title} AS title, {url} AS url, {snippet} AS snippet"
        f" FROM {_HITS} WHERE url <> ''"
    )


def _json(path: str) -> Callable[[Column], Column]:
    """An object that holds the hits at a dotted path."""

    def wrap(hits: Column) -> Column:
        for name in reversed(path.split(".")):
            hits = F.struct(hits.alias(name))
        return F.to_json(hits)

    return wrap


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_TITLED = "'https://de.wikipedia.org/wiki/' || replace(replace(url_encode(replace(" + _ws("coalesce(title, '')") + ", ' ', '_')), '%2F', '/'), '%3A', ':')"
_ABSTRACT = _ws("'A B, C D, E F et al. (2019)' || CASE WHEN coalesce(snippet, '') <> '' THEN '. ' ELSE '' END || coalesce(snippet, '')")


@checked(_expected(url=_TITLED))
def provider_wikipedia(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d, "wiki:de", F.struct(T.normalize_ws(F.col("title")).alias("title"), F.concat(F.lit("<b>"), _escaped("snippet"), F.lit("</b>")).alias("snippet")), _json("query.search"))


@checked(_expected(snippet=_ABSTRACT))
def provider_openalex(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.struct(F.struct(F.lit(n).alias("display_name")).alias("author")) for n in ("A B", "C D", "E F", "G H")))
    words = F.split(T.normalize_ws(F.col("snippet")), " ")
    index = F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w)))
    work = F.struct("title", F.lit("2019-05-01").alias("publication_date"), F.struct(F.col("url").alias("landing_page_url")).alias("primary_location"), names.alias("authorships"), index.alias("abstract_inverted_index"))
    return _answers(spark, d, "openalex", work, _json("results"))


@checked(_expected(snippet=_ABSTRACT))
def provider_crossref(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.struct(F.lit(a).alias("given"), F.lit(b).alias("family")) for a, b in ("AB", "CD", "EF", "GH")))
    issued = F.struct(F.array(F.array(F.lit(2019), F.lit(5))).alias("date-parts"))
    work = F.struct(F.array("title").alias("title"), F.col("url").alias("URL"), F.concat(F.lit("<jats:p>"), _escaped("snippet"), F.lit("</jats:p>")).alias("abstract"), names.alias("author"), issued.alias("issued"))
    return _answers(spark, d, "crossref", work, _json("message.items"))


@checked(_expected(url="'https://europepmc.org/article/MED/' || hit_id", snippet=_ABSTRACT))
def provider_europepmc(spark: SparkSession, d: str) -> DataFrame:
    work = F.struct(F.col("hit_id").cast("string").alias("id"), F.lit("MED").alias("source"), "title", F.lit("A B, C D, E F, G H").alias("authorString"), F.lit("2019-05-01").alias("firstPublicationDate"), _escaped("snippet").alias("abstractText"))
    return _answers(spark, d, "pubmed", work, _json("resultList.result"))


@checked(_expected(snippet="CASE WHEN coalesce(snippet, '') = '' THEN '3 answers, accepted. a, b' ELSE '3 answers, accepted. a, b. ' || " + _ws("snippet") + " END"))
def provider_stackexchange(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(_escaped("title").alias("title"), F.col("url").alias("link"), F.lit(3).alias("answer_count"), F.lit(7).alias("accepted_answer_id"), F.array(F.lit("a"), F.lit("b")).alias("tags"), _escaped("snippet").alias("body"))
    return _answers(spark, d, "se:superuser", item, _json("items"))


@checked(_expected(snippet="coalesce(snippet, '') || ' — Scala, ' || hit_id || ' stars'"))
def provider_github(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("title").alias("full_name"), F.col("url").alias("html_url"), F.col("snippet").alias("description"), F.lit("Scala").alias("language"), F.col("hit_id").alias("stargazers_count"))
    return _answers(spark, d, "gh", item, _json("items"))


@checked(_expected(url="regexp_replace(url, '^http:', 'https:')", snippet=_ABSTRACT))
def provider_arxiv(spark: SparkSession, d: str) -> DataFrame:
    names = "".join(f"<author><name>{n}</name></author>" for n in ("A B", "C D", "E F", "G H"))
    entry = F.concat(F.lit("<entry><title>"), _escaped("title"), F.lit("</title><id>x</id><published>2019-05-01</published>" + names + '<link rel="alternate" href="'), _escaped("url"), F.lit('"/><summary>'), _escaped("snippet"), F.lit("</summary></entry>"))
    return _answers(spark, d, "arxiv", entry, lambda hits: F.concat(F.lit("<feed>"), F.array_join(hits, ""), F.lit("</feed>")))


@checked(_expected())
def provider_duckduckgo(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("//r.example/l/?uddg="), F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")))
    card = F.concat(F.lit('<div class="result"><h2><a class="result__a" href="'), link, F.lit('">'), _escaped("title"), F.lit('</a></h2><div class="result__snippet">'), _escaped("snippet"), F.lit("</div></div>"))
    return _answers(spark, d, "ddg", card, lambda hits: F.array_join(hits, ""))


@checked(_expected(snippet=_ws("coalesce(snippet, '')")))
def provider_searxng_html(spark: SparkSession, d: str) -> DataFrame:
    card = F.concat(F.lit('<article class="result"><h3><a href="'), _escaped("url"), F.lit('">'), _escaped("title"), F.lit('</a></h3><p class="content">'), _escaped("snippet"), F.lit("</p></article>"))
    return _answers(spark, d, "searx", card, lambda hits: F.array_join(hits, ""))


@checked(
    "WITH a AS (SELECT DISTINCT ON (source_id) * FROM articles WHERE coalesce(url, '') <> '') SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, count(*) AS items FROM a GROUP BY 1"
)
def feed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one Atom feed per host, written leniently: a bare ampersand, an unknown entity and a wrong end name."""
    entry = F.concat(F.lit("<entry><title>A & B &nix; "), F.col("source_id").cast("string"), F.lit("</titel><link href=\""), "url", F.lit("\"/></entry>"))
    sites = table(spark, d, "articles").dropDuplicates(["source_id"]).where("coalesce(url, '') <> ''").groupBy(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]+)", 1)).alias("host")).agg(F.array_join(F.collect_list(entry), "").alias("items"))
    feeds = sites.select(F.col("host").alias("query_id"), F.lit("atom").alias("provider"), F.lit(0).alias("provider_pos"), F.concat(F.lit("<feed>"), "items", F.lit("</feed>")).alias("body"), F.lit(None).cast("string").alias("arg"))
    return payloads.parse_hits(feeds)[0].groupBy(F.col("query_id").alias("host")).agg(F.count("*").alias("items"))


@checked(
    "WITH q AS (SELECT query_id, string_split(trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM queries WHERE regexp_full_match(q, '[ -~]+')),"
    " s AS (SELECT query_id, i, 'https://map.example/' || CASE WHEN i = 3 THEN 'nothing-shared-zzz' ELSE w[1] || '-' || i END AS url FROM q, range(4) r(i) WHERE len(w) > 0 AND w[1] <> '' AND length(w[1]) > 1 AND NOT regexp_full_match(w[1], '[0-9]+'))"
    " SELECT query_id, url FROM s WHERE i < 3"
)
def sitemap_children(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap index per question whose three children list one matching page each; the second lists a page that doesn't match, a fourth isn't read."""
    asked = table(spark, d, "queries").where(F.col("q").rlike("^[ -~]+$"))
    word = F.get(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("q"), "[^a-z0-9]+", " ")), " ")), 0)
    asked = asked.withColumn("w", word).where((F.length("w") > 1) & ~F.col("w").rlike("^[0-9]+$"))
    child = F.concat(F.lit("https://map.example/"), F.col("query_id").cast("string"), F.lit("-"))
    names = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("<sitemap><loc>"), child, i.cast("string"), F.lit(".xml</loc></sitemap>")))
    index = asked.select("query_id", F.lit("sitemap").alias("provider"), F.lit(0).alias("provider_pos"), F.concat(F.lit("<sitemapindex>"), F.array_join(names, ""), F.lit("</sitemapindex>")).alias("body"), F.lit(None).cast("string").alias("arg"))
    page = F.concat(F.lit("<url><loc>https://map.example/"), "w", F.lit("-"), F.col("i").cast("string"), F.lit("</loc></url>"))
    other = F.when(F.col("i") == 1, "<url><loc>https://map.example/nothing-shared-zzz</loc></url>").otherwise("")
    files = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.concat(child, F.col("i").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), page, other, F.lit("</urlset>")).alias("body"))
    return search(index, 10, queries=asked.select("query_id", "q"), files=files)[0].select("query_id", "url")
