"""Search providers' recorded answers as ranked hits.

JSON answers are read with declared schemas by native expressions; Atom, HTML and metasearch fallbacks
go through one Arrow function. Each provider is a relation; a payload that can't be read becomes a
failure row, and the other providers' hits stand.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.url import wiki_language, wiki_url
from skein.operators.ranking import rank_hits

HIT = "struct<title:string,url:string,snippet:string>"
# Other names of providers.
ALIASES = {
    "ddg": "duckduckgo",
    "pubmed": "europepmc",
    "pmc": "europepmc",
    "hn": "hackernews",
    "se": "stackexchange",
    "stackoverflow": "stackexchange",
    "gh": "github",
    "wiki": "wikipedia",
    "searx": "searxng",
    "atom": "rss",
    "feed": "rss",
    "page": "index",
    "listing": "index",
}


def provider_name(spec: Column) -> Column:
    """The provider that a specification such as ``se:stackoverflow`` or ``ddg`` names."""
    name = F.lower(F.substring_index(F.trim(spec), ":", 1))
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(table[name], name)


def _hit(title: Column, url: Column, snippet: Column) -> Column:
    return F.struct(T.normalize_ws(F.coalesce(title, F.lit(""))).alias("title"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(snippet, F.lit("")).alias("snippet"))


def _bare(html: Column) -> Column:
    """Text of an HTML fragment with the entities that JSON answers use."""
    out = T.strip_tags(F.coalesce(html, F.lit("")))
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return T.normalize_ws(out)


def _json(schema: str, items: str, hit: Callable[[Column], Column], error: str | None = None):
    """A reader: (hits column, message column) of a JSON body."""

    def read(body: Column, arg: Column) -> tuple[Column, Column]:
        parsed = F.from_json(body, schema)
        path = parsed
        for name in items.split("."):
            path = path[name]
        hits = F.filter(F.transform(path, lambda x: hit(x, arg) if hit.__code__.co_argcount > 1 else hit(x)), lambda h: h["url"] != "")  # type: ignore[call-arg]
        message = F.when(path.isNull(), F.lit("unexpected payload"))
        if error:
            told = parsed
            for name in error.split("."):
                told = told[name]
            message = F.when(told.isNotNull(), told).otherwise(message)
        return F.coalesce(hits, F.array().cast(f"array<{HIT}>")), message

    return read


def _count(n: Column, word: str) -> Column:
    return F.concat(F.coalesce(n, F.lit(0)).cast("string"), F.lit(f" {word}"))


def _openalex(x: Column) -> Column:
    best = F.coalesce(x["open_access"]["oa_url"], x["primary_location"]["landing_page_url"], x["doi"])
    url = F.coalesce(x["best_oa_location"]["landing_page_url"], best)
    names = F.transform(x["authorships"], lambda a: a["author"]["display_name"])
    return _hit(x["title"], url, T.scholarly_snippet(names, x["publication_date"], T.inverted_abstract(x["abstract_inverted_index"])))


def _crossref(x: Column) -> Column:
    names = F.transform(x["author"], lambda a: T.normalize_ws(F.concat_ws(" ", a["given"], a["family"])))
    year = F.get(F.get(x["issued"]["date-parts"], 0), 0).cast("string")
    return _hit(F.get(x["title"], 0), F.coalesce(x["resource"]["primary"]["URL"], x["URL"]), T.scholarly_snippet(names, year, _bare(x["abstract"])))


def _europepmc(x: Column) -> Column:
    names = F.filter(F.split(F.coalesce(x["authorString"], F.lit("")), ", "), lambda n: n != "")
    page = F.concat(F.lit("https://europepmc.org/article/"), x["source"], F.lit("/"), x["id"])
    doi = F.concat(F.lit("https://doi.org/"), x["doi"])
    return _hit(x["title"], F.coalesce(page, doi), T.scholarly_snippet(names, x["firstPublicationDate"], _bare(x["abstractText"])))


def _hackernews(x: Column) -> Column:
    talk = F.concat(F.lit("https://news.ycombinator.com/item?id="), x["objectID"])
    told = T.normalize_ws(F.concat_ws(". ", F.concat_ws(", ", _count(x["points"], "points"), _count(x["num_comments"], "comments")), F.nullif(_bare(F.coalesce(x["story_text"], x["comment_text"])), F.lit(""))))
    return _hit(F.coalesce(x["title"], x["story_title"]), F.coalesce(x["url"], x["story_url"], talk), T.clamp(told))


def _stackexchange(x: Column) -> Column:
    accepted = F.when(x["accepted_answer_id"].isNotNull(), F.lit("accepted"))
    tags = F.array_join(F.slice(F.coalesce(x["tags"], F.array().cast("array<string>")), 1, 5), ", ")
    told = F.concat_ws(". ", F.concat_ws(", ", _count(x["answer_count"], "answers"), accepted), F.nullif(tags, F.lit("")), F.nullif(_bare(x["body"]), F.lit("")))
    return _hit(_bare(x["title"]), x["link"], T.clamp(told))


def _github(x: Column) -> Column:
    told = F.concat_ws(" — ", x["description"], F.concat_ws(", ", x["language"], _count(x["stargazers_count"], "stars")))
    return _hit(x["full_name"], x["html_url"], T.clamp(told))


def _wikipedia(x: Column, lang: Column) -> Column:
    return _hit(x["title"], wiki_url(wiki_language(lang), x["title"]), _bare(x["snippet"]))


NATIVE = {
    "wikipedia": _json("error struct<info:string>, query struct<search:array<struct<title:string,snippet:string>>>", "query.search", _wikipedia, "error.info"),
    "openalex": _json(
        "results array<struct<title:string,doi:string,publication_date:string,best_oa_location:struct<landing_page_url:string>,open_access:struct<oa_url:string>,"
        "primary_location:struct<landing_page_url:string>,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>>>",
        "results",
        _openalex,
    ),
    "crossref": _json(
        "message struct<items:array<struct<title:array<string>,URL:string,abstract:string,resource:struct<primary:struct<URL:string>>,"
        "author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>>>",
        "message.items",
        _crossref,
    ),
    "europepmc": _json(
        "resultList struct<result:array<struct<id:string,source:string,doi:string,title:string,authorString:string,firstPublicationDate:string,abstractText:string>>>",
        "resultList.result",
        _europepmc,
    ),
    "hackernews": _json(
        "hits array<struct<objectID:string,title:string,story_title:string,url:string,story_url:string,points:int,num_comments:int,story_text:string,comment_text:string>>",
        "hits",
        _hackernews,
    ),
    "stackexchange": _json(
        "error_message string, items array<struct<title:string,link:string,answer_count:int,accepted_answer_id:long,tags:array<string>,body:string>>",
        "items",
        _stackexchange,
        "error_message",
    ),
    "github": _json("message string, items array<struct<full_name:string,html_url:string,description:string,language:string,stargazers_count:long>>", "items", _github, "message"),
}
#: Sources that list what they have, whatever the question; and how many sitemaps of an index are read.
LISTINGS, MAX_CHILDREN = ("rss", "sitemap", "index"), 3
PARSED = ("duckduckgo", "searxng", "arxiv", "rss", "sitemap", "index")


def _parsed(provider: str, body: str, arg: str | None) -> list[tuple[str, str, str]]:
    from skein.sources import documents as D

    if provider == "duckduckgo":
        return D.result_page(body)
    if provider == "searxng":
        return D.metasearch(body)
    if provider == "arxiv":
        return D.arxiv(body)
    if provider == "rss":
        return [(x["title"], x["link"], x["summary"]) for x in D.feed_items(body)]
    if provider == "sitemap":
        return [("", u, "") for u in D.sitemap(body)["urls"]]
    return D.index_page(body, arg)


def with_children(payloads: DataFrame, files: DataFrame) -> DataFrame:
    """``payloads`` whose sitemap indexes are replaced by the first MAX_CHILDREN sitemaps they name, as far as ``files`` (url, body) holds them.

    A child takes its parent's place in order; of several files with one url the one with the longest body counts.
    """

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def children(body: pd.Series) -> pd.Series:
        from skein.sources import documents as D

        out = []
        for b in body:
            try:
                found = D.sitemap(b or "")
                out.append([] if found["urls"] else found["sitemaps"][:MAX_CHILDREN])
            except ValueError:
                out.append([])
        return pd.Series(out)

    of_map = provider_name(F.col("provider")) == "sitemap"
    maps = payloads.where(of_map).withColumn("_children", children("body"))
    parents = maps.where(F.size("_children") > 0).select("*", F.posexplode("_children").alias("_at", "_child")).drop("body")
    stored = files.groupBy(F.col("url").alias("_child")).agg(F.max_by("body", F.length("body")).alias("_body"))
    keys = [c for c in payloads.columns if c != "body"]
    joined = parents.join(stored, "_child").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_body"))).alias("_bodies"))
    merged = joined.select(*keys, F.concat(F.lit("<urlset>"), F.array_join(F.transform("_bodies", lambda x: x["_body"]), "\n"), F.lit("</urlset>")).alias("body"))
    lonely = maps.where(F.size("_children") == 0).select(*payloads.columns)
    rest = payloads.where(~F.coalesce(of_map, F.lit(False)))
    return rest.unionByName(lonely).unionByName(merged.select(*payloads.columns))


def ranked(hits: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``hits`` with those of feeds, sitemaps and listings ordered by what their query (query_id, q) asks, the best ``limit`` per answer.

    Such a source lists everything it has, whatever the question. Entries without a shared word fall
    away; an empty question keeps their order. Each answer is its own collection.
    """
    listing = F.col("provider").isin(*LISTINGS)
    key = F.struct("query_id", "provider_pos", "provider")
    own = hits.where(listing).withColumn("_key", F.to_json(key)).withColumn("hit_id", F.col("rank"))
    asked = own.select("_key", "query_id").distinct().join(queries, "query_id").select(F.col("_key").alias("query_id"), "q")
    found = rank_hits(own.drop("query_id").withColumnRenamed("_key", "query_id"), asked, limit).select(F.col("query_id").alias("_key"), "hit_id", "position")
    best = own.join(found, ["_key", "hit_id"]).withColumn("rank", F.col("position")).select(*hits.columns)
    return hits.where(~listing).unionByName(best)


def parse_hits(payloads: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, failures) of recorded answers.

    ``payloads``: query_id, provider (a name or specification), provider_pos, body, arg (a language, or
    an index page's URL; may be null). hits: query_id, provider, provider_pos, rank, title, url, snippet; at most
    ``limit`` per answer. failures: query_id, provider, message.
    """
    own = payloads.select("query_id", provider_name(F.col("provider")).alias("provider"), "provider_pos", F.coalesce("body", F.lit("")).alias("body"), F.col("arg").cast("string").alias("arg"))
    body, arg = F.col("body"), F.col("arg")
    hits, message = F.lit(None).cast(f"array<{HIT}>"), F.lit(None).cast("string")
    for name, read in NATIVE.items():
        found, told = read(body, arg)
        hits = F.when(F.col("provider") == name, found).otherwise(hits)
        message = F.when(F.col("provider") == name, told).otherwise(message)
    native = own.where(F.col("provider").isin(*NATIVE)).withColumn("hits", hits).withColumn("message", message)

    @F.pandas_udf(f"struct<hits:array<{HIT}>,message:string>")  # type: ignore[call-overload]
    def parsed(provider: pd.Series, body: pd.Series, arg: pd.Series) -> pd.DataFrame:
        out, told = [], []
        for p, b, a in zip(provider, body, arg):
            try:
                found = _parsed(p, b, a)
                told.append(None if found else "no hits")
            except ValueError as e:
                found = []
                told.append(f"unexpected payload: {e}"[:300])
            out.append([{"title": t, "url": u, "snippet": s} for t, u, s in found])
        return pd.DataFrame({"hits": out, "message": told})

    other = own.where(F.col("provider").isin(*PARSED)).withColumn("p", parsed("provider", "body", "arg")).select("*", "p.hits", "p.message").drop("p")
    unknown = own.where(~F.col("provider").isin(*NATIVE, *PARSED)).select("*", F.lit(None).cast(f"array<{HIT}>").alias("hits"), F.lit("unknown provider").alias("message"))
    every = native.unionByName(other).unionByName(unknown)
    flat = every.select("query_id", "provider", "provider_pos", F.posexplode("hits").alias("rank", "h")).select("query_id", "provider", "provider_pos", "rank", "h.*")
    flat = flat if limit is None else flat.where(F.col("rank") < limit)
    return flat, every.where("message is not null").select("query_id", "provider", "message")

