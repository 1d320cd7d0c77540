"""DuckDB statements that give what the core's queries give."""

from __future__ import annotations

from skein.functions import scoring
from skein.functions.text import CJK, SPACE, TITLE_SEPARATORS, WORD
from skein.functions.url import TRACKING
from skein.operators.quality import FURNITURE

_WORD = WORD.replace("IsHan", "Han").replace("IsHiragana", "Hiragana").replace("'", "''")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:[?]([^#]*))?(?:#.*)?$"


def _part(url: str, i: int) -> str:
    return f"regexp_extract(trim({url}), '{_PARTS}', {i})"


def tokens_of(text: str) -> str:
    """The token list of a text column."""
    words = f"list_filter(regexp_extract_all({text}, '{_WORD}'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"
    cjk = f"regexp_replace(w, '[^{CJK}]', '', 'g')"
    pairs = f"list_transform(range(1, length({cjk})), lambda i: substring({cjk}, CAST(i AS INTEGER), 2))"
    each = f"CASE WHEN length({cjk}) > 0 AND length({cjk}) * 2 >= length(w) THEN list_concat(string_split({cjk}, ''), {pairs}) ELSE [lower(w)] END"
    return f"coalesce(flatten(list_transform({words}, lambda w: {each})), [])"


def _count(text: str) -> str:
    rest = f"regexp_replace({text}, '[{CJK}]', '', 'g')"
    return f"CAST(ceil(strlen({rest}) / 4.0) + ceil((length({text}) - length({rest})) / 1.4::DOUBLE) AS INTEGER)"


def _contains(text: str, phrases: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains({text}, '{p}') AS INTEGER)" for p in phrases)


def _key(url: str) -> str:
    host = f"regexp_replace(lower({_part(url, 2)}), '^(www\\.)+', '')"
    path = f"regexp_replace({_part(url, 4)}, '/+$', '')"
    tracked = ", ".join(f"'{t}'" for t in TRACKING)
    kept = f"list_sort(list_filter(string_split({_part(url, 5)}, '&'), lambda p: p <> '' AND NOT (split_part(p, '=', 1) IN ({tracked}))))"
    query = f"array_to_string({kept}, '&')"
    return f"CASE WHEN lower({_part(url, 1)}) IN ('http', 'https') AND {_part(url, 2)} <> '' THEN {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _tenth(value: str) -> str:
    """In ten thousandths, cut; the nudge keeps values that are exact in decimal on one side."""
    return f"CASE WHEN n > 0 THEN CAST(floor(({value}) * 10000 + 0.001) AS INTEGER) ELSE 0 END"


_STOP = ", ".join(f"'{w}'" for w in (*scoring.STOPWORDS_EN, *scoring.STOPWORDS_KO))
_UNITS = f"u AS (SELECT DISTINCT ON (source_id, unit_idx) source_id, unit_idx, {tokens_of('text')} AS tokens FROM units)"
_BM25 = f"""
{_UNITS},
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_of('q')}) AS term FROM queries) GROUP BY 1, 2),
s AS (SELECT count(*) AS n, greatest(1.0, avg(len(tokens))) AS avgdl FROM u),
tf AS (SELECT term, source_id, unit_idx, l, count(*) AS tf FROM (SELECT source_id, unit_idx, len(tokens) AS l, unnest(tokens) AS term FROM u) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (
  SELECT query_id, source_id, unit_idx, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgdl))) AS bm25
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2, 3
)"""
_SUFFIX = " ".join(
    f"WHEN ends_with(t, '{s}' || n) AND length(trim(substring(t, 1, length(t) - length('{s}' || n)))) >= 2 THEN trim(substring(t, 1, length(t) - length('{s}' || n)))"
    for s in TITLE_SEPARATORS
)


def _normal(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'))"



ORACLES: dict[str, str] = {
    "tokenize": f"SELECT source_id, unit_idx, array_to_string({tokens_of('text')}, ' ') AS words FROM units",
    "count_tokens": f"SELECT source_id, unit_idx, {_count('text')} AS n_tokens FROM units",
    "normalize_ws": f"SELECT source_id, unit_idx, md5({_normal('text')}) AS hash, CAST(length(text) AS INTEGER) AS chars FROM units",
    "strip_tags": "SELECT page_id, md5(regexp_replace(body, '<[^>]*(>|$)', '', 'g')) AS hash FROM pages",
    "defuse_headings": r"SELECT source_id, unit_idx, md5(regexp_replace(markdown, '(?m)^( {0,3})(#{1,2})( |$)', '\1\\\2\3', 'g')) AS hash FROM units",
    "escape_inline": r"SELECT source_id, unit_idx, md5(replace(replace(markdown, '[', '\['), ']', '\]')) AS hash FROM units",
    "code_fence": "SELECT source_id, unit_idx, repeat('`', greatest(coalesce(list_max(list_transform(regexp_extract_all(markdown, '`+'), lambda x: length(x))), 0), 2) + 1) AS fence FROM units",
    "slug_words": r"""
SELECT hit_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/]*/?', ''), '[/_.?&=-]'),
  lambda w: strlen(w) > 1 AND NOT regexp_matches(w, '^[0-9]+$')), ' ') AS words FROM searchresults
""",
    "canonical_url": f"SELECT hit_id, {_key('url')} AS key FROM searchresults",
    "valid_url": f"""
SELECT hit_id, lower({_part('url', 1)}) IN ('http', 'https') AND {_part('url', 2)} <> '' AS valid,
  CASE WHEN lower({_part('url', 1)}) IN ('http', 'https') AND {_part('url', 2)} <> '' THEN lower({_part('url', 1)}) || '://' || lower({_part('url', 2)})
    || CASE WHEN {_part('url', 3)} <> '' THEN ':' || {_part('url', 3)} ELSE '' END END AS origin
FROM searchresults
""",
    "strip_site_suffix": f"""
SELECT source_id, CASE WHEN n = '' OR n IS NULL THEN NULL {_SUFFIX} END AS head
FROM (SELECT source_id, {_normal('site_name')} AS n, concat_ws(' | ', title, site_name) AS t FROM articles)
""",
    "density": f"""
WITH u AS (SELECT source_id, unit_idx, text, {tokens_of('text')} AS w FROM units),
d AS (
  SELECT source_id, unit_idx, len(w) AS n, len(list_filter(w, lambda x: NOT (x IN ({_STOP})))) / len(w) AS c,
    len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / len(w) AS m, len(list_distinct(w)) / len(w) AS t, {_contains('lower(text)', scoring.BOILERPLATE)} AS h
  FROM u
)
SELECT source_id, unit_idx, {_tenth('c')} AS content_ratio, {_tenth('m')} AS numeric_ratio, {_tenth('t')} AS type_token_ratio,
  {_tenth('greatest(0, least(1, (0.45::DOUBLE * c + 0.30::DOUBLE * t + 0.25::DOUBLE * least(1.0, 3.0 * m)) * (1 - least(0.9::DOUBLE, 0.35::DOUBLE * h)) * (0.4::DOUBLE + 0.6::DOUBLE * least(1.0, n / 12.0))))')} AS score,
  CASE WHEN n > 0 THEN h ELSE 0 END AS boilerplate_hits
FROM d
""",
    "boilerplate_hits": f"SELECT source_id, unit_idx, {_contains('lower(text)', scoring.BOILERPLATE)} AS hits FROM units",
    "bm25_idf": f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, s WHERE term IN (SELECT term FROM q)",
    "bm25_scores": f"WITH {_BM25} SELECT query_id, source_id, unit_idx, round(bm25, 6) AS bm25 FROM b",
    "bm25_topk": f"""
WITH {_BM25} SELECT query_id, CAST(r - 1 AS INTEGER) AS rank, round(bm25, 5) AS bm25
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, source_id, unit_idx) AS r FROM b) WHERE r <= 10
""",
    "rrf_fuse": f"""
WITH h AS (SELECT * FROM (SELECT DISTINCT ON (hit_id) *, {_key('url')} AS key FROM searchresults) WHERE key IS NOT NULL),
g AS (
  SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank, min((provider_pos, rank)) AS arrival, arg_min(url, (provider_pos, rank)) AS url,
    coalesce(arg_min(title, (provider_pos, rank)) FILTER (coalesce(title, '') <> ''), '') AS title,
    arg_max(coalesce(snippet, ''), (strlen(coalesce(snippet, '')), -provider_pos, -rank)) AS snippet,
    list(provider ORDER BY provider_pos, rank) AS p
  FROM h GROUP BY 1, 2
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, arrival, key) - 1 AS position FROM g)
SELECT query_id, key, url, title, snippet, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS providers, round(score, 9) AS score, best_rank, CAST(position AS INTEGER) AS position
FROM o WHERE position < 10
""",
    "scholarly_snippet": f"""
WITH a AS (
  SELECT source_id, coalesce(byline, '') || CASE WHEN y <> '' THEN ' (' || y || ')' ELSE '' END AS head, coalesce(description, '') AS body
  FROM (SELECT *, regexp_extract(coalesce(published, ''), '^([0-9]+)', 1) AS y FROM articles)
)
SELECT source_id, {_normal("head || CASE WHEN head <> '' AND body <> '' THEN '. ' ELSE '' END || body")} AS snippet FROM a
""",
    "slim_candidates": """
SELECT source_id, count(*) AS units_considered FROM units
WHERE (kind IN ('heading', 'code') OR length(text) >= 24) AND coalesce(markdown, '') <> '' GROUP BY 1
""",
    "overlap_pairs": f"""
WITH {_UNITS}, p AS (SELECT source_id, unit_idx, tokens AS b, lag(tokens) OVER (PARTITION BY source_id ORDER BY unit_idx) AS a FROM u)
SELECT source_id, unit_idx, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(CASE WHEN len(a) <= len(b) THEN a ELSE b END)), 6) END AS overlap
FROM p WHERE a IS NOT NULL
""",
    "cosine_topk": """
WITH c AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS cosine
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(r - 1 AS INTEGER) AS rank, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM c) WHERE r <= 10
""",
    "fetchable": r"SELECT page_id, (content_type IS NULL OR regexp_matches(lower(content_type), '^\s*(text/|application/(xhtml\+xml|xml|rss\+xml|atom\+xml|json|ld\+json))')) AND coalesce(strlen(body), 0) <= 8388608 AS fetchable FROM pages",
    "retryable": "SELECT page_id, coalesce(status IN (408, 425, 429, 500, 502, 503, 504), true) AS retry FROM pages",
    "crawl_schedule": f"""
SELECT url, host, round((row_number() OVER (PARTITION BY host ORDER BY url) - 1) * 0.25::DOUBLE, 3) AS start_offset_s
FROM (SELECT DISTINCT url, lower({_part('url', 2)}) AS host FROM pages)
""",
    "robots_allowed": f"""
WITH p AS (SELECT page_id, CASE WHEN {_part('final_url', 4)} = '' THEN '/' ELSE {_part('final_url', 4)} END AS path, {_part('final_url', 2)} AS host FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/docs/b') THEN true WHEN starts_with(path, '/docs/') THEN false WHEN regexp_matches(path, '^/.*/m.*$') THEN false ELSE true END AS allowed FROM p
""",
    "parse_hits": f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider_pos ORDER BY rank, CAST(hit_id AS VARCHAR)) - 1 AS r FROM (SELECT DISTINCT ON (hit_id) * FROM searchresults) WHERE url <> '')
SELECT query_id, provider_pos, CAST(r AS INTEGER) AS rank, CASE WHEN provider_pos % 2 = 0 THEN 'searxng' ELSE 'hackernews' END AS provider, {_normal("coalesce(title, '')")} AS title, url FROM h
""",
    "sitemap_urls": "SELECT final_url AS url FROM (SELECT DISTINCT ON (page_id) * FROM pages)",
    "furniture_hits": f"SELECT source_id, {' + '.join(f'CAST(text ILIKE $$%{p}%$$ AS INTEGER)' for p in FURNITURE)} AS hits FROM articles",
    "token_cost": f"""
WITH s AS (
  SELECT source_id, string_agg(markdown, chr(10) || chr(10) ORDER BY unit_idx) AS slim FROM (SELECT DISTINCT ON (source_id, unit_idx) * FROM units)
  WHERE (kind IN ('heading', 'code') OR length(text) >= 24) AND coalesce(markdown, '') <> '' GROUP BY 1
)
SELECT a.source_id, {_count('body')} AS raw, {_count('markdown')} AS units, {_count("coalesce(slim, '')")} AS slim
FROM (SELECT DISTINCT ON (page_id) * FROM pages) p JOIN (SELECT DISTINCT ON (source_id) * FROM articles) a ON page_id = source_id LEFT JOIN s ON s.source_id = a.source_id
""",
    "page_meta": r"""
SELECT page_id, nullif(trim(regexp_extract(body, '<html[^>]* lang="([^"]*)"', 1)), '') AS language,
  nullif(trim(regexp_replace(regexp_extract(body, '<meta property="og:site_name" content="([^"]*)"', 1), '[\s\x{A0}]+', ' ', 'g')), '') AS site_name
FROM pages
""",
}
