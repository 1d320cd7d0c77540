"""DuckDB statements that give what a query of this package gives, where SQL can say it."""

from __future__ import annotations

from skein.functions.text import CJK, SPACE


def _tokens(column: str) -> str:
    rest = f"regexp_replace({column}, '[{CJK}]', '', 'g')"
    return f"CAST(ceil(strlen({rest}) / 4.0) + ceil((length({column}) - length({rest})) / 1.4::DOUBLE) AS INTEGER)"


def _source(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '')"


ORACLES: dict[str, str] = {
    "p4_found": f"""
SELECT DISTINCT c.config_id, u.source_id, u.unit_idx
FROM (SELECT source_id, unit_idx, {_tokens('text')} AS n FROM units) u, chunkconfig c
WHERE u.n > c.target_tokens
""",
    "p5_found": f"""
SELECT DISTINCT source_id, unit_idx FROM units
WHERE tokens IS NULL OR tokens <> {_tokens('markdown')}
""",
    "p8_found": f"""
SELECT DISTINCT c.pack_id, d.doc_id
FROM (SELECT doc_id, {_tokens('text')} AS n FROM documents) d, packconfig c
WHERE d.n > c.capacity_tokens
""",
    "p9_found": f"""
WITH totals AS (
  SELECT {_source('source')} AS src, sum({_tokens('text')}) AS n FROM documents GROUP BY 1
), t AS (
  SELECT m.*, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY mix_id) AS total
  FROM mixtargets m LEFT JOIN totals ON {_source('m.source')} = totals.src
)
SELECT mix_id, source FROM t WHERE n * max_repeats < target_weight * total
""",
}
