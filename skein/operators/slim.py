"""A token-budgeted, cited context per query.

Everything that depends on one unit is native; only the greedy choice, where each pick depends on
those before, and the rendering run in Python, once per query over that query's few sources. Units
that could never be picked are dropped natively before.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import CJK, count_tokens, python_class
from skein.operators.ranking import score_units

UNIT_OVERHEAD = 4


@dataclass(frozen=True)
class SlimConfig:
    """Options of :func:`slim`; all have the usual defaults."""

    max_tokens: int = 2048
    diversity: float = 0.35
    min_score: float = 0.02
    min_density: float = 0.10
    dedupe_threshold: float = 0.80
    max_tokens_per_source: int | None = None
    include_breadcrumbs: bool = True
    mark_elisions: bool = True
    semantic_weight: float = 0.5

    def __post_init__(self) -> None:
        if not (0 <= self.diversity <= 1 and 0 <= self.semantic_weight <= 1):
            raise ValueError("diversity and semantic_weight must lie in [0, 1]")
        if self.max_tokens < 0:
            raise ValueError("max_tokens must not be negative")


_CJK = re.compile(f"[{python_class(CJK)}]")


def estimate(text: str) -> int:
    """The token estimate of ``functions.text.count_tokens``, for text made in Python."""
    rest, cjk = (text, 0) if text.isascii() else _CJK.subn("", text)
    return -(-len(rest.encode("utf-8", "surrogatepass")) // 4) + math.ceil(cjk / 1.4)


def choose(rows: pd.DataFrame, cfg: SlimConfig) -> list[int]:
    """Positions in ``rows`` (ordered by source and unit) picked by maximal marginal relevance under the budget.

    Similarity to the picks so far is kept per unit and raised by the last pick only, so the work is
    picks times candidates.
    """
    n = len(rows)
    ids: dict[str, int] = {}
    lists = [[ids.setdefault(t, len(ids)) for t in terms] for terms in rows["terms"]]
    sets = [frozenset(x) for x in lists]
    lengths = [len(x) for x in lists]
    base, tokens = rows["base"].to_numpy(float), rows["tokens"].to_numpy(np.int64)
    sources = rows["source_id"].tolist()
    overhead = dict(zip(sources, rows["overhead"].tolist()))
    alike = np.zeros(n)
    open_ = np.ones(n, bool)
    spent = 0
    per_source: dict[int, int] = {}
    picked: list[int] = []
    while True:
        extra = np.array([0 if s in per_source else overhead[s] for s in sources], np.int64) + UNIT_OVERHEAD
        fits = open_ & (spent + tokens + extra <= cfg.max_tokens)
        if cfg.max_tokens_per_source is not None:
            room = np.array([per_source.get(s, 0) for s in sources], np.int64)
            fits &= room + tokens <= cfg.max_tokens_per_source
        value = np.where(fits, base - cfg.diversity * alike, -np.inf)
        if not n or value.max() < cfg.min_score:
            return picked
        best = int(value.argmax())  # the first of equals
        spent += int(tokens[best] + extra[best])
        per_source[sources[best]] = per_source.get(sources[best], 0) + int(tokens[best])
        open_[best] = False
        picked.append(best)
        for i in np.flatnonzero(open_):
            if sets[i] and sets[best]:
                small = sets[i] if lengths[i] <= lengths[best] else sets[best]
                alike[i] = max(alike[i], len(sets[i] & sets[best]) / len(small))
        open_ &= alike < cfg.dedupe_threshold


def render(rows: list[dict], cfg: SlimConfig) -> tuple[str, list[dict], list[dict]]:
    """(markdown, selected rows, sources) of picked rows in order of source and unit."""
    sections, selected, sources = [], [], []
    for source in dict.fromkeys(r["source_id"] for r in rows):
        own = [r for r in rows if r["source_id"] == source]
        title, url = own[0]["title"], own[0]["url"]
        shown = title or "Untitled"
        parts = [f"## {shown}" + (f"\n<{url}>" if url else "")]
        path, before, body = [shown], None, False
        for r in own:
            trail = list(r["heading_path"]) if r["heading_path"] is not None else []
            heading = r["kind"] == "heading"
            if heading and not trail and title is not None and r["text"] == title:
                before = r["unit_idx"]
                continue
            if cfg.mark_elisions and before is not None and r["unit_idx"] > before + 1:
                parts.append("[…]")
            if cfg.include_breadcrumbs and not heading and trail and trail != path:
                parts.append(f"**{' › '.join(trail)}**")
                path = trail
            if heading:
                parts.append(f"{'#' * min(6, int(r['level']) + 2)} {r['text']}")
                path = [*trail, r["text"]]
            else:
                parts.append(r["markdown"])
            before, body = r["unit_idx"], True
        if body:  # a source that shows nothing but its title isn't cited
            sections.append("\n\n".join(parts).strip())
            selected += own
            sources.append({"source_id": source, "url": url, "title": title, "tokens": int(sum(r["tokens"] for r in own))})
    return "\n\n".join(sections).strip(), selected, sources


SCHEMA = (
    "query_id long, markdown string, tokens int, units_considered int,"
    " selected array<struct<source_id:long,unit_idx:int,score:double,relevance:double,density:double,tokens:int>>,"
    " sources array<struct<source_id:long,url:string,title:string,tokens:int>>"
)


def slim(units: DataFrame, queries: DataFrame, cfg: SlimConfig = SlimConfig(), vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """One context per query that has units; an empty one where none of them can be picked.

    ``units``: query_id, source_id, unit_idx, kind, level, text, markdown, heading_path, tokens, title, url.
    """
    scored = score_units(units, queries, cfg.semantic_weight, vectors, query_vectors)
    header = F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n<"), F.coalesce("url", F.lit("")), F.lit(">"))
    scored = scored.withColumn("overhead", count_tokens(header) + 2).withColumn("query_id", F.col("query_id").cast("long"))
    # What the loop could never pick, whatever it picked before; one row stays so that the query does.
    hopeless = (
        (F.col("base") < cfg.min_score)
        | (F.col("boilerplate") >= 2)
        | ((F.col("kind") != "heading") & (F.col("density") < cfg.min_density))
        | (F.col("tokens") + UNIT_OVERHEAD > cfg.max_tokens)
    )
    columns = ["query_id", "source_id", "unit_idx", "kind", "level", "text", "markdown", "heading_path", "tokens", "title", "url", "terms", "base", "relevance", "density", "overhead", "units_considered"]
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(hopeless, "source_id", "unit_idx")) == 1
    kept = scored.withColumn("hopeless", hopeless).withColumn("first", first).where(F.col("first") | ~F.col("hopeless")).select(*columns, "hopeless")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        considered = int(group["units_considered"].iloc[0])
        group = group[~group["hopeless"]].sort_values(["source_id", "unit_idx"], kind="stable").reset_index(drop=True)
        rows = [group.iloc[i].to_dict() for i in sorted(choose(group, cfg))]
        text, selected, sources = render(rows, cfg)
        while rows and estimate(text) > cfg.max_tokens:  # the estimate of the scaffolding was short: the weakest goes
            rows.remove(min(rows, key=lambda r: r["base"]))
            text, selected, sources = render(rows, cfg)
        chosen = [{"source_id": int(r["source_id"]), "unit_idx": int(r["unit_idx"]), "score": float(r["base"]), "relevance": float(r["relevance"]), "density": float(r["density"]), "tokens": int(r["tokens"])} for r in selected]
        return pd.DataFrame([{"query_id": int(key[0]), "markdown": text, "tokens": estimate(text), "units_considered": considered, "selected": chosen, "sources": sources}])

    return kept.groupBy("query_id").applyInPandas(run, SCHEMA)
