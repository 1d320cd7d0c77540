"""Units of an article packed into chunks of a target size, never splitting a unit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "source_id long, chunk_idx int, first_unit int, url string, title string, heading_path array<string>, markdown string, text string, tokens int, units array<int>"


def runs(tokens: list[int], headings: list[bool], target: int, overlap: int) -> list[list[int]]:
    """Positions of each chunk: a new one starts at a heading or when the next unit would pass the target.

    A chunk begins with the last whole units of the one before, up to ``overlap`` tokens.
    """
    out: list[list[int]] = []
    run: list[int] = []
    size = 0
    for i, n in enumerate(tokens):
        if run and (headings[i] or size + n > target):
            out.append(run)
            kept, total = [], 0
            for j in reversed(run):
                if overlap <= 0 or total + tokens[j] > overlap:
                    break
                kept.insert(0, j)
                total += tokens[j]
            run, size = kept, total
        run = [*run, i]
        size += n
    return [*out, run] if run else out


def chunk(units: DataFrame, target_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 24) -> DataFrame:
    """One row per chunk of each source; chunks under ``min_tokens`` are dropped unless nothing else is left.

    ``units``: source_id, unit_idx, kind, text, markdown, heading_path, tokens (null counts as 0) and, where a
    chunk is to be cited, url and title, which are null otherwise.
    """
    if target_tokens <= 0 or overlap_tokens >= target_tokens or overlap_tokens < 0:
        raise ValueError("target_tokens must be positive and overlap_tokens smaller than it")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("unit_idx", kind="stable")
        tokens = g["tokens"].fillna(0).astype(int).tolist()
        every = runs(tokens, (g["kind"] == "heading").tolist(), target_tokens, overlap_tokens)
        kept = [r for r in every if sum(tokens[i] for i in r) >= min_tokens] or [list(range(len(g)))]
        index, paths, markdown, text = (g[c].tolist() for c in ("unit_idx", "heading_path", "markdown", "text"))
        url, title = g["url"].iloc[0], g["title"].iloc[0]
        return pd.DataFrame(
            {
                "source_id": int(key[0]),
                "chunk_idx": n,
                "first_unit": index[r[0]],
                "url": url,
                "title": title,
                "heading_path": paths[r[0]],
                "markdown": "\n\n".join(markdown[i] or "" for i in r),
                "text": "\n".join(text[i] or "" for i in r),
                "tokens": sum(tokens[i] for i in r),
                "units": [index[i] for i in r],
            }
            for n, r in enumerate(kept)
        )

    columns = ["source_id", "unit_idx", "kind", "text", "markdown", "heading_path", "tokens"]
    cited = [(F.col(c) if c in units.columns else F.lit(None)).cast("string").alias(c) for c in ("url", "title")]
    return units.select(*columns, *cited).withColumn("source_id", F.col("source_id").cast("long")).groupBy("source_id").applyInPandas(run, SCHEMA)
