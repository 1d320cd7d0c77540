"""Problem 4: items over a size limit, cut at natural boundaries with an overlap.

Sizes are found natively; only oversized items reach Python, in Arrow batches, so the cost follows
the oversized text and not the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import CJK, count_tokens, python_class

#: The separator hierarchy, coarsest first: sections, paragraphs, lines, sentences, words. A cut comes
#: right behind a match; below words every character is a cut.
SEPARATORS = (
    re.compile(r"\n[ \t]*\n(?=#{1,6} )|\n(?=#{1,6} )|\f"),
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*"),
    re.compile(r"\s+|[,，、;；]"),
)
_CJK = re.compile(f"[{python_class(CJK)}]")
MAX_CONFIGS = 1000


class Sizer:
    """Token counts of any span of a text in constant time."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        cjk = np.zeros(len(codes), dtype=bool)
        for m in _CJK.finditer(text):
            cjk[m.start()] = True
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        self.bytes = np.concatenate(([0], np.cumsum(np.where(cjk, 0, width)))).tolist()
        self.cjk = np.concatenate(([0], np.cumsum(cjk))).tolist()

    def __call__(self, a: int, b: int) -> int:
        return -(-(self.bytes[b] - self.bytes[a]) // 4) + int(np.ceil((self.cjk[b] - self.cjk[a]) / 1.4))


def _atoms(text: str, a: int, b: int, limit: int, level: int, size: Sizer, out: list[int]) -> None:
    """Append the ends of consecutive spans of [a, b) that are each within ``limit``."""
    if size(a, b) <= limit:
        out.append(b)
        return
    if level == len(SEPARATORS):
        while a < b:  # the longest run of characters that fits, by bisection; at least one character
            low, high = a + 1, b
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if size(a, mid) <= limit else (low, mid - 1)
            out.append(low)
            a = low
        return
    start = a
    for m in SEPARATORS[level].finditer(text, a, b):
        if start < m.end() < b:
            _atoms(text, start, m.end(), limit, level + 1, size, out)
            start = m.end()
    _atoms(text, start, b, limit, level + 1, size, out)


def pieces(text: str, limit: int, overlap: int, least: int = 0) -> list[tuple[int, int]]:
    """Spans (start, end) that cover ``text``, each of at most ``limit`` tokens.

    A span repeats the end of the one before, up to ``overlap`` tokens, from a natural boundary.
    New text per span is at most limit - overlap, so every span moves on; a last span of fewer than
    ``least`` tokens reaches further back while it fits. A character larger than the limit stands alone.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than it")
    size = Sizer(text)
    if size(0, len(text)) <= limit:
        return [(0, len(text))]
    ends: list[int] = []
    _atoms(text, 0, len(text), max(1, limit - overlap), 0, size, ends)
    words = [0, *(m.end() for m in SEPARATORS[-1].finditer(text))]
    out: list[tuple[int, int]] = []
    done = at = 0
    while at < len(ends):
        start = done
        if out and overlap:
            start = _back(words, size, out[-1][0] + 1, done, overlap)
        while at < len(ends) and (ends[at] == done or size(start, ends[at]) <= limit):
            at += 1
        new = ends[at - 1] if at and ends[at - 1] > done else 0
        if not new:  # the overlap leaves no room: this span starts without one
            start, new = done, ends[at]
            at += 1
        if at == len(ends) and out and size(start, new) < least:
            start = min(start, _back(words, size, out[-1][0] + 1, new, min(limit, max(least, overlap))))
        out.append((start, new))
        done = new
    return out


def _back(words: list[int], size: Sizer, low: int, end: int, most: int) -> int:
    """The earliest word start in [low, end] from which at most ``most`` tokens remain until ``end``."""
    import bisect

    i, j = bisect.bisect_left(words, low), bisect.bisect_right(words, end)
    while i < j:
        mid = (i + j) // 2
        i, j = (i, mid) if size(words[mid], end) <= most else (mid + 1, j)
    if i < len(words) and low <= words[i] < end:
        return words[i]
    a, b = min(low, end), end  # one long word: cut by character
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if size(mid, end) <= most else (mid + 1, b)
    return a


def split_oversized(items: DataFrame, configs: DataFrame, keys: tuple[str, ...] = ("source_id", "unit_idx")) -> DataFrame:
    """Pieces of every item whose ``text`` counts more tokens than a config's ``target_tokens``.

    ``configs``: config_id, target_tokens, overlap_tokens, min_tokens; at most MAX_CONFIGS rows, which
    is checked. Result: config_id, the keys, tokens (of the whole), piece_idx, start_char, end_char
    (code points), piece_tokens, piece. Null and fitting texts give no rows; duplicate items (same keys)
    count once; other columns are ignored; an overlap not below the target counts as none.
    """
    rows = configs.select("config_id", "target_tokens", "overlap_tokens", "min_tokens").distinct().limit(MAX_CONFIGS + 1).collect()
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configs")
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[1] > 0]
    spark = items.sparkSession
    names = ("config_id", "target_tokens", "overlap_tokens", "min_tokens")
    if not rows:
        rows_array = F.array().cast("array<struct<config_id:int,target_tokens:int,overlap_tokens:int,min_tokens:int>>")
    else:
        rows_array = F.array(*(F.struct(*(F.lit(v).cast("int").alias(n) for n, v in zip(names, r))) for r in rows))
    lowest = min((r[1] for r in rows), default=0)
    sized = items.select(*keys, "text").withColumn("tokens", count_tokens(F.col("text")))
    sized = sized.where(F.col("tokens") > lowest).dropDuplicates(list(keys))
    big = (
        sized.withColumn("c", F.explode(rows_array))
        .where(F.col("tokens") > F.col("c.target_tokens"))
        .select("c.*", *keys, "tokens", "text")
    )
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in big.schema if f.name in keys)
    schema = f"config_id int, {given}, tokens int, piece_idx int, start_char int, end_char int, piece_tokens int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                overlap = 0 if pd.isna(r.overlap_tokens) else max(0, int(r.overlap_tokens))
                least = 0 if pd.isna(r.min_tokens) else max(0, int(r.min_tokens))
                limit = int(r.target_tokens)
                size = Sizer(r.text)
                for i, (a, b) in enumerate(pieces(r.text, limit, overlap if overlap < limit else 0, least)):
                    out.append((r.config_id, *(getattr(r, k) for k in keys), r.tokens, i, a, b, size(a, b), r.text[a:b]))
            yield pd.DataFrame(out, columns=["config_id", *keys, "tokens", "piece_idx", "start_char", "end_char", "piece_tokens", "piece"])

    # Few large items may come out of one input split: spread them before the Python stage.
    return big.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, schema)
