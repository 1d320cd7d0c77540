"""Problem 5: token totals per site, domain and language.

Units are recounted with the project's own estimate (``miscounted``). Totals under a byte-pair
vocabulary of a public tokenizer come from ``merge_totals``: texts are split once into pieces, pieces are
counted per slice before anything is shuffled, and distinct pieces are stored as arrays of symbols, whose
adjacent pairs are joined with the table of merge ranks, again and again: every piece applies
its lowest-ranked merge each round until none has any. The work follows the number of distinct
pieces, not of texts.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import count_tokens
from skein.llm.repeated_lines import site_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_RANKS = 500_000
HELD_PIECES = 200_000
#: The pre-split of public byte-level vocabularies.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def miscounted(units: DataFrame) -> DataFrame:
    """Distinct (source_id, unit_idx) whose ``tokens`` is null or isn't the count of their ``markdown``.

    A null markdown counts as no tokens. Duplicate rows come out once.
    """
    count = F.coalesce(count_tokens(F.col("markdown")), F.lit(0))
    wrong = units.where(F.col("tokens").isNull() | (F.col("tokens") != count))
    return wrong.select("source_id", "unit_idx").distinct()


class Merges(NamedTuple):
    """Merge ranks as sorted arrays: what is sent to the workers, bounded by MAX_RANKS."""

    single: np.ndarray  # symbol of each byte
    keys: np.ndarray  # left symbol * 2^32 + right symbol, ascending
    ranks: np.ndarray  # rank, which is also the merged symbol
    whole: frozenset[bytes]


def load_merges(path: str = VOCABULARY) -> Merges:
    """A tiktoken rank file as a table of pairs: every way to put a vocabulary entry together from two others."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"more than {MAX_RANKS} ranks")
    pairs = {
        (ranks[t[:i]] << 32) | ranks[t[i:]]: r
        for t, r in ranks.items()
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    }
    keys = np.array(sorted(pairs), np.int64)
    return Merges(np.array([ranks[bytes([b])] for b in range(256)], np.int64), keys, np.array([pairs[k] for k in keys.tolist()], np.int64), frozenset(ranks))


def merge(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Token counts of pieces.

    One round joins all adjacent pairs of all unfinished pieces with the ranks, finds each piece's
    lowest rank and merges its occurrences, leftmost first where they overlap. A merged symbol's own
    pairs rank higher than it, so merging all occurrences at once gives what one at a time would.
    """
    out = np.array([1 if p in merges.whole else len(p) for p in pieces], np.int64)
    ids = np.flatnonzero(out > 1)
    if not len(ids):
        return out
    symbols = merges.single[np.frombuffer(b"".join(pieces[i] for i in ids.tolist()), np.uint8)]
    piece = np.repeat(ids, out[ids])
    none = np.int64(1 << 40)
    while len(symbols):
        inner = piece[:-1] == piece[1:]
        key = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        rank = np.where(inner & (merges.keys[at] == key), merges.ranks[at], none)
        rank = np.append(rank, none)  # the last symbol has no right neighbour
        starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        sizes = np.diff(np.append(starts, len(piece)))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        out[piece[starts]] = sizes
        hit = (rank == least) & (rank < none)
        run = np.flatnonzero(hit)
        if not len(run):
            break
        # Overlapping occurrences form runs of positions: every other one merges.
        new_run = np.append(True, np.diff(run) > 1)
        first = np.maximum.accumulate(np.where(new_run, run, 0))
        run = run[(run - first) % 2 == 0]
        symbols = symbols.copy()
        symbols[run] = rank[run]
        keep = least < none  # pieces without a pair are done
        keep[run + 1] = False
        symbols, piece = symbols[keep], piece[keep]
        if len(piece):
            out[piece[np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))]] = 0
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            out[piece[starts]] = np.diff(np.append(starts, len(piece)))
    return out


def piece_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, piece binary, n): occurrences of each pre-split piece per key; null texts give none.

    Counts are combined inside each task first, in a table of bounded size.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", piece binary, n long"
    names = [*keys, "piece", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PRE_SPLIT).findall
        held: dict[tuple, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(k, p, n) for k, c in held.items() for p, n in c.items()]
            held.clear()
            columns = [pa.array([r[0][i] for r in rows], pa.string()) for i in range(len(keys))]
            columns += [pa.array([r[1].encode("utf-8", "surrogatepass") for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for row in zip(*columns):
                if row[-1]:
                    held.setdefault(row[:-1], Counter()).update(find(row[-1]))
            if sum(map(len, held.values())) > HELD_PIECES:
                yield flush()
        yield flush()

    found = texts.select(*(F.col(k).cast("string").alias(k) for k in keys), text).mapInArrow(run, schema)
    return found.groupBy(*keys, "piece").agg(F.sum("n").alias("n"))


def merge_counts(pieces: DataFrame, merges: Merges) -> DataFrame:
    """(piece, tokens) of distinct ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merge(batch.column(0).to_pylist(), merges), pa.int64())], names=["piece", "tokens"])

    return pieces.select("piece").distinct().mapInArrow(run, "piece binary, tokens long")


def slices(pages: DataFrame, languages: DataFrame) -> DataFrame:
    """(source_id, site, domain, lang) of every article in ``languages`` (source_id, lang).

    The site is the host of final_url, the domain its last two labels; an article without page or host
    has both empty. What pages and articles state of language and site name isn't used.
    """
    host = pages.select(F.col("page_id").alias("source_id"), site_of(F.col("final_url")).alias("site")).groupBy("source_id").agg(F.min("site").alias("site"))
    labels = F.split("site", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    joined = languages.select("source_id", F.coalesce("lang", F.lit("")).alias("lang")).join(host, "source_id", "left")
    return joined.select("source_id", F.coalesce("site", F.lit("")).alias("site"), F.coalesce(domain, F.lit("")).alias("domain"), "lang")


def merge_totals(units: DataFrame, slice_of: DataFrame, merges: Merges) -> DataFrame:
    """(site, domain, lang, tokens): totals of the units' markdown under a byte-pair vocabulary, each unit once."""
    keys = ["site", "domain", "lang"]
    own = units.select("source_id", "unit_idx", "markdown").dropDuplicates(["source_id", "unit_idx"]).join(slice_of, "source_id")
    counted = piece_counts(own, keys, "markdown")
    return counted.join(merge_counts(counted, merges), "piece").groupBy(*keys).agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"))


def estimate_totals(units: DataFrame, slice_of: DataFrame) -> DataFrame:
    """(site, domain, lang, articles, tokens): totals of the project's own count, each unit and article of ``slice_of`` once."""
    own = units.select("source_id", "unit_idx", F.coalesce(count_tokens(F.col("markdown")), F.lit(0)).alias("n")).dropDuplicates(["source_id", "unit_idx"])
    per = slice_of.join(own.groupBy("source_id").agg(F.sum("n").alias("n")), "source_id", "left")
    return per.groupBy("site", "domain", "lang").agg(F.count("*").alias("articles"), F.sum(F.coalesce("n", F.lit(0))).alias("tokens"))
