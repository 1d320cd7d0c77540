"""Problem 8: filling containers of fixed capacity.

Only the histogram of sizes (at most ``capacity`` numbers) reaches the driver. There shallow
combinations of lengths that fill a window just under the capacity are enumerated, non-negative
least squares solves how often each is used, weak combinations are dropped and the rest solved again until
repeats exceed one, and repeats are rounded; this is done again with what is left of the histogram while it
places a fair part of it. The residual is packed greedily, again as repeated combinations. The documents themselves are numbered
within their size, by hashed sub-ranges so that no size is ever one task's work, and look up their
container from the combinations; nothing per document is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import count_tokens

MAX_CONFIGS = 1000
#: Spans of sizes that are broadcast at most; more are joined by a shuffle.
MAX_SPANS = 1_000_000
#: Passes of enumerating and solving, and the share of the remaining weight that a pass must place for another.
PASSES, FAIR_SHARE = 12, 0.02
SUB_RANGES = 256

Pattern = tuple[int, dict[int, int]]  # (containers, {size: items per container})


def _combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, lengths: int, slack: int) -> list[dict[int, int]]:
    """Combinations of at most three lengths, two of them repeatable, that fill the window."""
    weight = np.cumsum(sizes * counts)
    at = np.searchsorted(weight, np.linspace(0, weight[-1], lengths, endpoint=False), side="right")
    chosen = np.unique(sizes[np.minimum(at, len(sizes) - 1)])[::-1].tolist()
    exists = set(sizes.tolist())
    out: list[dict[int, int]] = []
    for i in chosen:
        top = capacity // i
        for a in sorted({*range(1, min(top, 4) + 1), *(2**k for k in range(2, 14) if 2**k <= top), top}):
            rest = capacity - a * i
            if rest <= slack:
                out.append({i: a})
                continue
            if rest in exists and rest != i:
                out.append({i: a, rest: 1})
            for j in chosen:
                if j >= i or j > rest:
                    continue
                b = rest // j
                gap = rest - b * j
                if gap <= slack:
                    out.append({i: a, j: b})
                elif gap in exists and gap not in (i, j):
                    out.append({i: a, j: b, gap: 1})
    return out


def _nnls(combos: list[dict[int, int]], capacity: int, histogram: np.ndarray, rounds: int) -> np.ndarray:
    """min |A x - h| over x >= 0, by multiplicative updates (A and h are non-negative); size-weighted."""
    column = np.array([c for c, m in enumerate(combos) for _ in m])
    row = np.array([s for m in combos for s in m])
    value = np.array([n for m in combos for n in m.values()], dtype=float)
    scale = np.sqrt(np.arange(capacity + 1) / capacity)
    value *= scale[row]
    goal = histogram * scale
    x = np.full(len(combos), max(1e-9, goal.sum() / max(1.0, value.sum())))
    top = np.bincount(column, value * goal[row], len(combos))
    for _ in range(rounds):
        fit = np.bincount(row, value * x[column], capacity + 1)
        x *= top / np.maximum(np.bincount(column, value * fit[row], len(combos)), 1e-12)
    return x


def _solved(combos: list[dict[int, int]], capacity: int, h: np.ndarray, rounds: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Combinations and repeats: least squares again on the stronger half until most of the weight repeats at least once."""
    while True:
        x = _nnls(combos, capacity, h.astype(float), rounds)
        if len(combos) <= 8 or x[x >= 1].sum() >= 0.8 * x.sum():
            return combos, x
        best = np.argsort(-x, kind="stable")[: (len(combos) + 1) // 2]
        combos = [combos[i] for i in np.sort(best)]


def plan_containers(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Combinations and how many containers use each; together they hold the whole histogram.

    Sizes must lie in 1..capacity.
    """
    solved, rest = plan_parts(histogram, capacity)
    return solved + rest


def plan_parts(histogram: dict[int, int], capacity: int, lengths: int = 64, rounds: int = 100) -> tuple[list[Pattern], list[Pattern]]:
    """The plan's patterns that come from least squares, and those of the greedy rest."""
    h = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        h[s] += n
    weight = np.arange(capacity + 1)
    out: list[Pattern] = []
    for _ in range(PASSES):
        sizes = np.flatnonzero(h)
        combos = _combinations(sizes, h[sizes], capacity, lengths, slack=capacity // 256) if len(sizes) else []
        combos = [c for c in combos if all(h[s] >= k for s, k in c.items())]
        if not combos:
            break
        before = int(h @ weight)
        combos, x = _solved(combos, capacity, h, rounds)
        for c in np.argsort(-x, kind="stable"):
            if x[c] < 0.5:
                break
            n = min(int(x[c] + 0.5), *(int(h[s]) // k for s, k in combos[c].items()))
            if n:
                out.append((n, combos[c]))
                for s, k in combos[c].items():
                    h[s] -= n * k
        if before - int(h @ weight) < FAIR_SHARE * before:
            break
    solved, out = out, []
    left = np.flatnonzero(h)[::-1].tolist()
    while left:  # largest first; the same container as often as the counts allow
        rest, combo = capacity, {}
        for s in left:
            if s <= rest:
                k = min(int(h[s]), rest // s)
                combo[s] = k
                rest -= k * s
                if not rest:
                    break
        n = min(int(h[s]) // k for s, k in combo.items())
        out.append((n, combo))
        for s, k in combo.items():
            h[s] -= n * k
        left = [s for s in left if h[s]]
    return solved, out


def pack(documents: DataFrame, configs: DataFrame) -> DataFrame:
    """Every document in a container: pack_id, doc_id, part_idx, parts, part_tokens, container_id.

    A text within the capacity is one part. A larger one is cut, as little as possible: full parts that
    each fill a container of their own and a remainder that is packed like any other item (``parts``
    above 1 marks it). Texts of no tokens (empty or null) take no room and come out with container_id
    null and no parts. doc_id is taken as unique; repeated rows are packed as often as they occur.
    ``configs`` (pack_id, capacity_tokens) may have at most MAX_CONFIGS rows, which is checked.
    """
    rows = configs.select("pack_id", "capacity_tokens").distinct().limit(MAX_CONFIGS + 1).collect()
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configs")
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[1] > 0]
    spark = documents.sparkSession
    kinds = "array<struct<pack_id:int,capacity:int>>"
    caps = F.array(*(F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for p, c in rows)) if rows else F.array().cast(kinds)
    sized = documents.select("doc_id", F.coalesce(count_tokens(F.col("text")), F.lit(0)).alias("tokens"))
    items = sized.withColumn("c", F.explode(caps)).select("c.*", "doc_id", "tokens")
    items = items.withColumn("full", F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))
    items = items.withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity"))
    # The sub-range is a hash of the row, so numbering inside (pack, size, sub-range) is the same after a retry.
    items = items.withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(SUB_RANGES)).cast("int"))
    placed = items.where("tokens > 0")
    counts = placed.groupBy("pack_id", "size", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack_id", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pack_id", "size", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    histograms: dict[int, dict[int, int]] = {}
    for p, s, n in counts.groupBy("pack_id", "size").agg(F.sum("n")).collect():  # at most the sum of the capacities
        histograms.setdefault(p, {})[s] = n
    table = []
    for p, c in rows:
        base = 0
        used: dict[int, int] = {}
        for n, combo in plan_containers(histograms.get(p, {}), c):
            for s, k in combo.items():
                at = used.get(s, 0)
                table.append((p, s, at, at + n * k, k, base))
                used[s] = at + n * k
            base += n
    spans = spark.createDataFrame(table, "pack_id int, size int, low long, high long, each int, base long")
    spans = spans.groupBy("pack_id", "size").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "base"))).alias("spans"))
    inside = Window.partitionBy("pack_id", "size", "sub").orderBy("doc_id", "tokens")
    numbered = placed.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["pack_id", "size", "sub"])
    rank = F.col("k") + F.col("start")
    span = F.element_at(F.filter("spans", lambda s: (s["low"] <= rank) & (rank < s["high"])), 1)
    # Their number is bounded by the capacities, not by the documents.
    last = numbered.join(F.broadcast(spans) if len(table) <= MAX_SPANS else spans, ["pack_id", "size"]).withColumn("span", span)
    container = F.concat_ws("-", F.lit("p"), (F.col("span.base") + F.floor((rank - F.col("span.low")) / F.col("span.each"))).cast("string"))
    tail = last.select("pack_id", "doc_id", F.col("full").alias("part_idx"), (F.col("full") + 1).alias("parts"), F.col("size").alias("part_tokens"), container.alias("container_id"))
    whole = (
        placed.where("full > 0")
        .withColumn("part_idx", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
        .select("pack_id", "doc_id", "part_idx", (F.col("full") + 1).alias("parts"), F.col("capacity").alias("part_tokens"),
                F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("part_idx").cast("string")).alias("container_id"))
    )
    nothing = items.where("tokens = 0").select("pack_id", "doc_id", F.lit(0).alias("part_idx"), F.lit(0).alias("parts"), F.lit(0).alias("part_tokens"), F.lit(None).cast("string").alias("container_id"))
    return tail.unionByName(whole).unionByName(nothing)
