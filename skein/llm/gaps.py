"""Problem 10 without conventions: a hidden-event n-gram language model with an event possible between any two tokens.

Tokens are what white space separates, and single characters of scripts without spaces, with the marks
behind them. In every gap the event has a probability after the last tokens: after the class of the one before
and the token (a trigram with the event), backed off to the token and to its class of shape. The next
word speaks for the start or the continuation of a sentence. Line ends are certain events; a fixed share of
all events are line ends, so a context's line ends tell how often it ends sentences inside lines. Lines with
and without an end mark have contexts of their own, since in the former events need marks.
Forward-backward over each whole line, with learned transitions, gives the posteriors. Thai and other unpunctuated
text gets its boundaries from the words alone.

All counts are of all distinct lines of all documents, summed where they lie.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.durable import cut, drop
from skein.llm.languages import forward_backward
from skein.llm.sentences import MOST_KEPT, _shape, distinct_lines, summed

#: Times that a context or word must be met to have a value of its own.
LEAST = 4
#: Strength of the class's rate in a context's own, in occurrences.
BACK_OFF = 2.0
END, INSIDE, START, INNER, LENGTH = range(5)  # kinds of counts

_TOKEN = re.compile("[\u3040-\u30ff\u3400-\u9fff][^\\w\\s]*|[^\\s\u3040-\u30ff\u3400-\u9fff]+")
_CORE = re.compile(r"^\W*(.*?)([^\w\s]*)$", re.S)
_ENDED = re.compile("[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964\u0965][^\\w\\s]*$")


class GapModel(NamedTuple):
    left: dict[str, float]  # log-odds of the event by context: class and token, token, class
    right: dict[str, float]  # log-likelihood ratio of a next word, or its class
    moves: np.ndarray  # log transitions between no event and event at neighbouring gaps


@lru_cache(1 << 17)
def parts(token: str) -> tuple[str, str, str]:
    """A token's class, its word without marks, and the word's class."""
    core, tail = _CORE.match(token).groups()  # type: ignore[union-attr]
    shape = _shape(core) if core else "<>"
    return f"{shape}{'c' if '.' in core else ''}{tail[:2]}", core, shape


class Coder(dict):
    """Numbers of the tokens met so far, with their parts; made for maps over lists of tokens."""

    def __init__(self) -> None:
        super().__init__()
        self.tokens: list[str] = []
        self.shapes: dict[str, int] = {}
        self.classes: list[int] = []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.tokens)
        self.tokens.append(token)
        self.classes.append(self.shapes.setdefault(parts(token)[0], len(self.shapes)))
        return n


class Coded(NamedTuple):
    """Tokens of many lines in a row."""

    sizes: np.ndarray  # of the lines
    rows: np.ndarray  # numbers of the tokens
    ended: np.ndarray  # by token: whether its line has an end mark
    before: np.ndarray  # class of the token before, -1 at the start of a line


def code(lines: list[list[str]], coder: Coder) -> Coded:
    """Lines of one token or more."""
    sizes = np.array([len(x) for x in lines], np.int64)
    rows = np.array([n for x in lines for n in map(coder.__getitem__, x)], np.int64)
    ended = np.repeat(np.array([_ENDED.search(x[-1]) is not None for x in lines], bool), sizes)
    before = np.append(-1, np.array(coder.classes, np.int64)[rows[:-1]]) if len(rows) else rows
    before[np.cumsum(sizes)[:-1]] = -1
    return Coded(sizes, rows, ended, before)


def count_gaps(lines: Iterable[str], counts: Counter) -> None:
    """Add (kind, context, token, class) counts of events at line ends and gaps inside, and of words by place."""
    found = [t for t in map(_TOKEN.findall, lines) if t]
    if not found:
        return
    coder = Coder()
    c = code(found, coder)
    last = np.zeros(len(c.rows), np.int64)
    last[np.cumsum(c.sizes) - 1] = 1
    width = len(coder.shapes) + 1
    keys, n = np.unique(((c.rows * width + c.before + 1) * 2 + c.ended) * 2 + last, return_counts=True)
    names = ["", *coder.shapes]
    shapes = names[1:]
    for key, m in zip(keys.tolist(), n.tolist()):
        row, before = divmod(key // 4, width)
        kind = ".~"[not key & 2]
        token, shape = coder.tokens[row], shapes[coder.classes[row]]
        counts[END if key & 1 else INSIDE, f"{kind}{names[before]}\t{token}", kind + token, kind + shape] += m
        _, word, own = parts(token)
        counts[INNER if before else START, "", word, own] += m
    single = int((c.sizes == 1).sum())
    counts[LENGTH, "1", "", ""] += single
    counts[LENGTH, "2", "", ""] += len(found) - single


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def _rates(e: np.ndarray, i: np.ndarray, base: np.ndarray, factor: float) -> np.ndarray:
    """Probability of the event inside a line after contexts of e line ends and i gaps, drawn to the ``base`` of what they back off to."""
    return np.clip((e * factor + BACK_OFF * base) / (np.maximum(i, e * factor) + BACK_OFF), 1e-4, 1 - 1e-4)


def learn_gaps(documents: DataFrame) -> GapModel:
    """The model of all texts of ``documents``; null and blank texts give none.

    What reaches the driver are sums by class and at most MOST_KEPT contexts, tokens and words each, the commonest.
    """
    counts = cut(summed(distinct_lines(documents), count_gaps, ("context", "token", "class")))
    of_end = F.sum(F.when(F.col("kind") == END, F.col("n")).otherwise(0))
    of_in = F.sum(F.when(F.col("kind") == INSIDE, F.col("n")).otherwise(0))
    gaps = counts.where(F.col("kind").isin(END, INSIDE))

    def table(*keys: str) -> list[tuple]:
        rows = gaps.groupBy(*keys).agg(of_end.alias("e"), of_in.alias("i")).where(F.col("e") + F.col("i") >= LEAST)
        return [tuple(r) for r in rows.orderBy((F.col("e") + F.col("i")).desc(), *keys).limit(MOST_KEPT).collect()]

    classes, tokens, both = table("class"), table("token", "class"), table("context", "token")
    plain = [(e, i) for k, e, i in classes if k.startswith(".<l4>.")]
    ends, inside = sum(e for e, _ in plain), sum(i for _, i in plain)
    factor = inside / ends if ends and inside else 2.0
    left: dict[str, float] = {}

    def add(names: list[str], e: list[int], i: list[int], base: np.ndarray) -> None:
        if names:
            left.update(zip(names, _logit(_rates(np.array(e, float), np.array(i, float), base, factor)).tolist()))

    def below(names: list[str]) -> np.ndarray:
        return np.array([1 / (1 + math.exp(-left.get(n, -6.0))) for n in names])

    add([r[0] for r in classes], [r[1] for r in classes], [r[2] for r in classes], np.full(len(classes), 0.01))
    # Names differ: classes begin with the kind of line and "<", contexts hold a tab.
    add(["\n" + r[0] for r in tokens], [r[2] for r in tokens], [r[3] for r in tokens], below([r[1] for r in tokens]))
    add([r[0] for r in both], [r[2] for r in both], [r[3] for r in both], below(["\n" + r[1] for r in both]))
    words = counts.where(F.col("kind").isin(START, INNER))
    first = F.sum(F.when(F.col("kind") == START, F.col("n")).otherwise(0)).alias("first")
    later = F.sum(F.when(F.col("kind") == INNER, F.col("n")).otherwise(0)).alias("later")
    right: dict[str, float] = {}
    for name in ("class", "token"):
        rows = words.groupBy(name).agg(first, later).where(F.col("first") + F.col("later") >= LEAST)
        got = rows.orderBy((F.col("first") + F.col("later")).desc(), name).limit(MOST_KEPT).collect()
        begun, going = sum(r[1] for r in got) + 1, sum(r[2] for r in got) + 1
        for w, a, b in got:
            right[("\n" if name == "token" else "") + w] = min(6.0, max(-8.0, math.log((a + 0.3) / begun) - math.log((b + 0.3) / going)))
    lengths = {r[0]: r[1] for r in counts.where(F.col("kind") == LENGTH).groupBy("context").agg(F.sum("n")).collect()}
    drop(counts)
    single = (lengths.get("1", 0) + 0.5) / (sum(lengths.values()) + 2.0)
    return GapModel(left, right, np.log(np.array([[1.0, 1.0], [1.0, single]])))


class Odds:
    """Log-odds of the event behind each token, transitions apart; keeps the tokens it has met, up to a bound."""

    KEEP = 400_000

    def __init__(self, model: GapModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.coder = Coder()
        self.base = np.empty((0, 2))
        self.right = np.empty(0)
        self.pairs: dict[int, float] = {}
        self.keys, self.values = np.empty(0, np.int64), np.empty(0)
        self.by_token: dict[str, list[tuple[str, float]]] = {}
        for name, v in self.model.left.items():
            shape, tab, token = name.partition("\t")
            if tab:
                self.by_token.setdefault(token, []).append((shape, v))

    def _grow(self) -> None:
        """Values of the tokens that are new."""
        left, right, coder = self.model.left.get, self.model.right.get, self.coder
        base, ahead = [], []
        for n in range(len(self.base), len(coder.tokens)):
            token = coder.tokens[n]
            shape, word, own = parts(token)
            pair = []
            for kind in "~.":
                v = left("\n" + kind + token)
                pair.append(left(kind + shape, -6.0) if v is None else v)
            base.append(pair)
            r = right("\n" + word)
            ahead.append(right(own, 0.0) if r is None else r)
            for before, v in self.by_token.get(token, ()):
                k = -1 if len(before) == 0 or before[1:] == "" else coder.shapes.setdefault(before[1:], len(coder.shapes))
                ended = before[:1] == "."
                self.pairs[(n << 20 | k + 1) << 1 | ended] = v
        if base:
            self.base, self.right = np.concatenate((self.base, base)), np.append(self.right, ahead)
            self.keys = np.array(sorted(self.pairs), np.int64)
            self.values = np.array([self.pairs[k] for k in self.keys.tolist()])

    def __call__(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds behind every token but the last of its line, sizes of the lines)."""
        if len(self.coder) > self.KEEP:
            self.forget()
        c = code(lines, self.coder)
        self._grow()
        value = self.base[c.rows, c.ended.astype(int)]
        if len(self.keys):
            key = (c.rows << 20 | c.before + 1) << 1 | c.ended
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            value = np.where(self.keys[at] == key, self.values[at], value)
        inner = np.ones(len(c.rows), bool)
        inner[np.cumsum(c.sizes) - 1] = False
        return value[inner] + self.right[np.append(c.rows[1:], 0)][inner], c.sizes


def gap_sentences(documents: DataFrame, model: GapModel) -> DataFrame:
    """(doc_id, start_char, end_char, confidence) of every sentence of every row: what lies between events of more than even probability.

    confidence is the posterior of the event that ends it, 1 at a line end. Null and blank texts give
    none; doc_id is taken as unique; other columns are ignored.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Odds(model)
        for batch in batches:
            where: list[tuple[int, int, str]] = []
            lines: list[list[str]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = 0
                for line in (text or "").splitlines(keepends=True):
                    tokens = _TOKEN.findall(line)
                    if tokens:
                        where.append((doc, base, line))
                        lines.append(tokens)
                    base += len(line)
            out: tuple[list, list, list, list] = ([], [], [], [])
            if lines:
                o, sizes = measure(lines)
                o = o.clip(-40, 40)
                p = forward_backward(np.stack((np.zeros(len(o)), o), 1), sizes[sizes > 1] - 1, model.moves)[0][:, 1] if len(o) else o
                events = np.flatnonzero(p > 0.5)
                stops = np.cumsum(sizes - 1)
                of_line = np.searchsorted(events, np.append(0, stops))
                for i, (doc, base, line) in enumerate(where):
                    hits = events[of_line[i] : of_line[i + 1]]
                    if not len(hits):
                        body = line.rstrip()
                        rows = [(base + len(line) - len(line.lstrip()), base + len(body), 1.0)]
                    else:
                        spans = [m.span() for m in _TOKEN.finditer(line)]
                        places = (hits - (stops[i] - sizes[i] + 1)).tolist()
                        rows = [(base + spans[a][0], base + spans[b][1], v) for a, b, v in zip([0, *(x + 1 for x in places)], [*places, len(spans) - 1], [*p[hits].tolist(), 1.0])]
                    for a, b, v in rows:
                        for held, x in zip(out, (doc, a, b, v)):
                            held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind)], schema=kind)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start_char int, end_char int, confidence double")
