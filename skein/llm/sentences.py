"""Problem 10: sentence boundaries in many languages and scripts.

A hidden-event n-gram language model: between words there may be a boundary event. This module holds
its form under fixed conventions of what a sentence is: line breaks (and, in Thai, spaces) are certain
events, places without an end mark and places inside brackets and quotations certain non-events.
What stays open are end marks with the quotes and brackets they close. Each has the event's
probability after the words before it and the likelihood ratio of the words behind it as the start or
the continuation of a sentence; unseen words back off to classes of shape, and
expectation-maximization counts what is open. Events too close to be independent are decided together
by forward-backward with a learned transition. ``gaps`` has the model without the conventions.

The model's counts are those of all distinct lines of all documents, summed where they lie; what is sent
to the driver are the counts of contexts and words that are met often enough to be kept, and sums by
class of the rest. It is applied to every document as a whole, in one pass.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.durable import cut, drop

ROUNDS = 5
#: Times that a context and a word must be met to have odds of their own.
LEAST_LEFT, LEAST_RIGHT = 4, 5
#: Distinct counts that a task holds before it passes them on.
HELD_COUNTS = 200_000
#: Contexts and words that have odds of their own at most, the commonest first: a bound of what is broadcast.
MOST_KEPT = 300_000
#: Where a line ends, as ``str.splitlines`` has it.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"

# End marks, and quotes and brackets that open and close.
CLOSE = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "‹": "›", '"': '"', "【": "】", "《": "》"}
_CLOSERS = frozenset(CLOSE.values())
_BRACKETS = frozenset("(（[【")
_SPACES = " \t 　     ​﻿\r\x0b\x0c"
_SIGNS = _CLOSERS | frozenset(CLOSE)
# A quote, a bracket or a row of end marks from its begin, but for rows that what follows rules out. One set of all
# first characters stands before the cases, as a search for a set is several times faster than for alternatives.
# The first case is the commonest: a mark, a space and a word or sign, which is the group.
_SCAN = re.compile(
    r'[(（\[「『«“„‹"【《)）\]」』»”›】》.…!?。！？؟۔।॥]'
    rf'(?:(?<=[.!?])(?<![.…!?][.!?])(?= ([^\W\d_]+|\d+|[^\s{_SPACES}]))'
    r'|(?<=[.…])(?<![.…][.…])[.…]*+(?![_/,;:\-–%a-z0-9])|(?<=[!?])(?<![!?][!?])[!?]*+(?![_=&/a-z0-9])'
    r'|(?<=[。！？؟۔।॥])[。！？!?]*+|(?<=[(（\[「『«“„‹"【《)）\]」』»”›】》]))'
)
_THAI = re.compile("[฀-๿]")
_THAI_SPACE = re.compile("(?<=[฀-๿])[ \t\u00a0]+(?=[฀-๿])")
_STOPS, _WESTERN = frozenset(".…"), frozenset("!?")
_WESTERN_LEFT = {c: (f"{c}_", f"{c}_") for c in _WESTERN}
_MARKER = re.compile(r"\s*(?:(?:[*•·‣▪◦\-–—+]|#{1,6}|\d{1,3}[.)．、]|[A-Za-z][.)]|[A-Za-z]{1,2}[:：]|>)\s+)+")
_WORD = re.compile(r"[^\W\d_]+|\d+|\S")
_ALNUM = re.compile(r"[^\W\d_]+|\d+")
_DENSE = re.compile("[぀-ヿ㐀-鿿]")
_WIDE = frozenset("。！？")
_NEVER = frozenset(",;:，；：、%.。！？!?…")
_AHEAD = re.compile(rf"([{_SPACES}]*+)([^\W\d_]+|\d+|\S)?")


class Model(NamedTuple):
    left: dict[str, float]  # log-odds of the event after a context
    right: dict[str, float]  # log-likelihood ratio of a next word
    pair: float = -3.0  # log-potential of two events with at most one word between them


#: End (behind the mark and what it closes), context and its class before it, the same behind it, whether it is a certain
#: event, whether it is near (at most one word since the candidate before), begin of what stands behind it, and the word there.
#: A bare tuple, as making a named one takes longer than finding it.
Candidate = tuple[int, tuple[str, str], tuple[str, str], bool, bool, int, str]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles, which would go through all that is held again and again; nothing here makes any."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_DIGITS = tuple(f"<d{n}>" for n in range(5))


@lru_cache(1 << 16)
def _shape(word: str) -> str:
    c = word[0]
    if c.isdigit():
        return _DIGITS[min(len(word), 4)]
    if _DENSE.match(c):
        return "<dense>"
    if c.isupper():
        return "<I>" if len(word) == 1 else "<ALL>" if word.isupper() and len(word) < 5 else f"<U{min(len(word), 4)}>"
    if c.islower():
        return f"<l{min(len(word), 4)}>"
    if c.isalpha():
        return f"<o{min(len(word), 3)}>"
    return f"<{c}>"


def _left(mark: str, closed: str, introduced: bool, gap: bool, opening: bool) -> tuple[str, str]:
    """The context before an event without a word: the mark or, at a closing sign, how the sign stands."""
    first = mark[0]
    if first in _WIDE and not closed:
        return "<wide>", "<wide>"
    space = "_" if gap and first not in _WIDE else ""  # wide marks need no space
    name = _kind(mark) + (f"{closed[-1]}{':' if introduced else '|' if opening else ''}" if closed else "") + space
    return name, name


def _kind(mark: str) -> str:
    return mark[0] if len(mark) == 1 or mark == mark[0] * 2 else mark[:2] + "+"


def _last_word(text: str) -> str:
    """The last word before a full stop, without what opens before it."""
    return (text.split() or [""])[-1].lstrip("(（“„«\"「") if text[-1:] not in _SPACES else ""


@lru_cache(1 << 16)
def _before(word: str) -> tuple[str, str]:
    """The context of a word and a full stop."""
    if not word:
        return "< >.", "< >."
    if "/" in word or "=" in word:
        return "<url>.", "<url>."
    if not word[-1].isalnum() and word[-1] not in "ािीुूेैोौ्ंःँ":
        name = f"<{word[-1]}>."
        return name, name
    return f"{word}.", f"{_shape(word)}{'c' if '.' in word else ''}."


@lru_cache(1 << 16)
def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


@lru_cache(1 << 16)
def _behind(w: str, caseless: bool) -> tuple[str, str]:
    """A word behind an event with its class; ``caseless`` tells of the script before the mark.

    Bare wide marks need no evidence from behind, and in scripts without case neither numbers nor
    lower-case Latin words speak against a new sentence.
    """
    if not w:
        return "", ""
    if _DENSE.match(w):
        return w[:2], "<dense>"
    if caseless and (w[0].isdigit() or w[0].islower()):
        return "", ""
    return w, _shape(w)


def candidates(line: str, begin: int) -> list[Candidate]:
    """Possible events inside a line, left to right, without the one at its end."""
    out: list[Candidate] = []
    stack: list[tuple[str, int]] = []  # closing sign awaited, position of the opening sign
    size = len(line)
    at = last = begin
    for m in _SCAN.finditer(line, begin):
        start, stop = m.span()
        if start < at:  # closed by the mark before, or part of it
            continue
        first = line[start]
        word = m[1]
        if word and not (stack and word == "»"):
            if stack:
                continue
            if first == ".":
                left = line[line.rfind(" ", max(0, start - 40), start) + 1 or max(0, start - 40) : start]
                left = _before(left if left.isalnum() else _last_word(left))
            else:
                left = _WESTERN_LEFT[first]
            right = _behind(word, _caseless(line[start - 1] if start else "a"))
            out.append((stop, left, right, False, start - last < 4 or line.find(" ", last, start) < 0, stop + 1, word))
            last = stop + 1
            continue
        at = stop
        if first in _SIGNS:
            if stack and first == stack[-1][0]:
                stack.pop()
            elif first in CLOSE:
                if line.find(CLOSE[first], at) >= 0:
                    stack.append((CLOSE[first], start))
            else:
                for i in range(len(stack) - 1, -1, -1):  # a sign that closes further out
                    if stack[i][0] == first:
                        del stack[i:]
                        break
            continue
        c = line[at : at + 1]
        if c != " " and first in _STOPS:
            if c.isalnum() and (c.islower() or c.isdigit() or first == "…" or at - start > 1):
                continue
            while at < size and line[at] in _WESTERN:
                at += 1
        closed, opened = "", -1
        end = at
        while stack and end < size:  # what the mark closes, French spacing included
            c = line[end]
            if c == stack[-1][0]:
                opened = stack.pop()[1]
                closed += c
                end += 1
            elif c in " \u00a0\u202f" and stack[-1][0] == "»" and line[end + 1 : end + 2] == "»":
                end += 1
            else:
                break
        mark_end, at = at, end
        if stack or end >= size:
            continue  # inside a bracket or quotation that goes on, or at the end of the line
        if line[end] in _NEVER:
            continue
        w = _AHEAD.match(line, end)
        nxt, word = w.end(1), w[2] or ""  # type: ignore[union-attr]
        if nxt >= size:
            continue
        if first == "." and not closed and (mark_end - start == 1 or line[start:mark_end] == ".."):
            low = start - 40 if start > 40 else 0
            left = line[line.rfind(" ", low, start) + 1 or low : start]
            left = _before(left if left.isalnum() else _last_word(left))
        else:
            introduced = opening = False
            if closed:
                before = line[max(0, opened - 3) : opened].rstrip()
                introduced = before[-1:] in (":", "：", ",", "，")
                opening = not line[last:opened].strip()
            left = _left(line[start:mark_end], closed, introduced, nxt > end, opening)
        right = ("", "") if not closed and first in _WIDE else _behind(word, _caseless(line[start - 1] if start else "a"))
        out.append((end, left, right, False, start - last < 4 or line.find(" ", last, start) < 0, nxt, word))
        last = nxt
    if not line.isascii() and _THAI.search(line):
        out += [(m.start(), ("", ""), ("", ""), True, False, m.end(), "") for m in _THAI_SPACE.finditer(line, begin)]
        out.sort()
    return out


def _odds_of(left: tuple[str, str], right: tuple[str, str], model: Model) -> float:
    lefts, rights, _ = model
    a = lefts.get(left[0])
    if a is None:
        a = lefts.get(left[1], 0.0)
    b = rights.get(right[0])
    if b is None:
        b = rights.get(right[1], 0.0)
    return a + b


def events(found: list[Candidate], model: Model) -> list[Candidate]:
    """The candidates whose event is more likely than not; forward-backward along those that are near each other."""
    out: list[Candidate] = []
    i, size = 0, len(found)
    while i < size:
        c = found[i]
        j = i + 1
        if j == size or not found[j][4]:  # its probability is above one half where its log-odds are above zero
            if c[3] or _odds_of(c[1], c[2], model) > 0:
                out.append(c)
        else:
            while j < size and found[j][4]:
                j += 1
            run = found[i:j]
            out += [c for c, p in zip(run, posteriors(run, model)) if p > 0.5]
        i = j
    return out


def posteriors(run: list[Candidate], model: Model) -> list[float]:
    """Event probabilities of candidates near each other: two states each, a pair potential on both being events."""
    pair = math.exp(model.pair)
    weight = [math.exp(40.0 if c[3] else max(-40.0, min(40.0, _odds_of(c[1], c[2], model)))) for c in run]
    forward = [(1.0, weight[0])]
    for w in weight[1:]:
        a, b = forward[-1]
        s = a + b
        forward.append(((a + b) / s, (a + b * pair) * w / s))
    out = [0.0] * len(run)
    back = (1.0, 1.0)
    for k in range(len(run) - 1, -1, -1):
        a, b = forward[k][0] * back[0], forward[k][1] * back[1]
        out[k] = b / (a + b)
        w = weight[k]
        back = (back[0] + w * back[1], back[0] + w * pair * back[1])
        s = back[0] + back[1]
        back = (back[0] / s, back[1] / s)
    return out


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points, without white space at either end."""
    out: list[tuple[int, int]] = []
    base = 0
    for line in text.splitlines(keepends=True):
        body = line.rstrip()
        if body:
            start = len(line) - len(line.lstrip())
            m = _MARKER.match(body)
            for c in events(candidates(body, m.end() if m else start), model):
                out.append((base + start, base + c[0]))
                start = c[0]
                while body[start].isspace():
                    start += 1
            out.append((base + start, base + len(body)))
        base += len(line)
    return out


END, OPEN, START, INNER, PAIR = range(5)  # kinds of counts
_RARE = "\x01"  # before the class of a word that is met too seldom
Key = tuple[int, str, str, str, str]  # kind, context and its class, next word and its class


def count_lines(lines: Iterable[str], counts: Counter[Key]) -> None:
    """Add what distinct lines hold: certain events by context, open events, starts, words inside sentences, and how often events are near."""
    tokens: Counter[str] = Counter()  # between white space: few of them are distinct, and only those are taken apart
    words: list[str] = []
    ends: list[tuple[str, str]] = []
    open_ones: list[tuple[tuple[str, str], tuple[str, str]]] = []
    behind: list[str] = []
    marked_lines = single = following = near = 0
    for line in lines:
        body = line.rstrip()
        size = len(body)
        m = _MARKER.match(body)
        begin = m.end() if m else size - len(body.lstrip())
        found = candidates(body + " \u0001", begin)
        m = _WORD.match(body, begin)
        if m:
            words += body[m.end() :].split()
        if len(words) > HELD_COUNTS:
            tokens.update(words)
            words.clear()
        marked = False
        open_ = 0
        for end, left, right, sure, close, _, word in found:
            if sure:
                continue
            if end >= size:
                ends.append(left)
                marked = True
            else:
                open_ones.append((left, right))
                behind.append(word)
            following += open_
            near += open_ and close
            open_ = 1
        if marked:  # headings and other lines without an end mark start like no sentence
            counts[START, "", "", *(_behind(m[0], False) if m else ("", ""))] += 1
            marked_lines += 1
            single += len(found) == 1 and body.find(" ", begin) < 0
    held = counts.get  # adding to a counter asks it for what is missing, which is slower
    for left, n in Counter(ends).items():
        key = (END, *left, "", "")
        counts[key] = held(key, 0) + n
    for (left, right), n in Counter(open_ones).items():
        key = (OPEN, *left, *right)
        counts[key] = held(key, 0) + n
    tokens.update(words)
    inner: dict[str, int] = {}
    for token, n in tokens.items():
        if token.isalpha():
            inner[token] = inner.get(token, 0) + n
        else:
            for w in _ALNUM.findall(token):
                inner[w] = inner.get(w, 0) + n
    for w, n in Counter(behind).items():
        inner[w] = inner.get(w, 0) - n
    for w, n in inner.items():
        if n > 0 and w[0].isalnum():
            key = (INNER, "", "", *_behind(w, False))
            counts[key] = held(key, 0) + n
    for name, n in (("line", marked_lines), ("single", single), ("following", following), ("near", near)):
        counts[PAIR, name, "", "", ""] += n


def learn(texts: list[str]) -> Model:
    """Expectation-maximization from texts; line ends and starts are certain events."""
    counts: Counter[Key] = Counter()
    count_lines({s for t in texts for s in t.splitlines() if s.strip()}, counts)
    lefts: dict[str, list] = {}
    for (kind, word, s, _, next_), n in counts.items():
        if kind in (END, OPEN):
            own = lefts.setdefault(word, [s, 0, 0])
            if kind == END:
                own[1] += n
            elif word[0] not in "!?" or next_[:2] != "<l":  # behind these a lower-case word goes on
                own[2] += n
    classes: dict[str, list[float]] = {}
    for s, e, i in lefts.values():
        scale = min(1.0, (LEAST_LEFT - 1) / max(e + i, 1))
        sums = classes.setdefault(s, [0.0, 0.0, 0, 0])
        for k, v in enumerate((e * scale, i * scale, e, i if e else 0)):
            sums[k] += v
    return _fit(counts, _after([(w, *x) for w, x in lefts.items()], classes))


def distinct_lines(documents: DataFrame) -> DataFrame:
    """(line): the distinct lines of all texts that hold more than spaces; other white space is left to who counts, as it is rare."""
    lines = documents.where("text is not null").select(F.explode(F.split("text", LINE_END)).alias("line"))
    return lines.where(F.trim("line") != "").distinct()


def summed(lines: DataFrame, count: Callable[[Iterable[str], Counter], None], names: tuple[str, ...]) -> DataFrame:
    """(kind, names, n): what ``count`` adds up over ``lines``, summed in each task first, in a table of bounded size."""
    kind = pa.schema([("kind", pa.int32()), *((k, pa.string()) for k in names), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((*k, n) for k, n in counts.items()))) or [()] * len(kind)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        with uncollected():
            for batch in batches:
                count(batch.column(0).to_pylist(), counts)
                if len(counts) > HELD_COUNTS:
                    yield flush()
            yield flush()

    schema = f"kind int, {', '.join(f'{k} string' for k in names)}, n long"
    return lines.mapInArrow(run, schema).groupBy("kind", *names).agg(F.sum("n").alias("n"))


def learn_all(documents: DataFrame) -> Model:
    """What ``learn`` gives for the texts of all rows, with the counts made by tasks; null texts give none."""
    counts = cut(summed(distinct_lines(documents), count_lines, ("l", "ls", "r", "rs")))
    of_end, of_open = F.col("kind") == END, F.col("kind") == OPEN
    goes_on = F.substring("l", 1, 1).isin("!", "?") & F.col("rs").startswith("<l")
    lefts = counts.where(of_end | of_open).groupBy("l", "ls").agg(
        F.sum(F.when(of_end, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(of_open & ~goes_on, F.col("n")).otherwise(0)).alias("i")
    )
    lefts = cut(lefts)
    met = F.col("e") + F.col("i")
    scale = F.least(F.lit(1.0), (LEAST_LEFT - 1) / F.greatest(met, F.lit(1)))
    sums = lefts.groupBy("ls").agg(F.sum(F.col("e") * scale), F.sum(F.col("i") * scale), F.sum("e"), F.sum(F.when(F.col("e") > 0, F.col("i")).otherwise(0)))
    often = lefts.where((met >= LEAST_LEFT) | (F.col("l") == F.col("ls"))).orderBy(F.col("l") != F.col("ls"), met.desc(), "l").limit(MOST_KEPT)
    kept = [tuple(r) for r in often.select("l", "ls", "e", "i").collect()]
    left = _after(kept, {r[0]: list(r)[1:] for r in sums.collect()})
    spark = documents.sparkSession
    known_left = spark.createDataFrame([(r[0], True) for r in kept], "l string, kept boolean")
    totals = counts.where(~of_end & (F.col("kind") != PAIR)).groupBy("r").agg(F.sum("n").alias("total"))
    rights = totals.where(F.col("total") >= LEAST_RIGHT).orderBy(F.desc("total"), "r").limit(MOST_KEPT).select("r", F.lit(True).alias("known"))
    known = counts.where(~of_end).join(known_left, "l", "left").join(rights, "r", "left")
    known = known.select(
        "kind",
        F.when(F.col("kept") | (F.col("kind") == PAIR), F.col("l")).otherwise(F.col("ls")).alias("l"),
        "ls",
        F.when(F.col("known") | (F.col("r") == F.col("rs")), F.col("r")).otherwise(F.concat(F.lit(_RARE), "rs")).alias("r"),
        "rs",
        "n",
    )
    rows = known.groupBy("kind", "l", "ls", "r", "rs").agg(F.sum("n").alias("n")).orderBy("kind", "l", "ls", "r", "rs").toArrow()
    drop(counts, lefts)
    columns = [rows.column(i).to_pylist() for i in range(6)]
    return _fit(dict(zip(zip(*columns[:5]), columns[5])), left)


def _fit(counts: dict[Key, int], left: dict[str, float]) -> Model:
    """The rounds of expectation-maximization, given the log-odds after each context.

    The ratios start from certain events alone, line starts against words inside sentences. For words in lower
    case it stays so: what is open counts as their going on, since only certain starts tell of texts without capitals.
    """
    words: dict[str, int] = {}

    def ids(names: list[str]) -> np.ndarray:
        return np.array([words.setdefault(w, len(words)) for w in names], np.int64)

    sure = [(np.array([n for k, n in counts.items() if k[0] == kind], float), *(ids([k[j] for k in counts if k[0] == kind]) for j in (3, 4))) for kind in (START, INNER)]
    rows = [k for k in counts if k[0] == OPEN]
    n = np.array([counts[k] for k in rows], float)
    after = np.array([left.get(k[1], left.get(k[2], 0.0)) for k in rows])
    word, shape = ids([k[3] for k in rows]), ids([k[4] for k in rows])
    size = len(words)
    names = list(words)
    rare = np.array([w[:1] == _RARE for w in names], bool)
    low = np.array([k[4][:2] == "<l" for k in rows], bool)

    def both(weights: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.bincount(w, weights, size) + np.bincount(s, weights * (w != s), size)

    certain = [both(x, w, s) for x, w, s in sure]
    soft = np.zeros(size), np.zeros(size)
    ratio, known = np.zeros(size), np.zeros(size, bool)
    for _ in range(ROUNDS + 1):
        first, later = certain[0] + soft[0], certain[1] + soft[1]
        value = np.log((first + 0.3) / (first.sum() + 1)) - np.log((later + 0.3) / (later.sum() + 1))
        known = (first + later >= LEAST_RIGHT) & ~rare
        ratio = np.where(known, value.clip(-8.0, 4.0), 0.0)
        odds = after + np.where(known[word], ratio[word], ratio[shape]) if size else after
        p = 1 / (1 + np.exp(-odds.clip(-40, 40)))
        p = np.where(low, 0.0, p)
        soft = both(n * p, word, shape), both(n * (1 - p), word, shape)
    seen = {k[1]: v for k, v in counts.items() if k[0] == PAIR}
    alone = (seen.get("single", 0) + 0.5) / (seen.get("line", 0) + 10)
    close = (seen.get("near", 0) + 0.5) / (seen.get("following", 0) + 1)
    return Model(left, {w: float(r) for w, r, k in zip(names, ratio, known) if k}, min(0.0, math.log(alone) - math.log(close)))


def _after(lefts: list[tuple[str, str, int, int]], classes: dict[str, list[float]]) -> dict[str, float]:
    """Log-odds of the event after each context inside a line.

    A fixed share of all sentence ends are line ends. So a context's line ends tell how many of its
    occurrences inside lines are sentence ends too: none of an abbreviation's, nearly all of a common
    word's. Contexts met fewer than LEAST_LEFT times back off to the rate of the rare contexts of their class.

    ``lefts`` has (context, class, line ends, occurrences inside); contexts met fewer times may be missing.
    ``classes`` has sums over all contexts of a class: of both, each context scaled to rare, of its line ends,
    and of its occurrences inside if it has line ends.
    """
    plain = [x for s, x in classes.items() if s.startswith("<l4>")]
    clear = sum(x[3] for x in plain) or 1
    share = min(0.9, max(0.02, sum(x[2] for x in plain) / (clear + sum(x[2] for x in plain) or 1)))
    factor = (1 - share) / share

    def odds(e: float, n: float, weight: float) -> float:
        p = min(0.995, max(0.002, (e * factor + 0.5 * weight) / (n + weight)))
        return math.log(p / (1 - p))

    out = {s: odds(x[0], x[1], 1.0) for s, x in classes.items()}
    for w, s, e, i in lefts:
        if w != s and e + i >= LEAST_LEFT:
            out[w] = odds(e, i, 0.2)
        elif w == s:
            out[w] = odds(e, i, 0.5)
    return out


def sentences(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence of every row; null and blank texts give none.

    doc_id is taken as unique; other columns are ignored.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            for batch in batches:
                ids, starts, ends = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        found = spans(text, model)
                        ids += [doc] * len(found)
                        starts += [a for a, _ in found]
                        ends += [b for _, b in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=kind)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start_char int, end_char int")
