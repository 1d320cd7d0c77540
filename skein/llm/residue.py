"""Problem 3: template residue, filler text and error or script notices.

Positive-unlabelled naive Bayes over passages (sentences of the main container's text) with three
classes: clean, placeholder and notice. Features are words, adjacent pairs and signs (template syntax, repeated
dummy words, filler vocabulary), which weigh what the fit gives them. Trusted passages are those with a sign,
all text of records that hold little else, and the little text of pages that failed; passages of records rich
in other text are clean. The rest is unlabelled; expectation-maximization decides it, and learns how
likely notices are in records of each size, with and without a heading. Passage scores are aggregated per record:
one placeholder passage makes a case, notices only where no clean passage stands beside them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.blocks import parse
from skein.llm.main_body import HEADING, MAIN, TABLE, VERBATIM, WORDED, Weights, label
from skein.llm.sampling import below, share_of

SAMPLE_RECORDS = 1500
TRUSTED_RECORDS = 3000
CLEAN, PLACEHOLDER, NOTICE = 0, 1, 2
ROUNDS = 4
RICH = 4
#: Bodies over so many bytes aren't sampled; with the numbers of records it bounds what reaches the driver.
SAMPLE_BYTES = 1 << 16
#: Where a passage starts that is neither trusted nor of a rich record: its chance of being a notice.
UNLABELLED = 0.1
#: Log-odds from which a passage is a placeholder: one is enough to exclude a record.
SURE = 2.0

# Unfilled template syntax.
SYNTAX = re.compile(
    r"\{\{.{0,80}?\}\}|\$\{[^{}]{1,80}\}|#\{[^{}]{1,80}\}|<%.{0,80}?%>|&lt;%|\{%.{0,80}?%\}|\[\[[^\[\]]{1,80}\]\]|\[[A-Z][A-Z0-9_ ]{2,30}\]|%[A-Z][A-Z0-9_]*%|__[A-Z0-9_]+__"
    r"|\{[a-z0-9_.]*(?:\|[a-z_]+)?\}|\?[a-z0-9]+_[a-z0-9_]+\?|\[object Object\]|\bNaN/NaN|&lt;insert [^&]{1,60}&gt;|<insert [^<>]{1,60}>"
)
# Words of the usual filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur "
    "sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum neque porro quisquam quia dolorem".split()
)
_STRONG_FILLER = FILLER - frozenset("do ut et ad ex ea in non qui id est sed sit quis sunt esse dolor anim".split())
_SENTENCE = re.compile(r"(?<=[.!?。！？…])\s+|(?<=[。！？])|\n")
_WORD = re.compile(r"[^\W\d_]+|[{}<>\[\]%$#@|/:&]|\d")
_DENSE = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_REPEATED = re.compile(r"\b(\w{2,5})\b(?:\W+\1\b){2,}|\b(x{2,5})\b(?:\W+x{2,5}\b){2,}", re.I)

Model = dict[str, tuple[float, float]]  # log-odds against clean of placeholder and notice


def passages(text: str) -> list[str]:
    return [p for p in _SENTENCE.split(text) if p and not p.isspace()]


def tokens(passage: str) -> list[str]:
    """Words and marks, with scripts without spaces as character pairs."""
    out = []
    for w in _WORD.findall(passage.lower()):
        if _DENSE.match(w):
            out.extend(map("".join, zip(w, w[1:])) if len(w) > 1 else [w])
        else:
            out.append(w)
    return out


def grams(words: list[str]) -> set[str]:
    """Words and adjacent pairs of them."""
    return {*words, *map(" ".join, zip(words, words[1:]))}


def signs(passage: str, words: list[str], table: bool = False) -> list[str]:
    """Features of a passage beside its words: template syntax, repeated dummy words and mostly filler words.

    In a table, cells may well repeat. Syntax in quotation marks of a longer sentence is written about, not left over.
    """
    out = []
    if SYNTAX.search(passage) and not _mentions(passage):
        out.append("<syntax>")
    if not table and _REPEATED.search(passage) and not _mentions(passage):
        out.append("<repeated>")
    strong = sum(w in _STRONG_FILLER for w in words)
    if strong >= 2 and 2 * sum(w in FILLER for w in words) > sum(map(str.isalpha, words)):
        out.append("<filler>")
    return out


def is_trusted(passage: str, words: list[str], table: bool = False) -> bool:
    """Whether a passage has a sign of residue: what the fit trusts."""
    return bool(signs(passage, words, table))


def score(passage: str, model: Model, words: list[str] | None = None, shift: float = 0.0, table: bool = False) -> tuple[float, float]:
    """Log-odds of placeholder and of notice against clean; ``shift`` is what the record's size adds to the latter.

    Pairs of words are asked only where words and signs leave it open.
    """
    words = tokens(passage) if words is None else words
    get = model.get
    p, e = model[""]
    e += shift
    for w in {*words, *signs(passage, words, table)}:
        v = get(w)
        if v:
            p += v[0]
            e += v[1]
    if p < -8 and e < -8:
        return p, e
    for w in set(map(" ".join, zip(words, words[1:]))):
        v = get(w)
        if v:
            p += v[0]
            e += v[1]
    return p, e


Size = tuple[int, bool]


def size_class(texts: list[str], headed: bool) -> Size:
    """Records are alike in size if their texts' bytes have equally many binary digits and there is a heading or none."""
    return min(14, sum(len(t.encode("utf-8", "surrogatepass")) for t in texts).bit_length()), headed


def is_head(text: str) -> bool:
    """Whether a heading titles something, and isn't itself a message."""
    return text.rstrip()[-1:] not in ".!?。！？…"


class Judge:
    """A fitted model: words, and by size of record what it adds to the log-odds of a notice."""

    def __init__(self, model: Model, sizes: dict[Size, float] | None = None):
        self.model = model
        self.sizes = sizes or {}

    def unit(self, text: str, shift: float, table: bool = False) -> int:
        """The class of a unit: of its most residual passage; no notice is looked for in a table."""
        best = CLEAN
        clean = False
        for passage in passages(text):
            p, e = score(passage, self.model, shift=shift, table=table)
            if p > SURE and (p >= e or table):
                return PLACEHOLDER
            if e > 0:
                best = NOTICE
            else:
                clean = True
        return CLEAN if table or (clean and best == NOTICE and shift <= 0) else best

    def pure(self, text: str, shift: float = 0.0) -> bool:
        """Whether a unit is nothing but residue: each of its passages is."""
        return all(max(score(passage, self.model, shift=shift)) > 0 for passage in passages(text))

    def shift(self, texts: list[str], labels: list[int], headed: bool) -> float:
        return self.sizes.get(size_class([t for t, x in zip(texts, labels) if x in (MAIN, WORDED, VERBATIM, TABLE)], headed), 0.0)

    def record(self, texts: list[str], labels: list[int], headed: bool = True) -> tuple[bool, list[int]]:
        """Whether a record is residue, and its units' classes; ``headed``: whether its main body has a heading."""
        shift = self.shift(texts, labels, headed)
        classes = [self.unit(t, shift, x == TABLE) if x in (MAIN, WORDED, TABLE) else CLEAN for t, x in zip(texts, labels)]
        if PLACEHOLDER in classes:  # furniture beside it is no notice
            classes = [CLEAN if c == NOTICE and x == WORDED else c for c, x in zip(classes, labels)]
        return is_case(labels, classes), classes


def _mentions(passage: str) -> bool:
    """Whether the syntax of a longer sentence stands in quotation marks only."""
    bare = re.sub(r"“[^”]*”|‘[^’]*’|«[^»]*»|`[^`]*`", "", passage)
    return bare != passage and not SYNTAX.search(bare) and len(bare) > 40


def is_case(labels: list[int], classes: list[int]) -> bool:
    """Whether a record is residue, from its units' labels and classes (furniture's are ignored)."""
    if any(c == PLACEHOLDER and x in (MAIN, WORDED, TABLE) for x, c in zip(labels, classes)):
        return True
    notices = any(c == NOTICE and x in (MAIN, WORDED) for x, c in zip(labels, classes))
    clean = any(x in (VERBATIM, TABLE) or (x == MAIN and c == CLEAN) for x, c in zip(labels, classes))
    return notices and not clean


def sample_records(pages: DataFrame, plain: int = SAMPLE_RECORDS, trusted: int = TRUSTED_RECORDS) -> list[tuple[int, str]]:
    """(status, body) of at most ``plain`` pages and ``trusted`` pages that may hold trusted passages; the same ones at every run."""
    some = pages.where(F.col("body").isNotNull() & (F.octet_length("body") <= SAMPLE_BYTES)).select("page_id", F.coalesce(F.col("status"), F.lit(0)).alias("status"), "body")
    body = F.col("body")
    marks = ["${", "#{", "<%", "[[", "{%", "NaN/NaN", "&lt;", "__", " ipsum ", "tbd", "xxx", "asdf", "{0}", "<noscript><p>"]
    may = F.col("status") >= 400
    for mark in marks:
        may = may | body.contains(mark)
    rows, maybe = some.agg(F.count("*"), F.count_if(may)).first()
    # One pass for both: a row is taken for either share of hashes it lies in.
    in_plain, in_may = below(F.col("page_id"), share_of(rows, plain)), may & below(F.col("page_id"), share_of(maybe, trusted))
    picked = some.where(in_plain | in_may).withColumn("plain", in_plain).withColumn("may", in_may)
    order = F.xxhash64("page_id")
    parts = [picked.where(c).orderBy(order, "page_id").limit(n).select("status", "body") for c, n in (("plain", plain), ("may", trusted))]
    return [(r.status, r.body) for r in parts[0].unionAll(parts[1]).collect()]


def learn(records: list[tuple[int, str]], weights: Weights) -> Judge:
    """Fit by expectation-maximization.

    Passages of records with RICH or more other passages are clean unless trusted to be residue: a
    notice beside an article makes no case, and text about residue stands in such records. What
    expectation-maximization moves are the passages of poor records.
    """
    counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
    mass = [1.0, 1.0, 1.0]
    open_: Counter = Counter()
    passages_of: Counter = Counter()  # by size of record
    notices_of: Counter = Counter()

    def add(words: list[str], side: int) -> None:
        counts[side].update(grams(words))
        mass[side] += 1

    for status, body in dict.fromkeys(records):
        page = parse(body)
        if not page.blocks:
            continue
        own = [(b, x) for b, x in zip(page.blocks, label(page, weights)) if x in (MAIN, WORDED, HEADING)]
        found = [(p, tokens(p), b.tag, x) for b, x in own for p in passages(b.text)]
        marks = [signs(p, w) for p, w, _, _ in found]
        prose = [t for t in found if t[2][0] != "h"]
        trusted = sum(map(bool, marks))
        mostly = trusted and trusted * 2 >= len(prose)
        rich = len(prose) - trusted >= RICH
        app = any(page.tags[b.node] == "noscript" for b, _ in own)
        failed = not trusted and (app or status >= 400) and len(found) <= 3 and sum(len(p) for p, _, _, _ in found) < 250
        size = size_class([b.text for b, x in own if x != HEADING or not is_head(b.text)], any(x == HEADING and is_head(b.text) for b, x in own))
        for (_, words, _, x), s in zip(found, marks):
            words = [*words, *s]
            if s or (mostly and x == MAIN):
                add(words, PLACEHOLDER)
                continue
            passages_of[size] += 1
            if rich:
                add(words, CLEAN)
            elif failed:
                add(words, NOTICE)
                notices_of[size] += 1
            else:
                open_[tuple(words), size] += 1
    # What clean passages hold once says little and is most of what they hold.
    counts = (Counter({w: n for w, n in counts[CLEAN].items() if n > 1}), *counts[1:])
    rows = [(grams(list(w)), size, n) for (w, size), n in open_.items()]
    soft = [(0.0, UNLABELLED)] * len(rows)
    model: Model = {}
    shifts: dict[Size, float] = {}
    for turn in range(ROUNDS):
        now: tuple[dict, dict, dict] = tuple(dict(c) for c in counts)  # type: ignore[assignment]
        m = list(mass)
        noted = Counter(notices_of)
        for (words, size, n), (p, e) in zip(rows, soft):
            noted[size] += n * e
            for side, share in ((0, 1 - p - e), (1, p), (2, e)):
                if share > 0.01:
                    counter, v = now[side], math.log2(1 + n) * share
                    m[side] += v
                    for w in words:
                        counter[w] = counter.get(w, 0.0) + v
        clean, hold, note = now
        model = {"": (math.log(m[1] / m[0]), math.log(m[2] / m[0]))}
        base = sum(noted.values()) / max(1, sum(passages_of.values()))
        shifts = {}
        for size, n in passages_of.items():
            share = (noted[size] + base + 0.01) / (n + 1.02)
            shifts[size] = math.log(share / (1 - share)) - model[""][1]
        for w in {*hold, *note, *(w for w, n in clean.items() if n >= 3)}:
            c, p, e = clean.get(w, 0.0), hold.get(w, 0.0), note.get(w, 0.0)
            if c + p + e >= 1.5:
                low = math.log((c + 0.05) / m[0])
                model[w] = (math.log((p + 0.05) / m[1]) - low, math.log((e + 0.05) / m[2]) - low)
        if turn == ROUNDS - 1:
            break
        get = model.get
        for i, (words, size, _) in enumerate(rows):
            p, e = model[""]
            e += shifts[size]
            for w in words:
                v = get(w)
                if v:
                    p += v[0]
                    e += v[1]
            top = max(p, e, 0.0)
            x, y, z = math.exp(p - top), math.exp(e - top), math.exp(-top)
            soft[i] = (x / (x + y + z), y / (x + y + z))
    return Judge(model, shifts)
