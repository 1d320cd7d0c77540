"""Problem 2: a language with a confidence for every article, block and segment.

A linear-chain conditional random field labels words. A word's features are its lower-case form (the
lexicon), affixes, character n-grams and script; transitions are learned. Forward-backward runs on whole
batches of blocks at once, so a word costs a table lookup and a few vector operations, and a
word's emission is computed once per worker and distinct word.

The model is fitted on at most SAMPLE_ARTICLES articles (lowest hash first). Their stated labels are
noisy: a block whose script belongs to one language has that one, a block in another script than its
label's has none, and a block whose words contradict its label changes it before the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import SPACE
from skein.llm.sampling import lowest

SAMPLE_ARTICLES = 600
BUCKETS = 1 << 17
STEPS = 12
START = 0.4  # weight of a feature's starting odds, since a word's features overlap
LANGS = ("en", "de", "fr", "es", "pt", "ru", "ja", "zh", "ko", "th", "hi", "ar")

# Names of these languages in English and in themselves.
NAMES = {
    "en": "english",
    "de": "german deutsch",
    "fr": "french français francais",
    "es": "spanish español espanol castellano",
    "pt": "portuguese português portugues",
    "ru": "russian русский",
    "ja": "japanese 日本語",
    "zh": "chinese 中文 汉语 漢語 简体中文 繁體中文",
    "ko": "korean 한국어",
    "th": "thai ไทย ภาษาไทย",
    "hi": "hindi हिन्दी हिंदी",
    "ar": "arabic العربية عربي",
}
_BY_NAME = {n: c for c, names in NAMES.items() for n in names.split()}

# Scripts by code point range, with the languages of the set that use them.
SCRIPTS = (
    (0x0400, 0x052F, "ru"),
    (0x0600, 0x06FF, "ar"),
    (0x0750, 0x077F, "ar"),
    (0x0900, 0x097F, "hi"),
    (0x0E00, 0x0E7F, "th"),
    (0x1100, 0x11FF, "ko"),
    (0xAC00, 0xD7AF, "ko"),
    (0x3040, 0x30FF, "ja"),
    (0x3400, 0x9FFF, "zh ja"),
)
_WORD = re.compile("[぀-ヿ㐀-鿿ｦ-ﾝ]|[^\\W\\d_぀-ヿ㐀-鿿ｦ-ﾝ]+")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{30,}")


def label_code(label: Column) -> Column:
    """The two-letter code a stated label means, whatever its spelling; null for null, blank and ``und``."""
    low = F.lower(F.regexp_replace(label, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    named = F.create_map(*(F.lit(x) for pair in _BY_NAME.items() for x in pair))
    head = F.regexp_extract(low, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    code = F.coalesce(named[low], F.nullif(head, F.lit("")), low)
    return F.when(low.isin("", "und", "unknown", "none", "null"), None).otherwise(code)


def is_encoded(text: str) -> bool:
    """Whether a text is an encoded string: mostly long unbroken runs of letters, digits and code signs."""
    return 2 * sum(len(m) for m in _ENCODED.findall(text)) > len(text)


def _script(word: str) -> str:
    c = ord(word[0])
    for a, b, langs in SCRIPTS:
        if a <= c <= b:
            return langs
    return ""


def script_label(text: str, stated: str) -> str | None:
    """The label to learn a block with: its script's only language, else the stated one if it is written so."""
    seen: dict[str, int] = {}
    for w in _WORD.findall(text):
        langs = _script(w)
        seen[langs] = seen.get(langs, 0) + len(w)
    if not seen:
        return None
    if seen.get("ja") and seen.get("zh ja") and seen["ja"] * 8 > seen["zh ja"]:
        return "ja"
    top = max(seen, key=lambda k: seen[k])
    if not top:  # Latin
        return stated if stated in LANGS and not any(stated in s[2].split() for s in SCRIPTS) else None
    return top if " " not in top else ("zh" if stated not in ("zh", "ja") else stated)


def _features(word: str) -> list[int]:
    w = f"^{word}$"
    names = [f"w{word}", f"c{_script(word) or 'latin'}", f"2{w[:3]}", f"3{w[:4]}", f"s{w[-3:]}", f"t{w[-4:]}"]
    names += [w[i : i + 3] for i in range(1, len(w) - 3)]
    h = xxhash.xxh32_intdigest
    return [h(n) % BUCKETS for n in names]


class Crf(NamedTuple):
    weights: np.ndarray  # (BUCKETS, languages)
    transitions: np.ndarray  # log scores (languages, languages)


class Index(NamedTuple):
    """The features of words, one after the other; every word has some."""

    flat: np.ndarray
    sizes: np.ndarray

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Sum of each word's weights, by language."""
        starts = np.cumsum(self.sizes) - self.sizes
        return np.add.reduceat(weights[self.flat], starts, axis=0) if len(starts) else np.empty((0, weights.shape[1]), weights.dtype)


def _index(words: list[str]) -> Index:
    found = [_features(w) for w in words]
    return Index(np.array([f for x in found for f in x], np.int64), np.array([len(x) for x in found], np.int64))


def words_of(text: str) -> list[str]:
    """Lower-case words; characters of scripts without spaces (but Thai) stand alone."""
    return _WORD.findall(text.lower())


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (words, languages) and expected transition counts, of concatenated sequences.

    All sequences move one word per step together, longest first.
    """
    n, k = len(lengths), emissions.shape[1]
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    most = int(sizes[0]) if n else 0
    active = np.searchsorted(-sizes, -np.arange(most), side="left")  # sequences longer than step t
    scores = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float64) + 1e-12
    move = np.exp(transitions - transitions.max())
    alpha = np.empty_like(scores)
    a = np.full((n, k), 1.0 / k)
    for t in range(most):
        m = active[t]
        at = first[:m] + t
        a = (a[:m] if t == 0 else a[:m] @ move) * scores[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    gamma = np.empty_like(scores)
    counts = np.zeros((k, k))
    b = np.empty((0, k))
    for t in range(most - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        if len(b):
            ahead = scores[at[: len(b)] + 1] * b
            joint_left = alpha[at[: len(b)]]
            pair = (joint_left @ move * ahead).sum(1, keepdims=True)
            counts += (joint_left / pair).T @ ahead * move
            back = ahead @ move.T
            back /= back.sum(1, keepdims=True)
            b = np.concatenate((back, np.full((m - len(back), k), 1.0 / k)))
        else:
            b = np.full((m, k), 1.0 / k)
        g = alpha[at] * b
        gamma[at] = g / g.sum(1, keepdims=True)
    return gamma, counts


def _prior() -> np.ndarray:
    """Mean of the weights: what a script says of the language."""
    out = np.zeros((BUCKETS, len(LANGS)), np.float32)
    for langs in {s[2] for s in SCRIPTS}:
        out[xxhash.xxh32_intdigest(f"c{langs}") % BUCKETS, [LANGS.index(x) for x in langs.split()]] = 4.0
    return out


def learn(articles: list[tuple[str, list[str]]]) -> Crf:
    """Fit from (stated language, block texts): each article is one sequence of words.

    Weights start from the features' odds under the labels, which blocks may change while their own
    words contradict them; then AdaGrad steps along the likelihood's gradient by forward-backward, with a
    Gaussian prior around the start.
    """
    vocabulary: dict[str, int] = {}
    tokens: list[int] = []
    blocks: list[int] = []  # block of each word
    stated: list[int] = []  # label of each block
    lengths: list[int] = []
    for lang, texts in articles:
        before = len(tokens)
        for text in texts:
            if is_encoded(text):
                continue
            known = script_label(text, lang)
            if known is None:
                continue
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            if found:
                tokens += found
                blocks += [len(stated)] * len(found)
                stated.append(LANGS.index(known))
        if len(tokens) > before:
            lengths.append(len(tokens) - before)
    k = len(LANGS)
    prior = _prior()
    weights, transitions = prior.copy(), np.eye(k) * 4.0
    if not tokens:
        return Crf(weights, transitions)
    index = _index(list(vocabulary))
    word, block, size = np.array(tokens), np.array(blocks), np.array(lengths)
    label = np.array(stated)
    ends = np.cumsum(size)
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False  # positions followed by a word of the same article
    def totals(per_word: np.ndarray) -> np.ndarray:
        """Sums over words' rows, for every feature."""
        spread = np.repeat(per_word, index.sizes, 0)
        return np.stack([np.bincount(index.flat, spread[:, j], BUCKETS) for j in range(k)], 1)

    def by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, j], n) for j in range(k)], 1)

    one = np.eye(k)
    for turn in range(3):  # start from the counts, and let blocks that their own words contradict change sides
        seen = totals(by(word, one[label[block]], len(vocabulary))) + 0.3
        odds = np.log(seen / seen.sum(0)) - np.log(seen.sum(1, keepdims=True) / seen.sum())
        weights = (prior + START * odds).astype(np.float32)
        if turn < 2:
            label = by(block, index.emissions(weights)[word], len(label)).argmax(1)
    center = weights.copy()
    seen_w, seen_t = np.full_like(weights, 1.0), np.full((k, k), 1.0)
    for _ in range(STEPS):
        gamma, expected = forward_backward(index.emissions(weights)[word], size, transitions)
        y = label[block]
        change = one[y] - gamma
        grad = totals(by(word, change, len(vocabulary))).astype(np.float32) - 0.05 * (weights - center)
        seen_w += grad**2
        weights += 0.1 * grad / np.sqrt(seen_w)
        observed = np.zeros((k, k))
        np.add.at(observed, (y[:-1][inner[:-1]], y[1:][inner[:-1]]), 1.0)
        moved = observed - expected - 0.02 * (transitions - one * 4.0)
        seen_t += moved**2
        transitions = transitions + 0.2 * moved / np.sqrt(seen_t)
    return Crf(weights, transitions)


class Tagger:
    """Languages of texts; keeps the emissions of the words it has met, up to a bound."""

    KEEP = 400_000

    def __init__(self, crf: Crf):
        self.crf = crf
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(LANGS)), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(marginals of all words, word counts by text, words)."""
        if len(self.place) > self.KEEP:
            self.place, self.table = {}, self.table[:0]
        found = [words_of(t) for t in texts]
        get = self.place.get
        fresh: dict[str, int] = {}
        flat: list[int] = []
        start = len(self.place)
        for words in found:
            for w in words:
                i = get(w)
                if i is None:
                    i = fresh.setdefault(w, start + len(fresh))
                flat.append(i)
        if fresh:
            self.place.update(fresh)
            self.table = np.concatenate((self.table, _index(list(fresh)).emissions(self.crf.weights)))
        lengths = np.array([len(w) for w in found], np.int64)
        some = lengths > 0
        gamma, _ = forward_backward(self.table[np.array(flat, np.int64)], lengths[some], self.crf.transitions)
        return gamma, lengths, found


def sample_articles(articles: DataFrame, limit: int = SAMPLE_ARTICLES) -> list[tuple[str, list[str]]]:
    """(stated language, block texts) of at most ``limit`` articles, the same ones at every run."""
    coded = articles.select("source_id", label_code(F.col("language")).alias("code"), "text").where(F.col("text").isNotNull())
    rows = lowest(coded, "source_id", limit, articles.count()).select("code", "text").collect()
    return [(r.code or "", r.text.split("\n\n")) for r in rows]


def block_languages(units: DataFrame, crf: Crf, least_chars: int = 0, segments: bool = False) -> DataFrame:
    """(source_id, unit_idx, lang, confidence, words) of distinct units, with ``segments`` if asked for.

    ``lang`` is the language of most of the words' probability, ``confidence`` its share; segments are
    arrays of (lang, words, confidence) of the runs of one most probable language. A text without words
    or of an encoded string (and a null one) has lang null and confidence 0. Only texts of at least
    ``least_chars`` code points after trimming are taken.
    """
    schema = "source_id long, unit_idx int, lang string, confidence double, words int, weights array<double>"
    schema += ", segments array<struct<lang:string,words:int,confidence:double>>" if segments else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = Tagger(crf)
        for batch in batches:
            texts = [t if t and not is_encoded(t) else "" for t in batch.column(2).to_pylist()]
            gamma, lengths, _ = tag(texts)
            ends = np.cumsum(lengths)
            total = np.zeros((len(texts), len(LANGS)))
            some = np.flatnonzero(lengths)
            if len(some):
                total[some] = np.add.reduceat(gamma, (ends - lengths)[some], axis=0)
            best = total.argmax(1)
            share = total[np.arange(len(texts)), best] / np.maximum(lengths, 1)
            out = [
                batch.column(0),
                batch.column(1),
                pa.array([LANGS[b] if n else None for b, n in zip(best, lengths)], pa.string()),
                pa.array(share, pa.float64()),
                pa.array(lengths, pa.int32()),
                pa.array(list(total), pa.list_(pa.float64())),
            ]
            names = ["source_id", "unit_idx", "lang", "confidence", "words", "weights"]
            if segments:
                top, prob = gamma.argmax(1), gamma.max(1)
                rows = []
                for n, end in zip(lengths, ends):
                    mine, p = top[end - n : end], prob[end - n : end]
                    cuts = np.flatnonzero(np.diff(mine)) + 1 if n else []
                    rows.append([{"lang": LANGS[s[0]], "words": len(s), "confidence": float(q.mean())} for s, q in zip(np.split(mine, cuts), np.split(p, cuts)) if len(s)])
                out.append(pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())]))))
                names.append("segments")
            yield pa.RecordBatch.from_arrays(out, names=names)

    own = units.select(F.col("source_id").cast("long").alias("source_id"), F.col("unit_idx").cast("int").alias("unit_idx"), "text").dropDuplicates(["source_id", "unit_idx"])
    if least_chars:
        own = own.where(F.char_length(F.regexp_replace("text", f"^[{SPACE}]+|[{SPACE}]+$", "")) >= least_chars)
    return own.mapInArrow(run, schema)


def article_languages(blocks: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(source_id, lang, confidence) from ``block_languages``: the language of most of the words' probability.

    Every article of ``blocks`` and, if given, of ``articles`` (source_id) has a row; one without words has
    lang null and confidence 0.
    """
    each = blocks.where("source_id is not null").select("source_id", F.posexplode("weights").alias("i", "p")).groupBy("source_id", "i").agg(F.sum("p").alias("p"))
    names = F.array(*(F.lit(x) for x in LANGS))
    found = each.groupBy("source_id").agg(F.max_by("i", F.struct("p", -F.col("i"))).alias("i"), F.max("p").alias("p"), F.sum("p").alias("all"))
    if articles is not None:
        every = articles.select(F.col("source_id").cast("long").alias("source_id")).where("source_id is not null").distinct()
        found = found.join(every, "source_id", "full")
    some = F.col("all") > 0
    return found.select("source_id", F.when(some, F.get(names, F.col("i"))).alias("lang"), F.when(some, F.col("p") / F.col("all")).otherwise(0.0).alias("confidence"))


def foreign_units(units: DataFrame, articles: DataFrame, crf: Crf, residue: DataFrame | None = None, least_chars: int = 40) -> DataFrame:
    """(source_id, unit_idx, lang): units in another language than their article states, or any if it states none.

    Code, tables, encoded strings, texts under ``least_chars`` and the units of ``residue``
    (source_id, unit_idx) are left out. Of several rows of one article the first label in order counts.
    """
    prose = units.where(~F.coalesce(F.col("kind").isin("code", "table"), F.lit(False)))
    found = block_languages(prose, crf, least_chars).where("lang is not null").select("source_id", "unit_idx", "lang")
    stated = articles.select("source_id", label_code(F.col("language")).alias("code")).groupBy("source_id").agg(F.min("code").alias("code"))
    cases = found.join(stated, "source_id").where(F.col("code").isNull() | (F.col("code") != F.col("lang")))
    if residue is not None:
        cases = cases.join(residue, ["source_id", "unit_idx"], "left_anti")
    return cases.select("source_id", "unit_idx", "lang")
