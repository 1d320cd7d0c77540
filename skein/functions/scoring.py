"""Scores of texts as native Spark expressions. All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import bind
from skein.functions.text import tokenize

# Function words without topical content.
STOPWORDS_EN = (
    "a about after all also an and any are as at be been but by can come could do does for from get go had has have he her here him his how i if in "
    "into is it its just like make may me more most my no not now of on one only or other our out over print said same see she should so some such take "
    "than that the their them then there these they this those through to too up us use very was we well were what when where which while who why will "
    "with would you your"
).split()
STOPWORDS_KO = "그 그리고 그러나 그런 그런데 그리하여 및 또는 또한 이 저 것 수 등 때 안 위 중 약 더 잘 다시 하지만 때문 통해 대한 대해 있다 없다 하다 한다 된다 이다".split()
# Phrases of page furniture.
BOILERPLATE = (
    "all rights reserved", "terms of service", "privacy policy", "cookie policy", "we use cookies", "accept cookies", "sign up for", "subscribe to our",
    "newsletter", "follow us on", "share this", "read more", "click here", "advertisement", "관련 기사", "무단 전재", "재배포 금지", "저작권자", "구독하기",
    "댓글", "광고",
)
# Weight of a unit's kind.
PRIORS = {"heading": 1.25, "paragraph": 1.0, "code": 0.95, "table": 0.9, "quote": 0.85, "list_item": 0.8}


def boilerplate_hits(text: Column) -> Column:
    """How many of the furniture phrases a text contains, each once."""
    low = F.lower(text)
    hits = F.lit(0)
    for phrase in BOILERPLATE:
        hits = hits + F.contains(low, F.lit(phrase)).cast("int")
    return hits


def density(text: Column, tokens: Column | None = None) -> Column:
    """Struct of content_ratio, numeric_ratio, type_token_ratio, boilerplate_hits and score; zeros without tokens."""
    stop = F.array(*(F.lit(w) for w in (*STOPWORDS_EN, *STOPWORDS_KO)))
    hits = boilerplate_hits(text)
    zero = F.lit(0.0)

    def measure(words: Column) -> Column:
        n = F.size(words).cast("double")
        content = F.size(F.filter(words, lambda w: ~F.array_contains(stop, w))) / n
        numeric = F.size(F.filter(words, lambda w: w.rlike("[0-9]"))) / n
        unique = F.size(F.array_distinct(words)) / n
        raw = 0.45 * content + 0.30 * unique + 0.25 * F.least(F.lit(1.0), 3.0 * numeric)
        score = raw * (1 - F.least(F.lit(0.9), 0.35 * hits)) * (0.4 + 0.6 * F.least(F.lit(1.0), n / 12.0))
        some = F.size(words) > 0
        return F.struct(
            F.when(some, content).otherwise(zero).alias("content_ratio"),
            F.when(some, numeric).otherwise(zero).alias("numeric_ratio"),
            F.when(some, unique).otherwise(zero).alias("type_token_ratio"),
            F.when(some, hits).otherwise(F.lit(0)).alias("boilerplate_hits"),
            F.when(some, F.greatest(zero, F.least(F.lit(1.0), score))).otherwise(zero).alias("score"),
        )

    return bind(tokenize(text) if tokens is None else tokens, measure)


def bm25_idf(n: Column, df: Column) -> Column:
    """R2: inverse document frequency, always positive."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is empty, null or zero, or their lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    fits = (F.size(x) == F.size(y)) & (F.size(x) > 0) & (norm > 0)
    return F.coalesce(F.when(fits, dot(x, y) / norm), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens as a share of those of the operand with the shorter token list (the first of equals)."""
    small = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(small)))


def prior(kind: Column) -> Column:
    """Weight of a unit's kind."""
    out = F.lit(1.0)
    for name, value in PRIORS.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out
