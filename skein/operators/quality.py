"""Quality measures of extracted text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import bind
from skein.functions.text import count_tokens

# Phrases that betray page furniture in extracted text.
FURNITURE = (
    "Jump to content", "Skip to main", "Skip to content", "Privacy Policy", "Terms of Service", "All rights reserved", "Cookie", "Sign in", "Log in",
    "Create account", "Subscribe to", "Follow us", "Newsletter", "Main menu", "Toggle", "Donate", "본문 바로가기", "개인정보", "이용약관", "로그인", "회원가입",
    "무단 전재",
)


def shingles(text: Column, n: int = 5) -> Column:
    """M1: distinct runs of ``n`` lower-case words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"))

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))

    return bind(words, runs)


def shingle_f1(got: Column, expected: Column) -> Column:
    """M1: struct of recall, precision and f1 of two texts' shingles; 0 where undefined."""

    def measure(pair: Column) -> Column:
        a, b, both = pair["a"], pair["b"], F.size(F.array_intersect(pair["a"], pair["b"]))
        recall = F.when(F.size(b) > 0, both / F.size(b)).otherwise(F.lit(0.0))
        precision = F.when(F.size(a) > 0, both / F.size(a)).otherwise(F.lit(0.0))
        f1 = F.when(both > 0, 2 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))
        return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))

    return bind(F.struct(shingles(got).alias("a"), shingles(expected).alias("b")), measure)


def furniture_hits(text: Column) -> Column:
    """M2: how many furniture phrases a text contains, in whatever case."""
    out, low = F.lit(0), F.lower(text)
    for phrase in FURNITURE:
        out = out + F.contains(low, F.lit(phrase.lower())).cast("int")
    return out


def answer_presence(contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """M3: (query_id, found): the share of a query's answer patterns (query_id, pattern) that its context (query_id, markdown) matches."""
    joined = answers.join(contexts.select("query_id", "markdown"), "query_id", "left")
    return joined.groupBy("query_id").agg(F.avg(F.coalesce(F.regexp_like("markdown", F.col("pattern")), F.lit(False)).cast("int")).alias("found"))


def token_cost(raw: Column, units: Column, slim: Column) -> Column:
    """M4: struct of token counts per stage."""
    return F.struct(count_tokens(raw).alias("raw"), count_tokens(units).alias("units"), count_tokens(slim).alias("slim"))
