"""Problem 1: lines repeated across one site's articles.

Lines are keyed by a 64-bit hash of their normalized text, distinct articles are counted per
(site, hash) with two partial aggregations, thresholded by the share of the site's articles, and
joined back. A line that a third of all articles carry is one aggregated row before the join; the
join itself is on (site, hash), which adaptive skew handling splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters without a visible form.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"

# Names of months by language, lower case.
MONTHS = {
    "en": "january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec",
    "de": "januar jänner februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "hi": "जनवरी फ़रवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर सितम्बर अक्टूबर अक्तूबर नवंबर नवम्बर दिसंबर दिसम्बर",
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
    "th": "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม",
}
_MONTH = "|".join(sorted({m for names in MONTHS.values() for m in names.split()}, key=lambda m: (-len(m), m)))

_GAP = r"[^\p{L}\p{M}\p{N}]{0,4}"
#: Date expressions, over lower-cased text: day and month name with or without year, month name first,
#: and numbers with year, month and day signs. All other parts of dates are numbers.
DATE = (
    rf"\p{{N}}{{1,4}}(?:st|nd|rd|th)?{_GAP}(?:(?:de|do|of){_GAP})?(?:{_MONTH}){_GAP}(?:(?:de|do){_GAP})?(?:\p{{N}}{{2,4}})?"
    rf"|(?:{_MONTH}){_GAP}\p{{N}}{{1,4}}(?:st|nd|rd|th)?(?:{_GAP}\p{{N}}{{4}})?"
    rf"|\p{{N}}+{_GAP}[年년](?:{_GAP}\p{{N}}+{_GAP}[月월](?:{_GAP}\p{{N}}+{_GAP}[日일])?)?|\p{{N}}+{_GAP}[月월]{_GAP}\p{{N}}+{_GAP}[日일]"
)
#: Cheap necessary condition for DATE, so that the alternation of names runs on few lines: a number
#: followed by a word and another number, two numbers in a row, a word before a year, or a sign.
_MAY_HOLD_DATE = (
    rf"\p{{N}}(?:st|nd|rd|th)?{_GAP}(?:(?:de|do|of){_GAP})?[\p{{L}}\p{{M}}]{{3,12}}{_GAP}(?:(?:de|do){_GAP})?\p{{N}}{{2}}"
    rf"|\p{{N}}{{1,2}}(?:st|nd|rd|th)?[^\p{{L}}\p{{M}}\p{{N}}]{{1,4}}\p{{N}}{{4}}|[\p{{L}}\p{{M}}]{_GAP}\p{{N}}{{4}}"
    rf"|[年月日년월일]"
)


def line_key(text: Column) -> Column:
    """What stays of a line without case, spacing, punctuation, invisible characters, numbers and dates.

    Null for null and for lines in which nothing stays: they are nobody's repeated line.
    """
    plain = F.translate(F.lower(text), INVISIBLE, "")
    plain = F.when(plain.rlike(_MAY_HOLD_DATE), F.regexp_replace(plain, DATE, "")).otherwise(plain)
    return F.nullif(F.regexp_replace(plain, r"[^\p{L}\p{M}]+", ""), F.lit(""))


def site_of(url: Column) -> Column:
    """Host of a URL, lower-cased, without port, user and leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(?:www\.)+", ""), F.lit(""))


def flag_repeated(units: DataFrame, pages: DataFrame, share: float = 0.05, least: int = 4) -> DataFrame:
    """Distinct units with ``site``, ``key`` and ``repeated``.

    ``units`` needs source_id, unit_idx and text; ``pages`` page_id and final_url. Other columns are
    ignored, whatever their names. Exact duplicate rows count once (of unequal rows with one
    (source_id, unit_idx) any one stays); units without a page, a host or a
    key, and null texts, come out with ``repeated`` false. Empty tables give an empty result.
    """
    one = units.select("source_id", "unit_idx", "text", line_key(F.col("text")).alias("line"))
    one = one.withColumn("key", F.when(F.col("line").isNotNull(), F.xxhash64("line"))).drop("line")
    one = one.dropDuplicates(["source_id", "unit_idx"])
    sites = (
        pages.select(F.col("page_id").alias("source_id"), site_of(F.col("final_url")).alias("site"))
        .where("site is not null")
        .groupBy("source_id")
        .agg(F.min("site").alias("site"))
    )
    # The key is made before the shuffles, once per row: only its hash travels on.
    keyed = one.join(sites, "source_id", "left")
    lines = (
        keyed.where("site is not null and key is not null")
        .groupBy("site", "key", "source_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("site", "key")
        .agg(F.count("*").alias("articles"))
        .where(F.col("articles") >= least)
    )
    size = (
        one.select("source_id")
        .distinct()
        .join(sites, "source_id")
        .groupBy("site")
        .agg(F.count("*").alias("site_articles"))
    )
    frequent = (
        lines.join(size, "site")
        .where(F.col("articles") >= F.col("site_articles") * F.lit(share))
        .select("site", "key", F.lit(True).alias("hit"))
    )
    return keyed.join(frequent, ["site", "key"], "left").select(
        "source_id", "unit_idx", "text", "site", "key", F.coalesce("hit", F.lit(False)).alias("repeated")
    )


def without_repeated(units: DataFrame, pages: DataFrame, share: float = 0.05, least: int = 4) -> DataFrame:
    """One row per article: source_id, text (its other units in order, joined by a blank line), removed.

    An article of nothing but repeated lines comes out with an empty text.
    """
    flagged = flag_repeated(units, pages, share, least)
    kept = F.when(~F.col("repeated"), F.struct("unit_idx", F.coalesce("text", F.lit("")).alias("text")))
    return flagged.groupBy("source_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda u: u["text"]), "\n\n").alias("text"),
        F.sum(F.col("repeated").cast("long")).alias("removed"),
    )
