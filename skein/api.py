"""SQL names for the scalar functions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.html.extract import extract_one
from skein.html.markdown import plain
from skein.html.tree import repair
from skein.sources.documents import feed_items
from skein.sources.recorded import register as register_recorded


def _native(spark: SparkSession, name: str, expression: str, returns: str) -> None:
    """A SQL function whose body is inlined by the optimizer: no Python at run time."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {returns} RETURN {expression}")




def register(spark: SparkSession) -> None:
    """Register count_tokens and normalize_ws as inlined SQL functions; strip_markdown and repair_markup as Arrow functions; extract_units and feed_items as table functions."""
    from skein.functions.text import CJK, SPACE

    rest = f"regexp_replace(text, '[{CJK}]', '')".replace("\\", "\\\\")
    _native(spark, "count_tokens", f"CAST(ceil(octet_length({rest}) / 4) + ceil((char_length(text) - char_length({rest})) / 1.4D) AS INT)", "INT")
    _native(spark, "normalize_ws", f"trim(regexp_replace(text, '[{SPACE}]+', ' '))".replace("\\", "\\\\"), "STRING")

    @F.udf("string", useArrow=True)
    def strip_markdown(text: str | None) -> str | None:
        return None if text is None else plain(text)

    @F.udf("string", useArrow=True)
    def repair_markup(html: str | None) -> str | None:
        return None if html is None else repair(html)

    spark.udf.register("strip_markdown", strip_markdown)
    spark.udf.register("repair_markup", repair_markup)

    @F.udtf(returnType="unit_idx int, kind string, level int, text string, markdown string, heading_path array<string>, tokens int")
    class ExtractUnits:
        def eval(self, html: str, url: str) -> Iterator[tuple]:
            for u in extract_one(html or "", url)["units"]:
                yield u["position"], u["kind"], u["level"], u["text"], u["markdown"], u["heading_path"], u["tokens"]

    @F.udtf(returnType="title string, link string, summary string, published string")
    class FeedItems:
        def eval(self, source: str) -> Iterator[tuple]:
            for x in feed_items(source or ""):
                yield x["title"], x["link"], x["summary"], x["published"]

    spark.udtf.register("extract_units", ExtractUnits)
    spark.udtf.register("feed_items", FeedItems)
    register_recorded(spark)
