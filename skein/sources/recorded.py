"""``spark.read.format("recorded_pages")``: pages recorded as one JSON object per line.

Options: ``path`` (a file or a folder of ``.jsonl`` files), ``textual`` (``true`` drops pages of other types).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "url final_url status content_type body elapsed_ms rendered".split()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        path = self.options.get("path")
        if not path:
            raise ValueError("recorded_pages needs the option path")
        names = [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".jsonl"))
        return [_File(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple[Any, ...]]:
        textual = self.options.get("textual", "false").lower() == "true"
        with open(partition.path, encoding="utf-8") as f:  # type: ignore[attr-defined]
            for line in f:
                if not line.strip():
                    continue
                page = json.loads(line)
                kind = (page.get("content_type") or "text/").lower()
                if textual and not kind.strip().startswith(("text/", "application/xhtml", "application/xml", "application/json")):
                    continue
                page.setdefault("final_url", page.get("url"))
                page["rendered"] = bool(page.get("rendered"))
                yield tuple(page.get(k) for k in FIELDS)


class RecordedPages(DataSource):
    """Pages that a crawler wrote down."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "url string, final_url string, status int, content_type string, body string, elapsed_ms long, rendered boolean"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)


def read_recorded(spark: SparkSession, path: str, textual: bool = False) -> DataFrame:
    """Recorded pages from any file system that Spark reads; large files are split. The same rows as ``recorded_pages``.

    A missing final_url is the url, a missing ``rendered`` false; blank and broken lines are left out.
    """
    raw = spark.read.schema(RecordedPages.schema(None) + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)  # type: ignore[arg-type]
    own = raw.where("_broken is null and url is not null").withColumn("final_url", F.coalesce("final_url", "url")).withColumn("rendered", F.coalesce("rendered", F.lit(False)))
    if textual:
        own = own.where(F.lower(F.coalesce("content_type", F.lit("text/"))).rlike(r"^\s*(?:text/|application/(?:xhtml|xml|json))"))
    return own.select(*FIELDS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPages)
