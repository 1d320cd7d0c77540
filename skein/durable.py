"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local session without the setting falls back to a temporary folder; a cluster without
    it is an error, because a machine-local folder does not survive the loss of its machine.
    """
    found = spark.conf.get(SETTING, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{SETTING} must name a folder shared by all executors")
    return _local_dir()


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="skein-"))
    return _LOCAL[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and return a DataFrame that reads it back.

    Later stages (and retries after a lost executor) read files instead of recomputing the plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skein/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing will read it again."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
