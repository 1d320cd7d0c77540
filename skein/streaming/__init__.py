"""Streams: the stateless stages run on them unchanged; here is what needs state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.url import canonical_url, part


def first_sights(pages: DataFrame, time: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Pages of a stream whose canonical URL was not seen within the watermark; URLs without one are dropped."""
    keyed = pages.withColumn("key", canonical_url(F.col("url"))).where("key is not null")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def site_counts(pages: DataFrame, time: str = "fetched_at", delay: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(window, host, pages) of a stream, in tumbling windows of event time."""
    host = F.lower(part(F.col("final_url"), 2))
    return pages.withWatermark(time, delay).groupBy(F.window(time, width), host.alias("host")).agg(F.count("*").alias("pages"))


def paced(requests: DataFrame, per_host_delay: float = 0.25) -> DataFrame:
    """(host, url, start_s) of a stream of requests (url, at_s): each host's requests are at least a delay apart.

    A host's next free slot is kept state; requests of one batch are served in order of time and url.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        asked = pd.concat(list(batches)).sort_values(["at_s", "url"])
        starts = []
        for at in asked["at_s"]:
            start = max(float(at), free)
            starts.append(start)
            free = start + per_host_delay
        state.update((free,))
        yield pd.DataFrame({"host": key[0], "url": asked["url"].to_numpy(), "start_s": starts})

    host = F.lower(part(F.col("url"), 2))
    keyed = requests.select(host.alias("host"), "url", "at_s").groupBy("host")
    return keyed.applyInPandasWithState(serve, "host string, url string, start_s double", "free double", "append", GroupStateTimeout.NoTimeout)
