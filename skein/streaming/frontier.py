"""The frontier as streams: unseen URLs, and fetch times that keep each host's delay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.urls import host


def unseen(urls: DataFrame) -> DataFrame:
    """A stream of URLs without those seen before; its state is one row for each URL, in the checkpointed store."""
    return urls.dropDuplicates(["url"])


def scheduled(urls: DataFrame, delay: int = 3000) -> DataFrame:
    """A stream (url, seq) to (host, url, seq, at): each host's fetches `delay` ms apart, in order of seq within a batch."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (at,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["seq", "url"])
        times = at + delay * (pd.RangeIndex(len(rows)) + 1)
        state.update((int(at + delay * len(rows)),))
        yield pd.DataFrame({"host": key[0], "url": rows["url"].to_numpy(), "seq": rows["seq"].to_numpy(), "at": times.to_numpy()})

    keyed = urls.withColumn("host", host(F.col("url"))).groupBy("host")
    return keyed.applyInPandasWithState(step, "host string, url string, seq long, at long", "at long", "append", GroupStateTimeout.NoTimeout)
