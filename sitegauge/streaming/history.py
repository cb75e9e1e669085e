"""Streams: history ingestion with late data, scores by hour, and the judgment cache as keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.judgment import TTL_SECONDS


def ingest(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of runs (id, url, timestamp, score, verdict) to the history, repeated ids once within a day."""
    fresh = runs.withWatermark("timestamp", "1 day").dropDuplicatesWithinWatermark(["id"])
    out = fresh.withColumn("day", F.to_date("timestamp")).writeStream.format("parquet").partitionBy("day")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """window_start, url, n, mean_score of each hour; runs later than `late` don't count."""
    df = runs.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour"), "url").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return df.select(F.col("window.start").alias("window_start"), "url", "n", "mean_score")


def cached_judgments(requests: DataFrame, ttl: float = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """cache_key, id, created_at, cached: a request is a hit if the last miss of its key is younger than ttl; a hit doesn't renew it.

    requests: cache_key, id, timestamp. The state of a key is one number; it
    goes once the watermark has passed the end of its life.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        last = state.get[0] if state.exists else float("-inf")
        cached = []
        for at in rows["created_at"]:
            hit = last > at - ttl
            cached.append(hit)
            if not hit:
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"cache_key": key[0], "id": rows["id"], "created_at": rows["created_at"], "cached": cached})

    timed = requests.withWatermark("timestamp", late).withColumn("created_at", F.unix_micros("timestamp") / 1e6)
    return timed.groupBy("cache_key").applyInPandasWithState(
        run, "cache_key string, id long, created_at double, cached boolean", "created_at double", "append", GroupStateTimeout.EventTimeTimeout
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
