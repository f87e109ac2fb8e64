"""Structured Streaming forms: additions to the batch operators, for continuous arrival.

Normalizers, gates and rule matching are plain column expressions and work on a stream as
they are. Operators that need a whole batch (balancing, ranks) stay in batch or go into
``upserted`` with their full keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_within(stream: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """The first row of each key within a time to live; state older than that is dropped."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, late: str, length: str, slide: str | None, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates per event-time window (tumbling, or sliding with ``slide``) and keys; rows later than ``late`` are left out."""
    frame = F.window(at, length, slide) if slide else F.window(at, length)
    out = stream.withWatermark(at, late).groupBy(frame.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(stream: DataFrame, at: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions of each key: start, end and number of rows without a pause longer than ``gap``."""
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_totals(stream: DataFrame, key: str, amount: str, limit: int, idle_ms: int | None = None) -> DataFrame:
    """After each batch, every touched key's total of whole-number amounts so far and whether it reached ``limit``.

    With ``idle_ms`` the state of a key that stays idle that long is dropped (for queries that run on). NULL and negative amounts count as 0.
    """

    def add(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = (state.get[0] if state.exists else 0) + int(sum(p["amount"].fillna(0).clip(lower=0).sum() for p in parts))
        state.update((total,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": [keys[0]], "total": [total], "exhausted": [total >= limit]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(amount).cast("long").alias("amount"))
    return rows.groupBy("key").applyInPandasWithState(add, "key string, total long, exhausted boolean", "total long", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def upserted(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Write each micro-batch to its own folder, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Progress(StreamingQueryListener):
    """Calls ``told`` with the name of a query and the rows it has read so far, whenever another ``every`` rows are through.

    Register it with ``spark.streams.addListener``.
    """

    def __init__(self, told: Callable[[str, int], None], every: int = 25) -> None:
        self.told, self.every = told, every
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        before = self.rows.get(str(p.id), 0)
        after = self.rows[str(p.id)] = before + max(0, p.numInputRows)
        if after // self.every > before // self.every:
            self.told(p.name or str(p.id), after)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(str(event.id), None)
