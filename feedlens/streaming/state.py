"""Counts by command as keyed state, with a timer for the snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedlens.functions import lines as L

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PART = "name string, n bigint, bytes bigint, source string, seq bigint, first bigint"
_OUT = "name string, count bigint, bytes bigint"


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each task's sums by command, so that a frequent one sends few rows; with the size of its first line."""
    for rows in batches:
        rows = rows.sort_values(["source", "seq"], kind="stable", na_position="last")
        by = rows.groupby("name", sort=False)
        first = by.first()
        yield pd.DataFrame({"name": first.index, "n": by.size().to_numpy(), "bytes": by["size"].sum().to_numpy(), "source": first["source"].to_numpy(), "seq": by["seq"].min().to_numpy() if rows["seq"].isna().any() else first["seq"].to_numpy(), "first": first["size"].to_numpy()})


class Counter(StatefulProcessor):
    """count, bytes of a command. `compat` leaves out its first line: of the first batch that has it, the one with the least (source, seq).

    With a period the totals come when the timer of the command runs out, as often as that, and only if they have
    changed; else at each batch.
    """

    def __init__(self, compat: bool, seconds: float | None):
        self.compat, self.millis = compat, None if seconds is None else max(1, int(seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "count bigint, bytes bigint, shown bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        n, size = int(parts["n"].sum()), int(parts["bytes"].sum())
        if self.total.exists():
            count, so_far, shown = self.total.get()
        else:
            count, so_far, shown = 0, 0, -1
            if self.compat:
                n, size = n - 1, size - int(parts.sort_values(["source", "seq"], kind="stable", na_position="last")["first"].iloc[0])
            if self.millis:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        count, so_far = count + n, so_far + size
        self.total.update((count, so_far, shown if self.millis else count))
        if not self.millis:
            yield pd.DataFrame({"name": [key[0]], "count": [count], "bytes": [so_far]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, size, shown = self.total.get()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        if count != shown:
            self.total.update((count, size, count))
            yield pd.DataFrame({"name": [key[0]], "count": [count], "bytes": [size]})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs this store; a session that has chosen one keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, PROVIDER)


def by_command(lines: DataFrame, compat: bool = False, seconds: float | None = None) -> DataFrame:
    """name, count, bytes of a stream's lines that name a command, as updates: the latest row of a name counts.

    Cumulative and exact; compat as in operators.stats. Every task sums its lines up before they meet.
    """
    use_rocksdb(lines.sparkSession)
    name = L.command_bytes(F.col("line"))
    rows = lines.where(name.isNotNull()).select(F.when(F.is_valid_utf8(name), name).otherwise(F.lit("unknown")).alias("name"), F.octet_length("line").cast("long").alias("size"), F.col("source_id").alias("source"), F.col("seq").cast("long").alias("seq"))
    parts = rows.mapInPandas(_parts, _PART)
    return parts.groupBy("name").transformWithStateInPandas(Counter(compat, seconds), _OUT, "Update", "ProcessingTime" if seconds else "None")
