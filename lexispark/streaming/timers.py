"""Timed transitions of cards: an approval stands as `approving` until a wait is over, then it is `approved`.

State per card is its pending approval; an event-time timer ends the wait. A press that takes
the approval back before then deletes state and timer. Time is that of the events: a timer
fires once the watermark has passed it, never by the clock, and a press first settles what was
over before it: a replay in other batches gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Presses that take an approval back.
TAKES_BACK = ("withdraw", "reopen", "edit", "leave")
OUT = "card string, status string, at timestamp"
_ROW = "card string, status string, ms long"


class Approvals(StatefulProcessor):
    """Rows card, kind, ms (since 1970, as timers count) -> a row when an approval begins to wait, is taken back, or has stood the wait."""

    def __init__(self, wait_seconds: int) -> None:
        self.wait = int(wait_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "at long")

    def _clear(self) -> None:
        if self.pending.exists():
            self.handle.deleteTimer(self.pending.get()[0] + self.wait)
            self.pending.clear()

    def _settle(self, card: str, now: int, out: list) -> None:
        """A wait that was over before a press is over, even if the watermark has not passed it: batches do not change the result."""
        if self.pending.exists() and self.pending.get()[0] + self.wait <= now:
            out.append((card, "approved", self.pending.get()[0] + self.wait))
            self._clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for _, kind, at in sorted((r.ts, r.kind, int(r.ms)) for part in rows for r in part.itertuples()):
            self._settle(key[0], at, out)
            if kind == "approve":
                self._clear()
                self.pending.update((at,))
                self.handle.registerTimer(at + self.wait)
                out.append((key[0], "approving", at))
            elif kind in TAKES_BACK and self.pending.exists():
                out.append((key[0], "taken back", at))
                self._clear()
        yield pd.DataFrame(out, columns=["card", "status", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        if self.pending.exists() and self.pending.get()[0] + self.wait == over:
            self.pending.clear()
            yield pd.DataFrame([(key[0], "approved", over)], columns=["card", "status", "ms"])

    def close(self) -> None:
        pass


def settled(events: DataFrame, wait_seconds: int, late: str = "0 seconds") -> DataFrame:
    """A stream of transitions (card, status, at) from a stream of presses (card, kind, ts). Needs the RocksDB state store."""
    rows = events.select(F.col("card").cast("string").alias("card"), "kind", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    made = rows.groupBy("card").transformWithStateInPandas(Approvals(wait_seconds), _ROW, "Append", "EventTime")
    return made.select("card", "status", F.timestamp_millis("ms").alias("at"))


def settled_table(events: DataFrame, wait_seconds: int, folder: str) -> DataFrame:
    """The transitions of a stream that is read to its present end, written under `folder` with the checkpoint from which the next call goes on."""
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = settled(events, wait_seconds).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, was)
    return spark.read.schema(OUT).parquet(f"{folder}/rows")
