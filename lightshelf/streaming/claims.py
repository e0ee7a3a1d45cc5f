"""Claims with a lifetime in event time: as a stream with timers, and over a table.

An event (item_id, worker, action, ts, minutes) claims an item, renews or
releases the claim.  An item is held by one worker at a time: claims of
others are refused while it is held, the holder's own count as renewals, and
renewals and releases by those who do not hold it do nothing.  A claim ends
when it is released, or `minutes` after the last claim or renewal if none
came by then; one that comes at that very moment still counts.

The stream keeps events until the watermark has passed them and then takes
them in the order of their time, so that what comes late, but within the
watermark, is treated as if it had come in time.  Events behind the
watermark are left out.  A result (item_id, worker, begins, ends, outcome,
renewals) comes out when its claim has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = "item_id bigint, worker string, begins timestamp, ends timestamp, outcome string, renewals int"
NAMES = ["item_id", "worker", "begins", "ends", "outcome", "renewals"]


class Holding:
    """Who holds an item, since and until when; times are microseconds."""

    def __init__(self, worker: str | None = None, begins: int = 0, ends: int = 0, renewals: int = 0) -> None:
        self.worker, self.begins, self.ends, self.renewals = worker, begins, ends, renewals

    def ended(self, outcome: str, at: int) -> tuple:
        out = (self.worker, self.begins, at, outcome, self.renewals)
        self.worker = None
        return out

    def expired(self, now: int) -> list[tuple]:
        return [self.ended("expired", self.ends)] if self.worker is not None and self.ends < now else []

    def take(self, worker: str, action: str, at: int, minutes: int) -> list[tuple]:
        """What an event ends."""
        out, until = self.expired(at), at + minutes * 60_000_000
        if self.worker is None and action == "claim":
            self.worker, self.begins, self.ends, self.renewals = worker, at, until, 0
        elif self.worker == worker and self.worker is not None and action in ("claim", "renew"):
            self.ends, self.renewals = until, self.renewals + 1
        elif self.worker == worker and self.worker is not None and action == "release":
            out.append(self.ended("released", at))
        return out


class ClaimProcessor(StatefulProcessor):
    """Holds an item's events until the watermark has passed them, then follows its claims; timers stand at each event's time and at the claim's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, worker string, action string, minutes int")
        self.holding = handle.getValueState("holding", "worker string, begins bigint, ends bigint, renewals int")

    @staticmethod
    def _timer(micros: int) -> int:
        return micros // 1000 + 1  # timers are in milliseconds: one that lies behind

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            times = batch["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), w, a, int(m)) for t, w, a, m in zip(times, batch.worker, batch.action, batch.minutes)])
            for t in sorted({self._timer(int(t)) for t in times}):
                self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        held = Holding(*self.holding.get()) if self.holding.exists() else Holding()
        out = []
        for ts, worker, action, minutes in due:
            out += held.take(worker, action, ts, minutes)
        out += held.expired(now)
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if held.worker is None:
            self.holding.clear()
        else:
            self.holding.update((held.worker, held.begins, held.ends, held.renewals))
            self.handle.registerTimer(self._timer(held.ends))
        if out:
            frame = pd.DataFrame([(key[0], *r) for r in out], columns=NAMES)
            for c in ("begins", "ends"):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            yield frame

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ended claims of a stream of events; needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`)."""
    held = events.withWatermark("ts", late)
    return held.groupBy("item_id").transformWithStateInPandas(ClaimProcessor(), RESULT, "append", "eventTime")


def claim_table(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Ended and open claims of a table whose items (`by`) have one claimant each, as claims by batch do: `order` is the time and what breaks ties.

    Events that follow each other within the lifetime form a run, which a release ends too; from the first claim of a run on, the item is held.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    ts, until = F.unix_micros(F.col(order[0]).cast("timestamp")), F.unix_micros(F.col(order[0]).cast("timestamp")) + F.col("minutes").cast("bigint") * 60_000_000
    rows = events.withColumn("_t", ts).withColumn("_u", until)
    new = F.lag("_u").over(w).isNull() | (F.col("_t") > F.lag("_u").over(w)) | (F.lag("action").over(w) == "release")
    runs = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    begin = F.min(F.when(F.col("action") == "claim", F.struct(*order))).over(Window.partitionBy(*by, "_run"))
    kept = runs.withColumn("_b", begin).where(F.col("_b").isNotNull() & (F.struct(*order) >= F.col("_b")))
    last = F.max_by(F.struct("_t", "_u", "action"), F.struct(*order))
    found = kept.groupBy(*by, "_run").agg(F.min("_t").alias("_begins"), last.alias("_last"), F.count("*").alias("_n"))
    released = F.col("_last.action") == "release"
    return found.select(*by, F.timestamp_micros("_begins").alias("begins"), F.timestamp_micros(F.when(released, F.col("_last._t")).otherwise(F.col("_last._u"))).alias("ends"), F.when(released, "released").otherwise("expired").alias("outcome"), (F.col("_n") - 1 - released.cast("int")).cast("int").alias("renewals"))
