"""Keyed state in streams: a status machine that refuses wrong transitions, and entries that expire by themselves.

Both need the RocksDB state store (state_store sets it) and event time with a watermark. Each has a batch twin with the same rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.scan import fold_rows

#: What may follow a status; a document begins with pending. A failed one may be tried again until LIMIT attempts failed.
MOVES = {None: ("pending",), "pending": ("processing",), "processing": ("completed", "failed"), "failed": ("processing",), "completed": ()}
LIMIT = 3


def move(state: tuple[str | None, int], status: str | None, limit: int = LIMIT) -> tuple[tuple[str | None, int], bool]:
    """((status, failed attempts), whether the step was accepted) after one event; a refused one changes nothing."""
    now, failures = state
    if status not in MOVES[now] or now == "failed" and failures >= limit:
        return state, False
    return (status, failures + (status == "failed")), True


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transitions_of_table(events: DataFrame, key: str, ts: str, status: str, event: str = "event_id", limit: int = LIMIT) -> DataFrame:
    """(key, event, ts, status, accepted, state, failures) of each event, by time and event id: the status asked for, whether it was accepted, and the state after it.

    Events with a null status are refused; repeated rows are events of their own.
    """
    def step(state, row):
        state, accepted = move(state, row[status], limit)
        return state, (accepted, *state)

    named = events.select(key, event, ts, status)
    return fold_rows(named, [key], [F.col(ts), F.col(event), F.col(status)], lambda: (None, 0), step, "accepted boolean, state string, failures int")


class _Ordered(StatefulProcessor):
    """Rows of a key held until the watermark has passed them, then handed on in the order of time and event."""

    columns = ("event", "ts", "value")

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event long, ts timestamp, value string")

    def ready(self, rows: Iterator[pd.DataFrame], timer_values) -> list[tuple]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for part in rows:
            held += [tuple(r) for r in part[list(self.columns)].itertuples(index=False)]
        mark = datetime.datetime.fromtimestamp(timer_values.getCurrentWatermarkInMs() / 1000, datetime.UTC).replace(tzinfo=None)
        naive = [(e, pd.Timestamp(t).to_pydatetime().replace(tzinfo=None), v) for e, t, v in held]
        late = [r for r in naive if r[1] > mark]
        if late:
            self.waiting.put([(e, t, v) for e, t, v in late])
            first = min(t for _, t, _ in late).replace(tzinfo=datetime.UTC)
            self.handle.registerTimer(int(first.timestamp() * 1000) + 1)
        else:
            self.waiting.clear()
        return sorted((r for r in naive if r[1] <= mark), key=lambda r: (r[1], r[0], r[2] or ""))

    def close(self) -> None:
        pass


class StatusMachine(_Ordered):
    """The statuses of a key, in order of event time however they arrive within the watermark's delay."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit = limit

    def init(self, handle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "status string, failures int")

    def _step(self, key, rows, timer_values):
        found = self.ready(rows, timer_values)
        if not found:
            return
        state = tuple(self.state.get()) if self.state.exists() else (None, 0)
        out = []
        for event, ts, status in found:
            state, accepted = move(state, status, self.limit)
            out.append((key[0], event, ts, status, accepted, *state))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["key", "event", "ts", "value", "accepted", "state", "failures"])

    def handleInputRows(self, key, rows, timerValues):
        yield from self._step(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._step(key, iter(()), timerValues)


def transitions(events: DataFrame, key: str, ts: str, status: str, event: str = "event_id", *, delay: str = "1 hour", limit: int = LIMIT) -> DataFrame:
    """transitions_of_table for a stream (append mode). An event comes out once the watermark, delay behind the latest one, has passed it;
    events that arrive later than that are lost. Times are taken as of the session's time zone, which must be UTC."""
    state_store(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), F.col(event).cast("long").alias("event"), F.col(ts).cast("timestamp").alias("ts"), F.col(status).alias("value")).withWatermark("ts", delay)
    kind = dict(events.dtypes)[key]
    made = rows.groupBy("key").transformWithStateInPandas(StatusMachine(limit), f"key {kind}, event long, ts timestamp, value string, accepted boolean, state string, failures int", "Append", "EventTime")
    return made.select(F.col("key").alias(key), F.col("event").alias(event), F.col("ts").alias(ts), F.col("value").alias(status), "accepted", "state", "failures")


class Expiring(StatefulProcessor):
    """Entries of a key, each given out when its time is over, by a timer of its own."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "entry long", "value string, expires timestamp")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            for entry, value, expires in part[["entry", "value", "expires"]].itertuples(index=False):
                at = pd.Timestamp(expires)
                self.entries.updateValue((int(entry),), (value, at.to_pydatetime()))
                self.handle.registerTimer(_ms(at))
        yield from self._over(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._over(key, expiredTimerInfo.getExpiryTimeInMs())

    def _over(self, key, now: int):
        gone = [(entry[0], value, expires) for entry, (value, expires) in self.entries.iterator() if _ms(pd.Timestamp(expires)) <= now]
        for entry, _, _ in gone:
            self.entries.removeKey((entry,))
        if gone:
            yield pd.DataFrame([(key[0], e, v, pd.Timestamp(t).to_pydatetime().replace(tzinfo=None)) for e, v, t in gone], columns=["key", "entry", "value", "expires"])

    def close(self) -> None:
        pass


def _ms(at: pd.Timestamp) -> int:
    """Milliseconds since 1970, rounded up."""
    return -((-(at.tz_localize(None) if at.tzinfo else at).value) // 1_000_000)


def expirations(entries: DataFrame, key: str, entry: str, value: str, ts: str, minutes, *, delay: str = "0 seconds") -> DataFrame:
    """(key, entry, value, expires_at) of each entry of a stream when the watermark passes the end of its life, whether or not its key gets
    new input (append mode). minutes is how long an entry lives. What has not come out is alive: unexpired is the batch twin of that."""
    state_store(entries.sparkSession)
    until = (F.col(ts) + F.make_dt_interval(mins=minutes.cast("int"))).cast("timestamp")
    rows = entries.select(F.col(key).alias("key"), F.col(entry).cast("long").alias("entry"), F.col(value).alias("value"), F.col(ts).cast("timestamp").alias("ts"), until.alias("expires")).withWatermark("ts", delay)
    kind = dict(entries.dtypes)[key]
    made = rows.groupBy("key").transformWithStateInPandas(Expiring(), f"key {kind}, entry long, value string, expires timestamp", "Append", "EventTime")
    return made.select(F.col("key").alias(key), F.col("entry").alias(entry), F.col("value").alias(value), F.col("expires").alias("expires_at"))
