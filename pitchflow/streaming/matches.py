"""The live state of matches: their events under each match, late rows apart, an end for matches that have gone quiet.

Each match is a key of a stateful operator. Its state is the list of its events, each id once, in RocksDB, so a batch
reads its own new events only; the matches it touches are given out with all their events and analysed by the batch
operators. New events are appended to the state in one step for each match; it is rewritten where events are replaced.

* The last copy of an event wins. Among copies of one batch, and against the copy in the state, that is the one of
  the highest `order`; without one, the later arrival.
* Late rows. With `stamp`, a timestamp, and `bound` the stream has a watermark: the newest stamp of the batches before,
  less the bound. Rows behind it, and rows of a match that has ended, go to the side: they are neither lost nor do
  they change the match. Without a bound rows are accepted for ever and stand where their time puts them.
* End. When the watermark passes the newest stamp of a match by `idle`, the match is given out a last time as ended
  and its events leave the state; a mark of it stays for `remember` more.

Spark drops late rows before a stateful operator by the watermark's own column. The operator gets a copy of that
column that carries no watermark, so that it sees late rows, and the watermark itself for its decisions.

Nulls, ties and edges: rows without a match or an event id go to the side. A null stamp is not late and moves nothing.
A null `clock`, which orders a match's events, comes first; equal ones are ordered by id. Repeated rows are one event.
Columns may be of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE, LATE, ENDED = "state", "late", "ended"


def _ms(stamp) -> int | None:
    """Milliseconds of a timestamp as it comes to Python, in the session's zone if it has none of its own."""
    return None if stamp is None else int((stamp if stamp.tzinfo else stamp.astimezone(timezone.utc)).timestamp() * 1000)


class MatchEvents(StatefulProcessor):
    """For each match touched its events in game order, as `state`; late rows as `late`; at its end all once more, as `ended`."""

    def __init__(self, columns: StructType, match: str, key: str, clock: str, order: str | None, stamp: str | None, idle_ms: int | None, remember_ms: int):
        self.columns, self.idle_ms, self.remember_ms = columns, idle_ms, remember_ms
        at = columns.fieldNames().index
        self.match, self.key, self.clock = at(match), at(key), at(clock)
        self.order, self.stamp = (None if c is None else at(c) for c in (order, stamp))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.columns)
        self.newest = handle.getValueState("newest", "ms bigint")
        self.ended = handle.getValueState("ended", "ms bigint")

    def _out(self, kind: str, rows) -> Iterator[Row]:
        make = Row("kind", *self.columns.fieldNames())
        for r in rows:
            yield make(kind, *r)

    def _in_order(self, events) -> list[tuple]:
        return sorted(events, key=lambda r: (r[self.clock] is not None, r[self.clock] or 0, r[self.key]))

    def _stands(self, old: tuple | None, new: tuple) -> bool:
        """Whether a copy takes the place of the one before it."""
        return old is None or self.order is None or (old[self.order] is None, old[self.order] or 0) <= (new[self.order] is None, new[self.order] or 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802
        rows, late, new = [tuple(r) for r in rows], [], {}
        mark = timerValues.getCurrentWatermarkInMs() if self.stamp is not None else -1
        ended = self.stamp is not None and self.ended.exists()
        old = {} if ended else {r[self.key]: r for r in map(tuple, self.events.get())}
        newest = None
        for r in rows:
            at = _ms(r[self.stamp]) if self.stamp is not None else None
            if ended or r[self.match] is None or r[self.key] is None or at is not None and at < mark:
                late.append(r)
            elif self._stands(new.get(r[self.key], old.get(r[self.key])), r):
                new[r[self.key]] = r
                newest = at if newest is None else max(newest, at or newest)
        if new:
            if old.keys() & new.keys():
                self.events.put(list((old | new).values()))
            else:
                self.events.appendList(list(new.values()))
            if self.idle_ms is not None and newest is not None:
                self._wait(newest)
            yield from self._out(STATE, self._in_order((old | new).values()))
        yield from self._out(LATE, late)

    def _wait(self, newest: int) -> None:
        """Moves the end of the match behind its newest stamp."""
        before = self.newest.get()[0] if self.newest.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.newest.update((newest,))
            self.handle.registerTimer(newest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.ended.exists():
            self.ended.clear()
            return
        events = self._in_order(map(tuple, self.events.get()))
        self.events.clear()
        self.newest.clear()
        self.ended.update((at,))
        self.handle.registerTimer(at + self.remember_ms)
        yield from self._out(ENDED, events)

    def close(self) -> None:
        pass


def match_states(
    events: DataFrame, match: str = "match_id", key: str = "event_id", clock: str = "sec", order: str | None = None,
    stamp: str | None = None, bound: str | None = None, idle: int | None = None, remember: int = 30 * 86_400,
) -> DataFrame:
    """A stream of kind and the columns of events. bound: an interval such as '2 hours'; idle and remember in seconds."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = StructType([StructField(f.name, f.dataType) for f in events.schema])
    if bound is not None:
        events = events.withWatermark(stamp, bound).withColumn(stamp, F.timestamp_micros(F.unix_micros(stamp)))
    timed = bound is not None
    processor = MatchEvents(columns, match, key, clock, order, stamp if timed else None, 1000 * idle if timed and idle is not None else None, 1000 * remember)
    out = StructType([StructField("kind", StringType()), *columns.fields])
    return events.groupBy(match).transformWithState(processor, out, "update", "EventTime" if timed else "None")


def live_sink(states: DataFrame, out: str, analyse: Callable[[DataFrame], DataFrame | dict[str, DataFrame]], late: str | None = None):
    """A foreachBatch sink of match_states(): snapshots of the matches a batch touches or ends, under `out` as
    live.latest() reads them, and late rows under `late`. A batch that is run again overwrites its own part."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            events = df.where(F.col("kind") != LATE).drop("kind")
            found = analyse(events)
            for name, rows in (found if isinstance(found, dict) else {"": found}).items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}" if name else f"{out}/batch={number}")
            if late:
                df.where(F.col("kind") == LATE).drop("kind").write.mode("overwrite").parquet(f"{late}/batch={number}")
        finally:
            df.unpersist()

    return states.writeStream.outputMode("update").foreachBatch(batch)


def counts_by_minute(events: DataFrame, match: str = "match_id", team: str = "team_id", key: str = "event_id", clock: str = "sec", counted: dict[str, str] | None = None) -> DataFrame:
    """Running counts by match, team and minute, of a stream's or a table's events, each counted once (its first copy).

    counted: names and conditions in SQL. In a stream it gives the groups a batch has changed, in update mode.
    """
    counted = counted or {"events": "true"}
    once = events.dropDuplicates([match, key])
    minute = F.floor(F.col(clock) / 60).cast("bigint").alias("minute")
    return once.groupBy(match, team, minute).agg(*[F.count_if(F.expr(c)).cast("bigint").alias(n) for n, c in counted.items()])


def counts_sink(counts: DataFrame, out: str):
    """Writes the groups that each batch changes under its number; newest_counts() reads them. Batches run again overwrite their own part."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(batch)


def newest_counts(counts: DataFrame, by: tuple[str, ...] = ("match_id", "team_id", "minute")) -> DataFrame:
    """The newest state of every group, from what counts_sink() wrote; null keys are groups like others."""
    rest = [c for c in counts.columns if c not in (*by, "batch")]
    newest = counts.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("n"))
    return newest.select(*by, "n.*")
