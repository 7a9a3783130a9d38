"""Keyed match state: replaced events, restarts, late rows, the end of a match, nulls; running counts."""

import datetime as dt

from pyspark.sql import functions as F

from pitchflow.streaming import live, matches

SCHEMA = "match_id bigint, event_id bigint, sec bigint, ts timestamp, team_id bigint, ingest int, won boolean"
T0 = dt.datetime(2024, 5, 1, 12)


def row(match, event, hours=0.0, ingest=1, won=None, sec=None, team=1):
    return (match, event, event if sec is None else sec, T0 + dt.timedelta(hours=hours), team, ingest, won)


class Feed:
    """A folder that files land in, and a stream of it that can be stopped and started again."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, f"file://{path}", options

    def land(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, raw=False):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        states = matches.match_states(stream, **self.options)
        sink = matches.live_sink(states, f"{self.path}/out", lambda e: e, f"{self.path}/late")
        if raw:

            def keep(df, n):
                df.write.mode("overwrite").parquet(f"{self.path}/raw/batch={n}")

            sink = states.writeStream.outputMode("update").foreachBatch(keep)
        sink.option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()

    def now(self):
        return [(r.match_id, r.event_id, r.won) for r in live.latest(self.spark, f"{self.path}/out").collect()]

    def late(self):
        return sorted((r.match_id or 0, r.event_id or 0) for r in self.spark.read.schema(SCHEMA).parquet(f"{self.path}/late").collect())


def test_last_copies_across_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, order="ingest")
    feed.land([row(1, 1, won=True), row(1, 2), row(2, 9), row(1, 2, ingest=3, won=True), row(1, 2, ingest=2)])
    feed.run()
    feed.land([row(1, 3, sec=0), row(1, 1, ingest=0, won=False), row(1, 1, ingest=2, won=False), row(None, 5), row(3, None)])
    feed.run()  # a new query on the state of the first
    assert sorted(feed.now()) == [(1, 1, False), (1, 2, True), (1, 3, None), (2, 9, None)]
    assert feed.late() == [(0, 5), (3, 0)]
    # Only the second file was read by the second run: match 2, which it does not touch, was not given out again.
    batches = spark.read.parquet(f"{feed.path}/out").where("match_id = 2").select("batch").distinct().count()
    assert batches == 1


def test_late_rows_and_the_end_of_a_match(spark, tmp_path):
    feed = Feed(spark, tmp_path, stamp="ts", bound="2 hours", idle=3600, remember=7200)
    feed.land([row(1, 1, 0.0), row(1, 2, 1.0)])
    feed.land([row(2, 1, 2.0), row(1, 3, -5.0)])  # the watermark is at -1: row 3 is late
    feed.land([row(2, 2, 6.0), row(1, 4, 1.5)])  # at 0: an hour and a half is not late
    feed.land([row(2, 3, 6.5)])  # at 4: match 1 ends
    feed.land([row(1, 5, 6.0), row(2, 4, 3.9)])  # match 1 has ended; 3.9 is before the watermark of 4.5
    feed.run(raw=True)
    out = spark.read.parquet(f"{feed.path}/raw")
    got = {k: sorted((r.match_id, r.event_id) for r in out.where(F.col("kind") == k).collect()) for k in ("late", "ended")}
    assert got["late"] == [(1, 3), (1, 5), (2, 4)]
    assert got["ended"] == [(1, 1), (1, 2), (1, 4)]
    states = out.where("kind = 'state'").groupBy("match_id").agg(F.max("batch").alias("batch")).join(out.where("kind = 'state'"), ["match_id", "batch"])
    assert sorted((r.match_id, r.event_id) for r in states.collect()) == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 3)]
    assert out.where("kind <> 'ended'").select("match_id", "event_id").distinct().count() == 9  # none is lost


def test_out_of_order_files_without_a_bound(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.land([row(1, 5, sec=50), row(1, 4, sec=40)])
    feed.land([row(1, 1, -900.0, sec=10), row(1, 2, sec=None)])
    feed.run()
    assert sorted(e for _, e, _ in feed.now()) == [1, 2, 4, 5] and feed.late() == []


def test_running_counts_equal_the_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    rows = [row(m, e, sec=13 * e, won=e % 3 == 0, team=m + e % 2) for m in (1, 2) for e in range(40)] + [row(1, 99, sec=10_000, team=None)]
    feed.land(rows[::2])
    feed.land(rows + rows[:7])
    counted = {"events": "true", "won": "won"}
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{feed.path}/in")
    for _ in range(2):
        sink = matches.counts_sink(matches.counts_by_minute(stream, counted=counted), f"{feed.path}/counts")
        sink.option("checkpointLocation", f"{feed.path}/state").trigger(availableNow=True).start().awaitTermination()
    want = matches.counts_by_minute(spark.createDataFrame(rows, SCHEMA), counted=counted)
    got = matches.newest_counts(spark.read.parquet(f"{feed.path}/counts"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_live_queries_keep_only_columns_their_results_depend_on(spark, tmp_path, monkeypatch):
    """What goes into the state of a match is what is analysed: no column beside those."""
    import os

    import pytest

    from pitchflow.plans import retrieval
    from pitchflow.streaming import matches

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    seen = {}

    class Seen(Exception):
        pass

    def states(events, **_):
        seen["columns"] = set(events.columns)
        raise Seen

    monkeypatch.setattr(matches, "match_states", states)
    most = {"st4_live_chains": 21, "st5_late_events": 5, "st6_live_insights": 14}
    for name, n in most.items():
        with pytest.raises(Seen):
            retrieval.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(seen["columns"]) <= n, name
