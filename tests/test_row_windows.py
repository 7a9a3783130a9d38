"""Windows over a player's rows in one pass, against plain Python, with nulls, new players and small batches."""

import random

import numpy as np
import pytest

from pitchflow.operators import load


@pytest.mark.parametrize("size", [3, 10_000])
def test_row_windows_equal_plain_ones(spark, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rng = random.Random(size)
        rows = [(p, d, None if rng.random() < 0.2 else rng.gauss(5, 3), float(d)) for p in (*range(6), None) for d in range(rng.choice([1, 4, 30]))]
        specs = {"s3": ("a", -2, 0, "sum"), "m5": ("a", -4, 0, "mean"), "d5": ("a", -4, 0, "std"), "before": ("b", -6, -3, "sum"), "all28": ("b", -27, 0, "mean")}
        df = spark.createDataFrame(rows, "player_id bigint, day bigint, a double, b double").where("player_id is not null").repartition(5)
        got = {(r.player_id, r.day): r for r in load.row_windows(df, specs).collect()}
        assert len(got) == sum(r[0] is not None for r in rows)
        for (p, d), r in got.items():
            mine = sorted(x for x in rows if x[0] == p)
            for name, (metric, first, last, kind) in specs.items():
                window = [x[2 if metric == "a" else 3] for x in mine[max(0, d + first) : max(0, d + last + 1)]]
                window = [x for x in window if x is not None]
                want = {"sum": np.sum, "mean": np.mean, "std": np.std}[kind](window) if window else None
                assert r[name] is None if want is None else abs(r[name] - want) < 1e-9
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert load.row_windows(df.limit(0), specs).count() == 0
