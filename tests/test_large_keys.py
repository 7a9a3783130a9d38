"""Queries against their SQL where copies of the smallest tables have keys as far apart as those of large ones."""

import duckdb
import pytest
from test_queries import DATA, plain, pytestmark  # noqa: F401

from pitchflow.plans import registry


def copied(folder, copies):
    """events, its copies with event and user ids shifted by the given numbers."""
    parts = " UNION ALL ".join(f"SELECT event_id + {e} AS event_id, ts, user_id + {u} AS user_id, event_type, value, props FROM '{DATA}/events.parquet'" for e, u in copies)
    duckdb.sql(f"COPY ({parts}) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["b1_team_totals", "b3_assignment_report"])
def test_groups_of_players_beyond_a_thousand(spark, tmp_path, name):
    folder = copied(tmp_path, [(0, 0), (10**6, 30_000), (2 * 10**6, 60_000)])
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    rel, df = duck.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    want = sorted(repr([plain(r[rel.columns.index(c)]) for c in columns]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want and want


def test_players_keep_their_rank_where_jobs_add_up_in_another_order(spark):
    """Scores that differ in the last bits whenever they are worked out, as averages do where blocks arrive in another order."""
    import random

    from pyspark.sql import functions as F

    from pitchflow.operators import decision

    other = F.udf(lambda v: v + random.random() * 1e-12, "double").asNondeterministic()
    rows = spark.range(400).select((F.col("id") % 40).alias("player_id"), F.lit("pass").alias("event_type"), other(F.rand(1)).alias("value"), F.lit(False).alias("low"), F.lit(None).cast("string").alias("suggested"), F.lit(0.0).alias("gain"))
    got = decision.player_summary(rows).collect()
    assert sorted(r.player_id for r in got) == list(range(40))
    assert sorted(round(r.score_rank * 40) for r in got) == list(range(1, 41)) and sum(r.needs_support for r in got) == 10
