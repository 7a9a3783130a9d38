"""Possession chains, used alike by batch queries and by the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from .insights import count_if, loss_type

#: Outcome points of a chain; a foul won counts more from FOUL_HIGH_X on.
OUTCOME_POINTS = {"goal": 25.0, "shot_on_target": 20.0, "shot_off_target": 12.0, "foul_won": 4.0, "offside": 6.0, "out_of_play": 3.0, "loss": 0.0}
FOUL_WON_HIGH, FOUL_HIGH_X = 8.0, 66.0
METHODS = ("tackle_won", "aerial_won", "interception", "loose_ball")


def result_of(kind: Column, on_target: Column, is_goal: Column, offside: Column, lost: Column) -> Column:
    """How a chain ends, from its last event."""
    shot = F.when(is_goal, "goal").when(on_target, "shot_on_target").otherwise("shot_off_target")
    return F.when(kind == "shot", shot).when(offside, "offside").when(kind == "infraction", "foul_won").when(lost.isNotNull(), "loss").otherwise("out_of_play")


def effectiveness(length: Column, progression: Column, end_x: Column, xg: Column, result: Column) -> Column:
    """0-100 from length, progression, end zone, xG and outcome."""
    points = F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOME_POINTS.items() for x in pair]), result)
    points = F.when((result == "foul_won") & (end_x >= FOUL_HIGH_X), FOUL_WON_HIGH).otherwise(points)
    return F.least(F.lit(100.0), F.least(length / 8.0, F.lit(1.0)) * 20 + clamp(progression / 80) * 20 + clamp(end_x, 0.0, 100.0) / 100 * 15 + F.least(xg * 5, F.lit(1.0)) * 20 + points)


def chains(actions: DataFrame) -> DataFrame:
    """One row for each chain: events of a possession id, however far apart; an event without one is its own chain.

    The chain's team is the possession's, else that of its first event. Chains are ordered by their first event; a
    chain that follows one of another team is a recovery. players: who took part, in the order of their first event.
    """
    order = F.struct("sec", "event_id")
    # Tables without these columns have chains without them.
    optional = {"y": "double", "end_y": "double", "period": "string"}
    actions = actions.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in actions.columns})
    a = actions.withColumn("lost", loss_type()).withColumn("chain_id", F.coalesce(F.concat(F.lit("p"), F.col("possession_id").cast("string")), F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    a = a.withColumn("chain_team", F.coalesce("possession_team_id", "team_id"))
    first = lambda c: F.min_by(c, order).alias(f"first_{c}")
    last = lambda c: F.max_by(c, order).alias(f"last_{c}")
    seen = F.array_sort(F.collect_list(F.struct("sec", "event_id", "player_id")))
    c = a.groupBy("match_id", "chain_id").agg(
        F.min(order).alias("o"),
        F.count(F.lit(1)).alias("length"),
        F.array_distinct(F.array_compact(F.transform(seen, lambda x: x["player_id"]))).alias("players"),
        F.sum(F.coalesce("xg", F.lit(0.0))).alias("xg"),
        *[first(x) for x in ("chain_team", "event_type", "won", "x", "y", "period", "set_piece", "possession_duration", "possession_end_x")],
        *[last(x) for x in ("event_type", "x", "y", "end_x", "end_y", "on_target", "is_goal", "tag_offside", "lost", "accurate")],
    )
    w = Window.partitionBy("match_id").orderBy("o")
    prev = lambda x: F.lag(x).over(w)
    c = c.withColumn("prev_team", prev("first_chain_team")).withColumn("prev_bad_pass", (prev("last_event_type") == "pass") & (prev("last_accurate") == F.lit(False)))
    recovered = F.col("first_set_piece").isNull() & (F.col("prev_team") != F.col("first_chain_team"))
    kind, won = F.col("first_event_type"), F.coalesce("first_won", F.lit(False))
    method = (
        F.when((kind == "ground_duel") & won, "tackle_won")
        .when((kind == "aerial_duel") & won, "aerial_won")
        .when(~kind.isin("ground_duel", "aerial_duel") & F.coalesce("prev_bad_pass", F.lit(False)), "interception")
        .otherwise("loose_ball")
    )
    x = F.coalesce("first_x", F.lit(0.0))
    end_x = F.when(F.col("last_event_type") == "shot", F.coalesce("last_x", x)).otherwise(F.coalesce("last_end_x", "last_x", "first_possession_end_x", x))
    y = F.coalesce("first_y", F.lit(0.0))
    end_y = F.when(F.col("last_event_type") == "shot", F.coalesce("last_y", y)).otherwise(F.coalesce("last_end_y", "last_y", y))
    no = lambda name: F.coalesce(name, F.lit(False))
    result = result_of(F.col("last_event_type"), no("last_on_target"), no("last_is_goal"), no("last_tag_offside"), F.col("last_lost"))
    # A recovery without a place counts as one in the middle.
    zone = F.coalesce("first_x", F.lit(50.0))
    c = c.select(
        "match_id",
        "chain_id",
        F.col("first_chain_team").alias("team_id"),
        F.col("o.sec").alias("start_sec"),
        F.col("first_period").alias("period"),
        F.floor(F.col("o.sec") / 60).cast("bigint").alias("minute"),
        (F.col("o.sec") % 60).cast("bigint").alias("second"),
        x.alias("start_x"),
        y.alias("start_y"),
        end_y.alias("end_y"),
        "length",
        F.coalesce("first_possession_duration", F.lit(0.0)).alias("duration"),
        "players",
        "xg",
        (end_x - x).alias("progression"),
        end_x.alias("end_x"),
        F.when(F.col("first_set_piece").isNotNull(), F.col("first_set_piece")).when(recovered, "recovery").otherwise("other").alias("trigger"),
        F.when(recovered, F.when(zone >= 66, "high").when(zone >= 33, "mid").otherwise("low")).alias("zone"),
        F.when(recovered, method).alias("method"),
        result.alias("result"),
    )
    return c.withColumn("score", effectiveness(F.col("length"), F.col("progression"), F.col("end_x"), F.col("xg"), F.col("result")))


def team_stats(chain_rows: DataFrame) -> DataFrame:
    """Means, median length (cut to a whole number), recoveries by zone, outcomes and conversion by match and team."""
    shots = F.col("result").isin("goal", "shot_on_target", "shot_off_target")
    return chain_rows.groupBy("match_id", "team_id").agg(
        F.count(F.lit(1)).alias("chains"),
        F.avg("length").alias("mean_length"),
        F.floor(F.percentile("length", 0.5)).cast("bigint").alias("median_length"),
        F.avg("duration").alias("mean_duration"),
        F.sum("xg").alias("xg"),
        F.avg("score").alias("mean_score"),
        *[count_if(F.col("zone") == z).alias(f"recoveries_{z}") for z in ("high", "mid", "low")],
        *[count_if(F.col("method") == m).alias(m) for m in METHODS],
        *[count_if(F.col("result") == r).alias(f"ended_{r}") for r in OUTCOME_POINTS],
        count_if(F.col("result") == "goal").alias("goals"),
        count_if(shots).alias("shots"),
        (count_if(shots) / F.count(F.lit(1))).alias("conversion"),
    )


def top_chains(chain_rows: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("match_id", "team_id").orderBy(F.desc(F.round("score", 6)), "start_sec", "chain_id")
    return chain_rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compare_teams(stats: DataFrame, precision: int = 3) -> DataFrame:
    """The two lowest team ids of a match side by side; the side ahead in each measure, or tie."""
    w = Window.partitionBy("match_id").orderBy("team_id")
    s = stats.withColumn("side", F.row_number().over(w)).where("side <= 2")
    names = ("chains", "mean_length", "mean_score", "xg", "recoveries_high", "conversion")
    p = s.groupBy("match_id").agg(*[F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{c}_{n}") for c in names for n in (1, 2)])
    d = lambda c: F.round(F.col(f"{c}_1") - F.col(f"{c}_2"), precision)
    return p.select("match_id", *[F.when(d(c) > 0, "home").when(d(c) < 0, "away").otherwise("tie").alias(c) for c in names])


def sides(actions: DataFrame) -> DataFrame:
    """Home and away of each match where nothing names them: the two lowest team ids, and the two teams seen first."""
    seen = actions.where("team_id is not null").groupBy("match_id", "team_id").agg(F.min(F.struct("sec", "event_id")).alias("first"))
    both = seen.groupBy("match_id").agg(F.array_sort(F.collect_list("team_id")).alias("ids"), F.array_sort(F.collect_list(F.struct("first", "team_id"))).alias("order"))
    at = lambda c, k: F.get(c, F.lit(k))
    return both.select("match_id", at("ids", 0).alias("home_id"), at("ids", 1).alias("away_id"), at("order", 0)["team_id"].alias("first_id"), at("order", 1)["team_id"].alias("second_id"))


def match_overview(actions: DataFrame) -> DataFrame:
    """Events, teams and last second of each match."""
    return actions.groupBy("match_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("team_id").alias("teams"), F.max("sec").alias("last_sec"))


def condensed(actions: DataFrame) -> DataFrame:
    """The events of each possession as an array of (sec, event_id, event_type, player_id), in order."""
    return actions.where("possession_id is not null").groupBy("match_id", "possession_id").agg(F.array_sort(F.collect_list(F.struct("sec", "event_id", "event_type", "player_id"))).alias("events"))
