"""Event insights for every match and team at once. Input: flat actions (see sources.adapters.actions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cell, in_box, safe_div, third

KEYS = ("match_id", "team_id")
ZONES = ("defensive_third", "middle_third", "attacking_third")


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")


def loss_type() -> Column:
    """An explicit loss beats a lost duel, which beats an inaccurate pass; null if the ball is kept."""
    return F.when(F.col("tag_loss"), "loss_tag").when(F.col("tag_duel_lost"), "duel_lost").when((F.col("event_type") == "pass") & (F.col("accurate") == F.lit(False)), "inaccurate_pass")


def losses(actions: DataFrame) -> DataFrame:
    return actions.withColumn("loss", loss_type()).where("loss is not null").withColumn("zone", third(F.col("x"), ZONES))


def losses_by_zone(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Losses by zone and type, and the danger score (3 defensive + middle + 0.3 attacking) / total."""
    z = [count_if(F.col("zone") == n).alias(n) for n in ZONES]
    t = [count_if(F.col("loss") == n).alias(n) for n in ("loss_tag", "duel_lost", "inaccurate_pass")]
    out = losses(actions).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *z, *t)
    return out.withColumn("danger_score", (3 * F.col(ZONES[0]) + F.col(ZONES[1]) + 0.3 * F.col(ZONES[2])) / F.col("total"))


def loss_grid(actions: DataFrame, rows: int = 8, cols: int = 12, keys=KEYS) -> DataFrame:
    return losses(actions).where("x is not null and y is not null").groupBy(*keys, cell(F.col("y"), rows).alias("row"), cell(F.col("x"), cols).alias("col")).agg(F.count(F.lit(1)).alias("n"))


def hot_cells(grid: DataFrame, k: int = 5, keys=KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "row", "col")
    return grid.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def losses_by_player(actions: DataFrame, keys=KEYS) -> DataFrame:
    return losses(actions).groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("losses"), count_if(F.col("zone") == ZONES[0]).alias("dangerous"))


def line_breaks(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Line-breaking passes: through passes, else progressive ones; completion and target zone."""
    p = actions.where("event_type = 'pass' and (tag_progressive or tag_through)").withColumn("target", third(F.col("end_x"), ZONES))
    ok = F.col("accurate") == F.lit(True)
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("tag_through")).alias("through"),
        count_if(~F.col("tag_through")).alias("progressive"),
        count_if(ok).alias("completed"),
        count_if(ok & F.col("tag_through")).alias("through_completed"),
        count_if(ok & ~F.col("tag_through")).alias("progressive_completed"),
        *[count_if(F.col("target") == z).alias(z) for z in ZONES],
    ).withColumn("completion", safe_div(F.col("completed").cast("double"), F.col("total")))


def led_to_shot(order=("sec", "event_id")) -> Column:
    """A shot by the same team within the next three events of the match, before the other team acts."""
    w = Window.partitionBy("match_id").orderBy(*order)
    out = F.lit(False)
    for n in (3, 2, 1):
        team, kind = F.lead("team_id", n).over(w), F.lead("event_type", n).over(w)
        out = F.coalesce((team == F.col("team_id")) & ((kind == "shot") | out), F.lit(False))
    return out


def line_breaks_by_player(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Line-breaking passes of each player: attempts, completed, completion and their rank by both; ties by player."""
    p = actions.where("event_type = 'pass' and (tag_progressive or tag_through) and player_id is not null")
    p = p.groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("attempts"), count_if(F.col("accurate") == F.lit(True)).alias("completed"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("attempts"), F.desc("completed"), "player_id"))
    return p.withColumns({"completion": safe_div(F.col("completed").cast("double"), F.col("attempts")), "rank": rank})


def _runs(actions: DataFrame, min_gain: float) -> DataFrame:
    """Progressive carries, and accurate progressive passes, that gain min_gain. A missing end is the start, its y 50."""
    end = {"end_x": F.coalesce("end_x", "x"), "end_y": F.coalesce("end_y", F.lit(50.0))}
    a = actions.withColumn("led", led_to_shot()).withColumns(end).withColumn("gain", F.col("end_x") - F.col("x"))
    return a.where("tag_progressive and (event_type = 'carry' or (event_type = 'pass' and accurate))").where(F.col("gain") >= min_gain)


def _run_counts() -> list[Column]:
    return [
        count_if(F.col("event_type") == "carry").alias("carries"),
        count_if(F.col("event_type") == "pass").alias("passes"),
        F.avg("gain").alias("mean_gain"),
        count_if(F.col("end_x") >= 66).alias("into_final_third"),
        count_if(in_box(F.col("end_x"), F.col("end_y"))).alias("into_box"),
        count_if(F.col("led")).alias("led_to_shot"),
    ]


def line_breaking_runs(actions: DataFrame, min_gain: float = 10.0, keys=KEYS) -> DataFrame:
    """Line-breaking runs of each player; what they reach and lead to."""
    return _runs(actions, min_gain).groupBy(*keys, "player_id").agg(*_run_counts())


def line_breaking_run_totals(actions: DataFrame, min_gain: float = 10.0, keys=KEYS) -> DataFrame:
    """The same of each team, with all runs and the player of most runs into the box, then of most runs; ties by player."""
    players = line_breaking_runs(actions, min_gain, keys)
    summed = ("carries", "passes", "into_final_third", "into_box", "led_to_shot")
    first = F.min_by("player_id", F.struct(-F.col("into_box"), -(F.col("carries") + F.col("passes")), "player_id"))
    t = players.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in summed], F.count(F.lit(1)).alias("players"), first.alias("top_runner"))
    return t.withColumn("runs", F.col("carries") + F.col("passes"))


def pressing(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Duels won by half; a period that is not 1H counts as the second half. drop = second - first half rate."""
    d = actions.where("event_type in ('ground_duel', 'aerial_duel')")
    first, won = F.col("period") == "1H", F.col("won") == F.lit(True)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("duels"), count_if(won).alias("won"), count_if(first).alias("duels_1h"), count_if(first & won).alias("won_1h"), count_if(F.col("x") > 66).alias("opponent_half")
    )
    rate = lambda n, m: safe_div(F.col(n).cast("double"), F.col(m))
    out = out.withColumn("duels_2h", F.col("duels") - F.col("duels_1h")).withColumn("won_2h", F.col("won") - F.col("won_1h"))
    return out.withColumn("win_rate", rate("won", "duels")).withColumn("drop", rate("won_2h", "duels_2h") - rate("won_1h", "duels_1h"))


def duelists(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Duels and won duels by player."""
    return actions.where("event_type in ('ground_duel', 'aerial_duel')").groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("duels"), count_if(F.col("won") == F.lit(True)).alias("won"))


def pressing_players(actions: DataFrame, k: int = 3, keys=KEYS) -> DataFrame:
    """The k players with most won duels."""
    w = Window.partitionBy(*keys).orderBy(F.desc("won"), F.desc("duels"), "player_id")
    return duelists(actions, keys).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_and_bottom(rows: DataFrame, by: str, id_col: str = "player_id", top: int = 3, bottom: int = 2, keys=KEYS) -> DataFrame:
    """The first `top` and the last `bottom` rows of each group, none twice; ties by id."""
    down = Window.partitionBy(*keys).orderBy(F.desc(by), id_col)
    up = Window.partitionBy(*keys).orderBy(by, F.desc(id_col))
    ranked = rows.withColumns({"rank": F.row_number().over(down), "__up": F.row_number().over(up)})
    return ranked.where((F.col("rank") <= top) | (F.col("__up") <= bottom)).drop("__up")


def attacks(actions: DataFrame) -> DataFrame:
    """One row for each possession: the first event gives the attack, the last one the player."""
    order = F.struct("sec", "event_id")
    return actions.where("possession_id is not null").groupBy(*KEYS, "possession_id").agg(
        *[F.min_by(c, order).alias(c) for c in ("flank", "with_shot", "with_goal", "attack_xg")], F.max_by("player_id", order).alias("player_id")
    )


def attacks_by_flank(actions: DataFrame, keys=KEYS) -> DataFrame:
    return attacks(actions).groupBy(*keys, "flank").agg(F.count(F.lit(1)).alias("attacks"), count_if(F.col("with_shot")).alias("shots"), count_if(F.col("with_goal")).alias("goals"), F.avg("attack_xg").alias("mean_xg"))


def dominant_flank(actions: DataFrame, keys=KEYS) -> DataFrame:
    """The flank with most attacks; ties go left, center, right."""
    by = attacks_by_flank(actions, keys)
    tie = F.when(F.col("flank") == "left", 3).when(F.col("flank") == "center", 2).otherwise(1)
    return by.groupBy(*keys).agg(F.max_by("flank", F.struct("attacks", tie)).alias("flank"), F.sum("attacks").alias("attacks"))


def attack_types(actions: DataFrame, types: Column, keys=KEYS) -> DataFrame:
    """Attacks, shots and goals by type; a possession counts once for each type of its first event."""
    order = F.struct("sec", "event_id")
    first = actions.where("possession_id is not null").groupBy(*keys, "possession_id").agg(*[F.min_by(c, order).alias(n) for c, n in ((F.array_distinct(types), "types"), ("with_shot", "with_shot"), ("with_goal", "with_goal"))])
    return first.withColumn("type", F.explode("types")).groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("attacks"), count_if(F.col("with_shot")).alias("shots"), count_if(F.col("with_goal")).alias("goals"))


def attackers(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Attacks by player with the preferred flank; ties go left, center, right."""
    by = attacks(actions).groupBy(*keys, "player_id", "flank").agg(F.count(F.lit(1)).alias("n"), F.sum("attack_xg").alias("x"))
    tie = F.when(F.col("flank") == "left", 3).when(F.col("flank") == "center", 2).otherwise(1)
    return by.groupBy(*keys, "player_id").agg(F.sum("n").alias("attacks"), F.sum("x").alias("xg"), F.max_by("flank", F.struct("n", tie)).alias("preferred_flank"))


def pass_nodes(actions: DataFrame, keys=KEYS) -> DataFrame:
    """Mean place and touches of each player; players without any place are dropped."""
    return actions.groupBy(*keys, "player_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count(F.lit(1)).alias("touches")).where("mean_x is not null")


def until_first_substitution(actions: DataFrame, substitutions: DataFrame, keys=KEYS) -> DataFrame:
    """The actions of each team before its first substitution; all of them where there is none."""
    cutoff = substitutions.groupBy(*keys).agg(F.min("sec").alias("__cutoff"))
    return actions.join(cutoff, list(keys), "left").where("__cutoff is null or sec < __cutoff").drop("__cutoff")


def pass_edges(actions: DataFrame, min_passes: int = 1, accurate_only: bool = True, keys=KEYS) -> DataFrame:
    p = actions.where("event_type = 'pass' and recipient_id is not null")
    p = p.where("accurate") if accurate_only else p
    return p.groupBy(*keys, F.col("player_id").alias("passer_id"), "recipient_id").agg(F.count(F.lit(1)).alias("passes")).where(F.col("passes") >= min_passes)


def named_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with the names of both ends (names: player_id, name); an unknown end has none."""
    for end in ("passer", "recipient"):
        edges = edges.join(names.select(F.col("player_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    return edges


def flank_usage(nodes: DataFrame, keys=KEYS) -> DataFrame:
    """Share of touches on each flank, by the mean place of players."""
    f = third(F.col("mean_y"), ("left", "center", "right"))
    share = lambda n: safe_div(100.0 * F.sum(F.when(f == n, F.col("touches")).otherwise(0)), F.sum("touches")).alias(n)
    return nodes.groupBy(*keys).agg(share("left"), share("center"), share("right"))


FLANKS = ("left", "center", "right")


def _touches(actions: DataFrame, keys) -> DataFrame:
    own = actions.select(*keys, "player_id", "x", "y", F.lit(0).alias("received"))
    got = actions.where("event_type = 'pass' and accurate and recipient_id is not null").select(*keys, F.col("recipient_id").alias("player_id"), F.col("end_x").alias("x"), F.col("end_y").alias("y"), F.lit(1).alias("received"))
    return own.unionByName(got).where("x is not null and y is not null")


def player_profiles(actions: DataFrame, keys=("match_id",)) -> DataFrame:
    """Touches are own events and accurate receptions at the end of the pass."""
    t = _touches(actions, keys).withColumns({"zone": third(F.col("x"), ZONES), "flank": third(F.col("y"), FLANKS)})
    return t.groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("touches"), F.sum("received").alias("receptions"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), *[count_if(F.col("zone") == z).alias(z) for z in ZONES], *[count_if(F.col("flank") == f).alias(f) for f in FLANKS])


def touch_grid(actions: DataFrame, rows: int = 8, cols: int = 12, keys=("match_id",)) -> DataFrame:
    """Touches of each player by cell of the pitch."""
    return _touches(actions, keys).groupBy(*keys, "player_id", cell(F.col("y"), rows).alias("row"), cell(F.col("x"), cols).alias("col")).agg(F.count(F.lit(1)).alias("n"))


def xg_timeline(actions: DataFrame, bucket: int = 60, keys=KEYS) -> DataFrame:
    """Cumulative xG and goals by bucket of seconds, a minute unless said otherwise, and goals minus xG."""
    b = actions.where("event_type = 'shot'").groupBy(*keys, F.floor(F.col("sec") / bucket).alias("bucket")).agg(F.sum("xg").alias("x"), count_if(F.col("is_goal")).alias("g"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    return b.select(*keys, "bucket", F.sum("x").over(w).alias("xg"), F.sum("g").over(w).alias("goals"), (F.sum("g").over(w) - F.sum("x").over(w)).alias("over_xg"))
