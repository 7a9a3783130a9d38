"""Decision quality: context, labels, counterfactual choice and summaries. Input: flat actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.scalar import clip_range
from ..sources.shared import written
from .insights import count_if

ORDER = ("sec", "event_id")
ACTIONS = ("pass", "shot", "carry")
#: The features of the decision model.
CATEGORICAL = ("event_type", "position", "period", "team_id", "flank", "prev_type", "prev_position")
NUMERIC = ("minute", "second", "x", "y", "goal_distance", "goal_angle", "zone_x", "zone_y", "final_third", "box", "is_focus", "prev_x", "prev_y", "gap", "same_player", "same_possession")


def context(actions: DataFrame, focus_team: int | None = None) -> DataFrame:
    """Previous action of the team in the match: type, position, place, gap in seconds, same player, same possession;
    distance and angle to goal, zones. Missing places are 0, missing positions and periods 'UNK'; without a previous
    action its type and position are 'none' and its place is the action's own."""
    a = actions.where(F.col("event_type").isin(*ACTIONS))
    a = a.withColumns({"x": F.coalesce("x", F.lit(0.0)), "y": F.coalesce("y", F.lit(0.0)), "position": F.coalesce("position", F.lit("UNK")), "period": F.coalesce("period", F.lit("UNK")), "flank": F.coalesce("flank", F.lit("unknown"))})
    w = Window.partitionBy("match_id", "team_id").orderBy(*ORDER)
    prev = lambda c: F.lag(c).over(w)
    dx, dy = 100 - F.col("x"), 50 - F.col("y")
    zone = lambda c: clip_range(F.floor(F.col(c) / 10), 0, 9).cast("bigint")
    return a.withColumns(
        {
            "prev_type": F.coalesce(prev("event_type"), F.lit("none")),
            "prev_position": F.coalesce(prev("position"), F.lit("none")),
            "prev_x": F.coalesce(prev("x"), F.col("x")),
            "prev_y": F.coalesce(prev("y"), F.col("y")),
            "gap": F.greatest(F.lit(0), F.coalesce(F.col("sec") - prev("sec"), F.lit(0))),
            "same_player": F.coalesce(prev("player_id") == F.col("player_id"), F.lit(False)),
            "same_possession": F.coalesce(prev("possession_id") == F.col("possession_id"), F.lit(False)),
            "goal_distance": F.sqrt(dx * dx + dy * dy),
            "goal_angle": F.degrees(F.atan2(F.abs(dy), dx + 1e-6)),
            "zone_x": zone("x"),
            "zone_y": zone("y"),
            "final_third": F.col("x") >= 66.7,
            "box": (F.col("x") >= 83.0) & F.col("y").between(21.0, 79.0),
            "is_focus": F.lit(False) if focus_team is None else F.col("team_id") == focus_team,
        }
    )


def label(actions: DataFrame, seconds: int = 10) -> DataFrame:
    """1 if the team shoots or scores in (t, t + seconds] of the match."""
    a = actions.where(F.col("event_type").isin(*ACTIONS))
    w = Window.partitionBy("match_id", "team_id").orderBy("sec").rangeBetween(1, seconds)
    hit = (F.col("event_type") == "shot") | F.coalesce("is_goal", F.lit(False))
    return a.withColumn("label", F.coalesce(F.max(F.when(hit, 1).otherwise(0)).over(w), F.lit(0)))


def feature_matrix(labelled: DataFrame, focus_team: int | None = None) -> DataFrame:
    """Keys, label and the features of every action: categories as text, 'unknown' where missing, numbers as doubles, 0 where missing."""
    c = context(labelled, focus_team).withColumns({"minute": F.floor(F.col("sec") / 60), "second": F.col("sec") % 60})
    text = [F.coalesce(F.col(x).cast("string"), F.lit("unknown")).alias(x) for x in CATEGORICAL]
    return c.select("event_id", "match_id", "player_id", "label", *text, *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in NUMERIC])


def choose(scored: DataFrame, quantile: float = 0.25, min_gain: float = 0.02) -> DataFrame:
    """Best action (ties pass, shot, carry), gain, low flag at the quantile of the frame, suggestion.

    scored: actions with p_pass, p_shot, p_carry and value, the score of the action taken.
    """
    best = F.greatest("p_pass", "p_shot", "p_carry")
    kind = F.when(F.col("p_pass") == best, "pass").when(F.col("p_shot") == best, "shot").otherwise("carry")
    limit = ranks.quantile(scored, "value", quantile)
    out = scored.join(F.broadcast(limit), how="left").withColumns({"best": kind, "best_value": best, "gain": best - F.col("value"), "low": F.col("value") <= F.col("limit")}).drop("limit")
    return out.withColumn("suggested", F.when(F.col("low") & (F.col("best") != F.col("event_type")) & (F.col("gain") >= min_gain), F.col("best")))


def average_rank(rows: DataFrame, value: str) -> DataFrame:
    """value -> its average-tie percentile rank among all rows."""
    c = ranks.cumulated(ranks.counts(rows, value), value, "n")
    return c.select(value, ((F.col("before_n") + (F.col("n") + 1) / 2) / F.col("total_n")).alias("rank"))


def player_summary(chosen: DataFrame, min_actions: int = 3) -> DataFrame:
    """Scores and suggestions by player: the suggestion made most often (ties pass, shot, carry), the best and the
    weakest type of action by mean score (ties by name), the percentile rank and who needs support."""
    of = lambda a, x: F.when(F.col("event_type") == a, F.col(x))
    suggested = F.col("suggested").isNotNull()
    p = chosen.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("actions"), F.avg("value").alias("score"), count_if(F.col("low")).alias("low_actions"), count_if(suggested).alias("suggestions"),
        F.coalesce(F.avg(F.when(suggested, F.col("gain"))), F.lit(0.0)).alias("mean_gain"), *[count_if(F.col("suggested") == a).alias(f"__s_{a}") for a in ACTIONS], *[F.avg(of(a, "value")).alias(f"__v_{a}") for a in ACTIONS],
    )
    most = F.greatest(*[F.col(f"__s_{a}") for a in ACTIONS])
    usual = F.coalesce(*[F.when((F.col(f"__s_{a}") == most) & (most > 0), F.lit(a)) for a in ACTIONS])

    def extreme(pick) -> Column:
        at = pick(*[F.col(f"__v_{a}") for a in ACTIONS])
        return F.coalesce(*[F.when(F.col(f"__v_{a}") == at, F.lit(a)) for a in sorted(ACTIONS)])

    p = p.withColumns({"usual_suggestion": usual, "best_type": extreme(F.greatest), "weak_type": extreme(F.least)}).drop(*[f"__{x}_{a}" for x in "sv" for a in ACTIONS])
    # Averages of doubles depend on the order of their rows, which differs from job to job on a cluster. Ranks and the limit
    # are found by equal scores, so all begin from scores that are written once.
    p = written(p, "player-summary")
    limit = ranks.quantile(p, "score", 0.25)
    p = p.join(average_rank(p, "score").withColumnRenamed("rank", "score_rank"), "score").join(F.broadcast(limit), how="left")
    return p.withColumn("needs_support", (F.col("score") <= F.col("limit")) & (F.col("actions") >= min_actions)).drop("limit")


def timeline(chosen: DataFrame, seconds: int = 900) -> DataFrame:
    return chosen.groupBy("match_id", (F.floor(F.col("sec") / seconds) * seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("actions"), F.avg("value").alias("value"), count_if(F.col("low")).alias("low"), count_if(F.col("suggested").isNotNull()).alias("with_alternative"))


def by_type(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy(F.col("event_type").alias("decision")).agg(F.count(F.lit(1)).alias("actions"), F.avg("value").alias("value"), F.avg("gain").alias("gain"), count_if(F.col("low")).alias("low"))


def all_missed(chosen: DataFrame, min_gain: float = 0.02) -> DataFrame:
    """Actions that could have been among the best 15 % and brought neither goal nor shot on target."""
    limit = ranks.quantile(chosen, "best_value", 0.85)
    m = chosen.join(F.broadcast(limit), how="left").where((F.col("best_value") >= F.col("limit")) & (F.col("gain") >= min_gain) & ~F.coalesce("is_goal", F.lit(False)) & ~F.coalesce("on_target", F.lit(False)))
    return m.drop("limit")


def _top_of_match(rows: DataFrame, value: str, top: int) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy(F.desc(F.round(value, 9)), "event_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def missed(chosen: DataFrame, min_gain: float = 0.02, top: int = 5) -> DataFrame:
    """The missed chances of each match with the largest gains."""
    return _top_of_match(all_missed(chosen, min_gain), "gain", top)


def phases(chosen: DataFrame, top: int = 5) -> DataFrame:
    """The best, the most improvable and the most clearly missed phases of each match."""
    parts = {"best": (chosen, "value"), "improvable": (chosen.where("suggested is not null"), "gain"), "missed": (all_missed(chosen), "gain")}
    found = [_top_of_match(rows, by, top).select("match_id", F.lit(name).alias("section"), "rank", "event_id", "value", "gain") for name, (rows, by) in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def player_sections(players: DataFrame, top: int = 5) -> DataFrame:
    """The best players, the weakest ones and the weakest of those who need support; ranks are given to the `top` rows only."""
    score = F.round("score", 9)
    parts = {"top": (players, score.desc()), "under": (players, score.asc()), "support": (players.where("needs_support"), score.asc())}
    found = [rows.orderBy(order, "player_id").limit(top).select(F.lit(name).alias("section"), "player_id", "score", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order, "player_id")).alias("rank")) for name, (rows, order) in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def match_summary(chosen: DataFrame, top: int = 5) -> DataFrame:
    """Totals of each match; missed_listed is missed_total held to the length of the list."""
    m = chosen.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("actions"), F.countDistinct("player_id").alias("players"), F.avg("value").alias("value"), count_if(F.col("low")).alias("low"), count_if(F.col("suggested").isNotNull()).alias("with_alternative")
    )
    total = all_missed(chosen).groupBy("match_id").agg(F.count(F.lit(1)).alias("missed_total"))
    return m.join(total, "match_id", "left").na.fill(0, ["missed_total"]).withColumn("missed_listed", F.least("missed_total", F.lit(top).cast("bigint")))


def alternatives(chosen: DataFrame) -> DataFrame:
    """All three actions by their values, ties pass, shot, carry: `ranked`, comma-joined."""
    scored = F.array_sort(F.array(*[F.struct((-F.col(f"p_{a}")).alias("v"), F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(ACTIONS)]))
    return chosen.withColumn("ranked", F.array_join(F.transform(scored, lambda x: x["a"]), ","))


def phase_of_player(chosen: DataFrame) -> DataFrame:
    """The phase of each player and match with the largest gain, its alternatives ranked; ties to the earlier event."""
    w = Window.partitionBy("match_id", "player_id").orderBy(F.desc(F.round("gain", 9)), "sec", "event_id")
    return alternatives(chosen).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def lookup_phases(chosen: DataFrame, lookups: DataFrame) -> DataFrame:
    """For each lookup (lookup_id, match_id and, null for any, event_id, minute, second, player_id) the matching phase of
    the largest gain, ties to the lower value and the earlier event, its alternatives ranked, and how many matched."""
    asked = lookups.select("lookup_id", "match_id", *[F.col(c).alias(f"__{c}") for c in ("event_id", "minute", "second", "player_id")])
    c = alternatives(chosen).withColumns({"minute": F.floor(F.col("sec") / 60), "second": F.col("sec") % 60})
    same = lambda x: F.col(f"__{x}").isNull() | (F.col(f"__{x}") == F.col(x))
    found = c.join(asked, "match_id").where(same("event_id") & same("minute") & same("second") & same("player_id"))
    best = F.min_by(F.struct("event_id", "player_id", "event_type", "best", "suggested", "ranked", "gain", "value"), F.struct(-F.round("gain", 9), F.round("value", 9), "sec", "event_id"))
    return found.groupBy("lookup_id").agg(F.count(F.lit(1)).alias("matched"), best.alias("p")).select("lookup_id", "matched", "p.*")


def evaluation(rows: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """ROC AUC, average precision and Brier score, exact, from counts by distinct score, for each `by`; AUC is null with one class."""
    c = rows.groupBy(*by, p).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"))
    c = ranks.cumulated(c, p, "pos", "n", by=by, descending=True)
    neg, above = F.col("n") - F.col("pos"), F.col("before_pos")
    ap = F.when(F.col("pos") > 0, F.col("pos") * (above + F.col("pos")) / (F.col("before_n") + F.col("n"))).otherwise(0.0)
    sums = [F.sum(neg * above + neg * F.col("pos") / 2).alias("u"), F.sum("pos").alias("P"), F.sum(neg).alias("N"), F.sum(ap).alias("ap"), F.sum("sq").alias("sq")]
    a = c.groupBy(*by).agg(*sums) if by else c.agg(*sums)
    both, n = (F.col("P") > 0) & (F.col("N") > 0), F.col("P") + F.col("N")
    return a.select(
        *by,
        F.when(both, F.col("u") / (F.col("P") * F.col("N"))).alias("auc"),
        F.when(F.col("P") > 0, F.col("ap") / F.col("P")).otherwise(0.0).alias("average_precision"),
        (F.col("sq") / n).alias("brier"),
        n.cast("bigint").alias("n"),
    )
