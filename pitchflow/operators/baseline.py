"""League baselines and team weaknesses. Input: team-match rows (match_id, team_id) with the totals of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.scalar import band, clamp, normal_name, safe_div, slug

KEYS = ("match_id", "team_id")
BETTER, WORSE = "higher_is_better", "higher_is_worse"
#: Metric -> (total above, totals below, direction), in the order of the metrics.
RATIOS = {
    "passSuccessRate": ("successfulPasses", ("passes",), BETTER),
    "progressivePassSuccessRate": ("successfulProgressivePasses", ("progressivePasses",), BETTER),
    "finalThirdPassSuccessRate": ("successfulPassesToFinalThird", ("passesToFinalThird",), BETTER),
    "forwardPassSuccessRate": ("successfulForwardPasses", ("forwardPasses",), BETTER),
    "progressivePassShare": ("progressivePasses", ("passes",), BETTER),
    "finalThirdEntryShare": ("passesToFinalThird", ("passes",), BETTER),
    "lossRate": ("losses", ("passes", "dribbles", "receivedPass"), WORSE),
    "ownHalfLossRate": ("ownHalfLosses", ("losses",), WORSE),
    "dangerousLossRate": ("dangerousOwnHalfLosses", ("losses",), WORSE),
    "shotOnTargetRate": ("shotsOnTarget", ("shots",), BETTER),
    "xgPerShot": ("xgShot", ("shots",), BETTER),
    "boxEfficiency": ("xgShot", ("touchInBox",), BETTER),
    "counterpressingRate": ("counterpressingRecoveries", ("recoveries",), BETTER),
    "highRecoveryRate": ("opponentHalfRecoveries", ("recoveries",), BETTER),
    "duelSuccessRate": ("duelsWon", ("duels",), BETTER),
    "defensiveDuelSuccessRate": ("defensiveDuelsWon", ("defensiveDuels",), BETTER),
    "offensiveDuelSuccessRate": ("offensiveDuelsWon", ("offensiveDuels",), BETTER),
    "aerialDuelSuccessRate": ("aerialDuelsWon", ("aerialDuels",), BETTER),
    "pressingDuelSuccessRate": ("pressingDuelsWon", ("pressingDuels",), BETTER),
}
#: The rules in their order, as (metric, test, type, title). Tests: z below -1; percentile below 25 or
#: above 75; more dangerous losses than the league; z below -1, worse still where shots miss the target too.
RULES = (
    ("progressivePassSuccessRate", "z", "build_up", "Low progressive pass success"),
    ("finalThirdPassSuccessRate", "z", "build_up", "Low success entering final third"),
    ("progressivePassShare", "low", "build_up", "Low vertical progression share"),
    ("lossRate", "high", "ball_loss", "High ball losses"),
    ("ownHalfLossRate", "high", "ball_loss", "Risky losses in own half"),
    ("dangerousLossRate", "danger", "ball_loss", "Dangerous own-half losses"),
    ("xgPerShot", "shots", "final_third", "Low-quality shot profile"),
    ("boxEfficiency", "z", "final_third", "Poor box efficiency"),
    ("shotOnTargetRate", "z", "final_third", "Low shot accuracy"),
    ("counterpressingRate", "low", "pressing", "Low counterpressing impact"),
    ("highRecoveryRate", "low", "pressing", "Few high recoveries"),
    ("pressingDuelSuccessRate", "low", "pressing", "Low pressing duel success"),
    ("duelSuccessRate", "low", "duels", "Low duel success"),
    ("defensiveDuelSuccessRate", "low", "duels", "Defensive duel weakness"),
    ("aerialDuelSuccessRate", "low", "duels", "Aerial duel weakness"),
)
#: Bucket -> (type of its insights, weight, metrics whose status counts where no rule speaks).
BUCKETS = {
    "build_up": (0.30, ("passSuccessRate", "progressivePassSuccessRate", "finalThirdPassSuccessRate", "progressivePassShare", "finalThirdEntryShare")),
    "ball_loss": (0.25, ("lossRate", "ownHalfLossRate", "dangerousLossRate")),
    "final_third": (0.20, ("shotOnTargetRate", "xgPerShot", "boxEfficiency")),
    "pressing": (0.15, ("counterpressingRate", "highRecoveryRate", "pressingDuelSuccessRate")),
    "duels": (0.10, ("duelSuccessRate", "defensiveDuelSuccessRate", "offensiveDuelSuccessRate", "aerialDuelSuccessRate")),
}
#: What a status counts for.
STATUS_SCORES = {"very_weak": 0.40, "weak": 0.22, "warning": 0.16}


# ---- ratios


def _below(totals: tuple[str, ...]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in totals), F.lit(0.0))


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def ratios(team_rows: DataFrame, spec=RATIOS) -> DataFrame:
    """Adds the metrics; 0 without a denominator and where a ratio is not finite."""
    return team_rows.withColumns({m: _finite(safe_div(F.coalesce(F.col(n), F.lit(0.0)), _below(d))) for m, (n, d, _) in spec.items()})


def ratio_report(team_rows: DataFrame, spec=RATIOS) -> DataFrame:
    """metric, zero_denominators, not_finite: how many rows each metric could not be worked out for."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    bad = lambda m, d: F.isnan(F.col(m) / _below(d)) | (F.abs(F.col(m) / _below(d)) == float("inf"))
    rows = team_rows.agg(*[n(_below(d) == 0).alias(f"{m}_z") for m, (_, d, _) in spec.items()], *[n(F.when(_below(d) != 0, bad(a, d)).otherwise(False)).alias(f"{m}_f") for m, (a, d, _) in spec.items()])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_z").alias("zero_denominators"), F.col(f"{m}_f").alias("not_finite")) for m in spec])))


def long(features: DataFrame, spec=RATIOS, keys=KEYS) -> DataFrame:
    """keys, metric, value, above (the total above the line): one row for each metric; stays long until the last projection."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.coalesce(F.col(n), F.lit(0.0)).alias("above")) for m, (n, _, _) in spec.items()]
    return features.select(*keys, F.inline(F.array(*rows)))


# ---- league


def league_baseline(values: DataFrame) -> DataFrame:
    """metric, n, mean, population std, min, max and percentiles, interpolated."""
    q = (0.1, 0.25, 0.5, 0.75, 0.9)
    b = values.where("value is not null").groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    p = ranks.quantiles(values, "value", q, ("metric",)).select("metric", *[F.get("q", F.lit(k)).alias(f"p{int(100 * x)}") for k, x in enumerate(q)])
    return b.join(F.broadcast(p), "metric")  # one row for each metric


def percentile_of(values: DataFrame) -> DataFrame:
    """metric, value, percentile: the share of values at or below each distinct one, x 100."""
    c = ranks.cumulated(ranks.counts(values, "value", ("metric",)), "value", "n", by=("metric",))
    return c.select("metric", "value", (100.0 * (F.col("before_n") + F.col("n")) / F.col("total_n")).alias("percentile"))


def percentile_among(values: DataFrame, stored: DataFrame) -> DataFrame:
    """percentile_of, of new values among stored ones, which do not hold them."""
    each = lambda rows, n: rows.where("value is not null").select("metric", "value", F.lit(n).cast("bigint").alias("stored"))
    c = each(stored, 1).unionByName(each(values, 0)).groupBy("metric", "value").agg(F.sum("stored").alias("stored"))
    c = ranks.cumulated(c, "value", "stored", by=("metric",))
    return c.where("total_stored > 0").select("metric", "value", (100.0 * (F.col("before_stored") + F.col("stored")) / F.col("total_stored")).alias("percentile"))


def compare(values: DataFrame, baseline: DataFrame, spec=RATIOS, percentiles: DataFrame | None = None) -> DataFrame:
    """z, percentile, status and is_weakness of every team, match and metric; none where the league does not vary.

    percentiles: by default among the values themselves; percentile_among for matches that the league does not hold.
    """
    spark = values.sparkSession
    directions = spark.createDataFrame([(m, d, k) for k, (m, (_, _, d)) in enumerate(spec.items())], "metric string, direction string, metric_order int")
    p = percentile_of(values) if percentiles is None else percentiles
    c = values.join(F.broadcast(baseline.select("metric", "mean", "std")), "metric", "left").join(F.broadcast(directions), "metric").join(p, ["metric", "value"], "left")
    known = F.col("std").isNotNull() & (F.col("std") != 0)
    c = c.withColumns({"z": F.when(known, (F.col("value") - F.col("mean")) / F.col("std")), "percentile": F.when(known, F.col("percentile"))})
    better = F.col("direction") == BETTER
    # The bands are closed on the side of low z, whatever the direction.
    up = band(F.col("z"), (1.5, "very_strong"), (0.75, "strong"), default="normal")
    down = band(F.col("z"), (1.5, "very_weak"), (0.75, "weak"), default="normal")
    low = lambda a, b: F.when(F.col("z") <= -1.5, a).when(F.col("z") <= -0.75, b)
    status = F.when(F.col("z").isNull(), "insufficient_data").when(better, low("very_weak", "weak").otherwise(up)).otherwise(low("very_strong", "strong").otherwise(down))
    warn = (F.col("status") == "normal") & F.when(better, F.col("percentile") <= 25).otherwise(F.col("percentile") >= 75)
    c = c.withColumn("status", status).withColumn("status", F.when(warn, "warning").otherwise(F.col("status")))
    return c.withColumn("is_weakness", F.col("status").isin("weak", "very_weak"))


def focus(rows: DataFrame, names: DataFrame, aliases: tuple[str, ...], key: str = "team_id", name: str = "name") -> DataFrame:
    """The rows of the teams that have one of the aliases for a name, whatever its accents, case and spaces."""
    wanted = F.array(*[normal_name(F.lit(a)) for a in aliases])
    mine = names.where(F.array_contains(wanted, normal_name(F.coalesce(F.col(name), F.lit("")))))
    return rows.join(mine.select(key).distinct(), key, "left_semi")


def surrogate_ids(rows: DataFrame, name: str) -> DataFrame:
    """name, id: the place of each distinct name among all in the order of their lower case, from 1."""
    names = rows.where(F.col(name).isNotNull()).select(F.lower(name).alias("folded"), name).distinct()
    folded = ranks.cumulated(names.select("folded").distinct().withColumn("one", F.lit(1)), "folded", "one")
    return names.join(folded.select("folded", (F.col("before_one") + 1).alias("id")), "folded").select(name, "id")


# ---- weaknesses


def _severity() -> Column:
    """Of a rule's row, null where its test does not hold."""
    z, p, test, mean = F.col("z"), F.col("percentile"), F.col("test"), F.col("mean")
    by_z = clamp((-1.0 - z) / 1.5)
    gap = F.when(mean <= 0, 0.0).otherwise(F.least(F.lit(1.0), (F.col("value") - mean) / mean))
    return (
        F.when((test == "z") & (z < -1.0), by_z)
        .when((test == "shots") & (z < -1.0), clamp(by_z + F.when(F.col("on_target_z") < -0.5, 0.15).otherwise(0.0)))
        .when((test == "low") & (p < 25), clamp((25.0 - p) / 25.0))
        .when((test == "high") & (p > 75), clamp((p - 75.0) / 25.0))
        .when((test == "danger") & (F.col("above") > 0) & (F.col("value") > mean), clamp(0.5 * gap + 0.5 * F.least(F.lit(1.0), F.col("above") / 3.0)))
    )


def insights(comparisons: DataFrame, top: int = 6, rules=RULES) -> DataFrame:
    """The rules that hold for each match and team, with severity, its label and confidence; the `top` most severe ones."""
    spark = comparisons.sparkSession
    table = spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], "metric string, test string, type string, title string, rule int")
    on_target = F.max(F.when(F.col("metric") == "shotOnTargetRate", F.col("z"))).over(Window.partitionBy(*KEYS))
    rows = comparisons.withColumn("on_target_z", on_target).join(F.broadcast(table), "metric").withColumn("severity", _severity()).where("severity is not null")
    rows = rows.withColumns({"confidence": clamp(0.55 + 0.45 * F.col("severity")), "label": band(F.col("severity"), (0.75, "high"), (0.45, "medium"), default="low")})
    w = Window.partitionBy(*KEYS).orderBy(F.desc(F.round("severity", 9)), "rule")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, top))


def weakness_report(comparisons: DataFrame, top: int = 6, buckets=BUCKETS) -> DataFrame:
    """The worst severity in each bucket, by rule or by status, the overall score and the risk level of every match and team."""
    found = insights(comparisons, top).select(*KEYS, F.col("type").alias("bucket"), F.col("severity").alias("score"), F.col("severity").alias("by_rule"))
    of = {m: b for b, (_, metrics) in buckets.items() for m in metrics}
    bucket = F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("metric"))
    worth = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_SCORES.items() for x in pair]), F.col("status")), F.lit(0.0))
    by_status = comparisons.select(*KEYS, bucket.alias("bucket"), worth.alias("score"), F.lit(None).cast("double").alias("by_rule"))
    worst = lambda b: F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("score"))), F.lit(0.0))
    r = found.unionByName(by_status).groupBy(*KEYS).agg(*[worst(b).alias(b) for b in buckets], F.coalesce(F.max("by_rule"), F.lit(0.0)).alias("worst"))
    weighted = clamp(sum((F.col(b) * w for b, (w, _) in buckets.items()), F.lit(0.0)))
    r = r.withColumn("overall", F.greatest(weighted, clamp(0.75 * F.col("worst"))))
    return r.withColumn("risk", band(F.col("overall"), (0.8, "high"), (0.6, "medium-high"), (0.4, "medium"), (0.2, "medium-low"), default="low"))


def final_report(comparisons: DataFrame, anomalies: DataFrame, clusters: DataFrame, top: int = 6) -> DataFrame:
    """One row for each match and team: the weakness report, its metrics and insights, and what is known of anomaly and cluster.

    anomalies: keys, anomaly_score, is_anomalous; clusters: keys, cluster, profile. What is missing there is null, false
    and 'unknown_profile'.
    """
    metrics = comparisons.groupBy(*KEYS).agg(F.count_if("is_weakness").alias("weak_metrics"), F.count(F.lit(1)).alias("metrics_compared"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    titles = insights(comparisons, top).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))
    r = weakness_report(comparisons, top).join(metrics, list(KEYS), "left").join(titles, list(KEYS), "left").join(anomalies, list(KEYS), "left").join(clusters, list(KEYS), "left")
    return r.withColumns({"titles": F.coalesce("titles", F.array().cast("array<string>")), "is_anomalous": F.coalesce("is_anomalous", F.lit(False)), "profile": F.coalesce("profile", F.lit("unknown_profile"))})


def strengths(comparisons: DataFrame, top: int = 2) -> DataFrame:
    """The strong metrics of each match and team by their distance from the league, ties in the order of the metrics."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc(F.round(F.abs("z"), 9)), "metric_order")
    return comparisons.where("status in ('strong', 'very_strong')").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, top))


def weakness_signals(comparisons: DataFrame, top: int = 6) -> DataFrame:
    """The insights as signals: an id of type and title, the category, severity and what the metric was."""
    return insights(comparisons, top).select(*KEYS, "rank", F.concat("type", F.lit("."), slug(F.col("title"))).alias("signal_id"), F.col("type").alias("category"), "severity", "label", "metric", "value", "mean", "z", "percentile", "direction")


# ---- checks


def _both_assignments(heuristic: DataFrame, strict: DataFrame, metrics, keys) -> DataFrame:
    """keys, metric, h, s, pct: the totals of both on the union of their keys, a missing side as 0, and their relative difference."""
    side = lambda rows, name: rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])))
    j = side(heuristic, "h").join(side(strict, "s"), [*keys, "metric"], "full_outer").na.fill(0.0, ["h", "s"])
    return j.withColumn("pct", 100.0 * F.abs(F.col("h") - F.col("s")) / F.greatest(F.abs("s"), F.lit(1.0)))


#: The totals that are compared, and the mean difference in percent up to which the heuristic will do.
SENSITIVE = ("passes", "losses", "xgShot", "shots", "recoveries", "duels")
SENSITIVE_PERCENT = 3.0


def sensitivity(heuristic: DataFrame, strict: DataFrame, metrics=SENSITIVE, keys=KEYS) -> DataFrame:
    """By metric: how far two assignments of players to teams differ, and the mode that all metrics together recommend."""
    d = _both_assignments(heuristic, strict, metrics, keys).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h").alias("total_heuristic"), F.sum("s").alias("total_strict"), F.avg(F.abs(F.col("h") - F.col("s"))).alias("mean_diff"), F.avg("pct").alias("mean_pct"), F.max("pct").alias("max_pct")
    )
    worst = F.max("mean_pct").over(Window.partitionBy(F.lit(1)))  # one row for each metric
    return d.withColumn("mode", F.when(worst < SENSITIVE_PERCENT, "heuristic").otherwise("strict"))


def most_sensitive(heuristic: DataFrame, strict: DataFrame, top: int = 20, metrics=SENSITIVE, keys=KEYS) -> DataFrame:
    """The `top` keys by the sum of their relative differences over the metrics."""
    d = _both_assignments(heuristic, strict, metrics, keys).groupBy(*keys).agg(F.sum("pct").alias("pct"))
    return d.orderBy(F.desc(F.round("pct", 6)), *keys).limit(top)


def checks(team_rows: DataFrame, metrics: tuple[str, ...] = (), keys=KEYS) -> DataFrame:
    """One row for each check and the number of rows, keys or matches that fail it."""
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    finite = lambda m: F.col(m).isNull() | F.isnan(m) | (F.abs(m) == float("inf"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    rows = team_rows.agg(bad(missing).alias("missing_id"), *[bad(finite(m)).alias(f"not_finite_{m}") for m in metrics])
    by_key = team_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    repeated = by_key.agg(bad(F.col("n") > 1).alias("repeated_key"))
    teams = by_key.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("teams")).agg(bad(F.col("teams") < 2).alias("under_two_teams"), bad(F.col("teams") > 2).alias("over_two_teams"))
    wide = rows.join(F.broadcast(repeated)).join(F.broadcast(teams))
    return wide.unpivot([], wide.columns, "check", "failures")
