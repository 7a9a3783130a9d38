"""Signal fusion, its insights, player priorities and calibration. Input: signals (sample_id, category, side, severity,
player_id, evidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import band, clamp
from .signals import CATEGORIES, lookup

# Default weights and thresholds, and the texts of the categories.
WEIGHTS = (0.55, 0.45)
THRESHOLDS = {"critical": 0.8, "high": 0.6, "medium": 0.4}
MESSAGES = {
    "build_up": "Build-up actions are unstable and reduce controlled progression.",
    "ball_loss": "Ball retention risk is high and creates transition exposure.",
    "progression": "Progression quality is inconsistent and limits vertical threat.",
    "final_third": "Final-third decisions reduce conversion probability.",
    "duels": "Duel execution is below target in key contests.",
    "pressing": "Pressing effectiveness is below tactical target.",
}
OBJECTIVES = {
    "build_up": "Increase pass security under pressure",
    "ball_loss": "Reduce dangerous turnovers in own half",
    "progression": "Improve vertical progression timing",
    "final_third": "Improve chance conversion decisions",
    "duels": "Improve duel win rate in contested zones",
    "pressing": "Increase high recoveries after loss",
}
HEADLINES = {
    "build_up": "Build-up instability is the main tactical risk",
    "ball_loss": "Ball-loss risk is the main tactical concern",
    "progression": "Progression consistency is the main tactical risk",
    "final_third": "Final-third decision quality is the main tactical risk",
    "duels": "Duel execution is the main tactical risk",
    "pressing": "Pressing effectiveness is the main tactical risk",
}
PLAYER_ACTIONS = {
    "build_up": "Review build-up decisions under pressure.",
    "ball_loss": "Work on safer retention choices in own-half circulation.",
    "progression": "Improve carry-vs-pass timing for progression phases.",
    "final_third": "Review final-third pass/shot selection in constrained scenarios.",
    "duels": "Improve duel timing and body orientation in contested situations.",
    "pressing": "Improve pressing trigger recognition and first reaction speed.",
}


# ---- configuration


def resolved(configs: DataFrame) -> DataFrame:
    """Configurations (baseline_weight, decision_weight, medium, high, critical; nulls for the defaults) made valid:
    weights that add up to 1, thresholds in 0..1 and each above the last."""
    number = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default))
    w, v = number("baseline_weight", WEIGHTS[0]), number("decision_weight", WEIGHTS[1])
    medium = clamp(number("medium", THRESHOLDS["medium"]))
    high = F.greatest(F.col("__m") + 0.01, F.least(F.lit(1.0), number("high", THRESHOLDS["high"])))
    critical = F.greatest(F.col("__h") + 0.01, F.least(F.lit(1.0), number("critical", THRESHOLDS["critical"])))
    c = configs.withColumn("__m", medium).withColumn("__h", high).withColumn("__c", critical)
    over = F.col("__c") > 1.0
    return c.withColumns(
        {
            "baseline_weight": F.when(w + v <= 0, WEIGHTS[0]).otherwise(w / (w + v)),
            "decision_weight": F.when(w + v <= 0, WEIGHTS[1]).otherwise(v / (w + v)),
            "medium": F.when(over, F.least("__m", F.lit(0.98))).otherwise(F.col("__m")),
            "high": F.when(over, F.least("__h", F.lit(0.99))).otherwise(F.col("__h")),
            "critical": F.least("__c", F.lit(1.0)),
        }
    ).drop("__m", "__h", "__c")


def level_of(score: Column, critical=THRESHOLDS["critical"], high=THRESHOLDS["high"], medium=THRESHOLDS["medium"]) -> Column:
    limit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return band(score, (limit(critical), "critical"), (limit(high), "high"), (limit(medium), "medium"), default="low")


# ---- fusion


def fuse(signals: DataFrame, baseline_weight: float = WEIGHTS[0], decision_weight: float = WEIGHTS[1], keys=("sample_id",)) -> DataFrame:
    """Mean severity of each side and their weighted sum by category; a missing side counts 0 and keeps its weight.

    Weights are made to add up to 1. evidence_<side>: the distinct pieces of evidence of the side, sorted.
    """
    if baseline_weight + decision_weight <= 0:
        baseline_weight, decision_weight = WEIGHTS
    a, b = baseline_weight / (baseline_weight + decision_weight), decision_weight / (baseline_weight + decision_weight)
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    side = lambda s: F.coalesce(F.avg(of(s, "severity")), F.lit(0.0)).alias(s)
    evidence = [F.sort_array(F.collect_set(of(s, "evidence"))).alias(f"evidence_{s}") for s in ("baseline", "decision")] if "evidence" in signals.columns else []
    out = signals.groupBy(*keys, "category").agg(side("baseline"), side("decision"), F.count(F.lit(1)).alias("n"), *evidence)
    return out.withColumns({"combined": a * F.col("baseline") + b * F.col("decision"), "confidence": F.least(F.lit(0.95), F.col("n") / 6.0)})


def _ranked(fused: DataFrame, k: int, keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("combined", 9)), "category")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def insights(fused: DataFrame, signals: DataFrame, k: int = 5, keys=("sample_id",)) -> DataFrame:
    """The k categories of the highest combined score, ties by name, as insights with the four players named most."""
    players = ranked_players(signals, 4, keys).groupBy(*keys, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "player_id"))), lambda x: x["player_id"]).alias("players"))
    top = _ranked(fused, k, keys).join(players, [*keys, "category"], "left")
    return top.withColumns({"type": F.concat(F.lit("risky_"), "category"), "severity": level_of(F.col("combined")), "message": lookup(F.col("category"), MESSAGES), "players": F.coalesce("players", F.array().cast("array<bigint>"))})


def training_focus(fused: DataFrame, k: int = 3, keys=("sample_id",)) -> DataFrame:
    """The k categories of the highest combined score, ties by name, with a priority and an objective."""
    return _ranked(fused, k, keys).withColumns({"priority": level_of(F.col("combined")), "objective": lookup(F.col("category"), OBJECTIVES)})


def headline(fused: DataFrame, keys=("sample_id",)) -> DataFrame:
    """One line for each sample, that of its first category."""
    return _ranked(fused, 1, keys).select(*keys, lookup(F.col("category"), HEADLINES).alias("headline"))


def ranked_players(signals: DataFrame, k: int = 3, keys=("sample_id",)) -> DataFrame:
    """The players of a category's decision signals by how often they are named, ties by id."""
    n = signals.where("side = 'decision' and player_id is not null").groupBy(*keys, "category", "player_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "category").orderBy(F.desc("n"), "player_id")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def player_priorities(signals: DataFrame, k: int = 5, keys=("sample_id",)) -> DataFrame:
    named = signals.where("side = 'decision' and player_id is not null")
    p = named.groupBy(*keys, "player_id").agg(F.count(F.lit(1)).alias("n"), F.avg("severity").alias("mean"), F.sort_array(F.collect_set("category")).alias("focus"))
    p = p.withColumns({"priority": F.least(F.lit(1.0), F.col("mean") * 0.75 + F.least(F.lit(0.25), F.col("n") * 0.03)), "categories": F.array_join("focus", ","), "action": lookup(F.get("focus", F.lit(0)), PLAYER_ACTIONS)})
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("priority", 9)), "player_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("focus")


# ---- calibration


def config_grid(spark) -> DataFrame:
    """w (of the baseline), medium, high, critical in steps of 0.05, each above the last, numbered in that order; 760 rows."""
    steps = {"w": (6, 15), "medium": (7, 10), "high": (11, 15), "critical": (15, 18)}
    tables = [spark.range(lo, hi + 1).select((F.col("id") * 5 / 100).alias(name)) for name, (lo, hi) in steps.items()]
    g = reduce(lambda a, b: a.join(F.broadcast(b)), tables).where("high > medium and critical > high")
    return g.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*steps)))


def default_config(spark) -> DataFrame:
    return spark.range(1).select(F.lit(WEIGHTS[0]).alias("w"), *[F.lit(THRESHOLDS[t]).alias(t) for t in ("medium", "high", "critical")], F.lit(0).alias("number"))


def evaluate(fused: DataFrame, truth: DataFrame, samples: DataFrame, configs: DataFrame) -> DataFrame:
    """configs x split: mae, band_accuracy, top1_accuracy, top3_recall, objective and the number of samples.

    fused: baseline and decision by sample_id and category; truth: the true severity of the same keys; samples:
    sample_id, split. All six categories count in every sample, a missing one with 0. Ties of a ranking fall to the
    category's name. configs is a bounded table; the rows of a sample meet each weight once, and each weight's
    predictions the thresholds that go with it.
    """
    each = samples.withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    dense = each.join(fused.select("sample_id", "category", "baseline", "decision"), ["sample_id", "category"], "left").join(truth.select("sample_id", "category", "truth"), ["sample_id", "category"], "left")
    known = F.col("truth").isNotNull()
    by_truth = Window.partitionBy("sample_id").orderBy(F.desc(F.when(known, F.col("truth"))), "category")
    dense = dense.withColumn("true_rank", F.when(known, F.row_number().over(by_truth))).na.fill(0.0, ["baseline", "decision", "truth"])
    pred = F.col("w") * F.col("baseline") + (1.0 - F.col("w")) * F.col("decision")
    p = dense.join(F.broadcast(configs.select("w").distinct())).withColumn("pred", pred)
    by_pred = Window.partitionBy("sample_id", "w").orderBy(F.desc(F.round("pred", 12)), "category")
    p = p.withColumn("rank", F.row_number().over(by_pred))
    mine = lambda n: (F.col("rank") <= n) & (F.col("true_rank") <= n)
    sample = p.groupBy("split", "w", "sample_id").agg(
        F.sum(F.abs(F.col("pred") - F.col("truth"))).alias("error"), F.count_if(mine(1)).alias("first"), F.count_if(mine(3)).alias("hit"), F.count_if(F.col("true_rank") <= 3).alias("three")
    )
    recall = F.when(F.col("three") > 0, F.col("hit") / F.col("three")).otherwise(0.0)
    by_weight = sample.groupBy("split", "w").agg(F.count(F.lit(1)).alias("samples"), (F.sum("error") / (len(CATEGORIES) * F.count(F.lit(1)))).alias("mae"), F.avg("first").alias("top1_accuracy"), F.avg(recall).alias("top3_recall"))
    level = lambda c: level_of(F.col(c), F.col("critical"), F.col("high"), F.col("medium"))
    bands = p.join(F.broadcast(configs), "w").groupBy("split", "number", "w", "medium", "high", "critical").agg(F.avg((level("pred") == level("truth")).cast("int")).alias("band_accuracy"))
    out = bands.join(F.broadcast(by_weight), ["split", "w"])
    return out.withColumn("objective", F.col("mae") + 0.25 * (1 - F.col("band_accuracy")) + 0.2 * (1 - F.col("top1_accuracy")) + 0.15 * (1 - F.col("top3_recall")))


def calibrated(fused: DataFrame, truth: DataFrame, samples: DataFrame, grid: DataFrame) -> DataFrame:
    """The configuration of the lowest objective on 'train' (to six digits, the earlier one of equals, the default before
    all) and the default, each with its figures on every split."""
    configs = grid.unionByName(default_config(grid.sparkSession))
    figures = evaluate(fused, truth, samples, configs)
    best = figures.where("split = 'train'").agg(F.min(F.struct(F.round(F.col("objective") + 3.3e-10, 6).alias("o"), "number")).alias("m")).select("m.number")
    chosen = figures.join(F.broadcast(best.withColumn("config", F.lit("best"))), "number")
    return chosen.unionByName(figures.where("number = 0").withColumn("config", F.lit("default")))
