"""What comes before fusion: checks of inputs and signals of both sides with one severity scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, safe_div

# The categories, those of metrics and decisions, and the severities of labels.
CATEGORIES = ("ball_loss", "build_up", "duels", "final_third", "pressing", "progression")
OF_METRIC = {
    "progressivePassSuccessRate": "build_up", "finalThirdPassSuccessRate": "build_up", "passSuccessRate": "build_up", "forwardPassSuccessRate": "progression",
    "lossRate": "ball_loss", "ownHalfLossRate": "ball_loss", "dangerousLossRate": "ball_loss", "xgPerShot": "final_third", "boxEfficiency": "final_third",
    "shotOnTargetRate": "final_third", "duelSuccessRate": "duels", "defensiveDuelSuccessRate": "duels", "offensiveDuelSuccessRate": "duels",
    "aerialDuelSuccessRate": "duels", "highRecoveryRate": "pressing", "counterpressingRate": "pressing",
}
OF_DECISION = {"pass": "build_up", "carry": "progression", "shot": "final_third"}
REASONS = ("improvable_phase", "missed_shot_or_goal_opportunity", "player_needs_support", "low_decision_phases")
OF_LABEL = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 0.95}


def lookup(key: Column, values: dict, default=None) -> Column:
    """A table of the configuration as a map in the plan."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def errors(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows that lack required fields, with `errors`: the names of those fields, in their order."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in required]), lambda x: x.isNotNull())
    return rows.withColumn("errors", missing).where(F.size("errors") > 0)


def baseline_signals(raw: DataFrame) -> DataFrame:
    """raw (category, metric, score, label) with a known category and a severity in 0..1; signals without either go.

    A category that is not known gives way to the metric's; a score that is null or below 0 to the label's, 0.5 for others.
    """
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(lookup(F.col("metric"), OF_METRIC))
    severity = F.when(F.col("score") >= 0, clamp(F.col("score"))).otherwise(lookup(F.lower("label"), OF_LABEL, 0.5))
    return raw.withColumns({"category": category, "severity": severity}).where("category is not null")


def decision_signals(improvable: DataFrame, missed: DataFrame, support: DataFrame, by_type: DataFrame, keys=("match_id",)) -> DataFrame:
    """keys, category, severity, player_id, decision, reason.

    improvable: decision, value, gain, player_id; missed: decision, gain, player_id; support: decision, score, low, actions,
    player_id, without keys; by_type: decision, value, low, actions. Missing numbers count as the signal's neutral value.
    """
    number = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default))
    low_share = safe_div(number("low"), F.greatest(F.lit(1.0), number("actions", 1.0)))
    nobody, none = F.lit(None).cast("bigint"), [F.lit(None).cast("bigint").alias(k) for k in keys]
    of = lambda default: lookup(F.lower("decision"), OF_DECISION, default)

    def part(rows, key_columns, category, severity, player, reason):
        return rows.select(*key_columns, category.alias("category"), clamp(severity).alias("severity"), player.alias("player_id"), "decision", F.lit(reason).alias("reason"))

    # The four severities.
    phase = 0.3 + F.greatest(F.lit(0.0), 0.25 - number("value")) * 1.4 + number("gain") * 4.0
    return (
        part(improvable, keys, of("progression"), phase, F.col("player_id"), REASONS[0])
        .unionByName(part(missed, keys, F.lit("final_third"), 0.45 + number("gain") * 3.5, F.col("player_id"), REASONS[1]))
        .unionByName(part(support, none, of("ball_loss"), (1.0 - number("score", 0.2)) * 0.75 + low_share * 0.5, F.col("player_id"), REASONS[2]))
        .unionByName(part(by_type, keys, of("progression"), (0.25 - number("value", 0.2)) * 1.8 + low_share, nobody, REASONS[3]))
    )
