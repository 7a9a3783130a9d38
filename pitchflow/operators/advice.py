"""Insights in full: message, recommendation and evidence of each rule, and of each fused category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .baseline import KEYS
from .fusion import insights as fused_insights
from .fusion import lookup

# The message and the recommendation of each rule, by its title.
RULE_TEXTS = {
    "Low progressive pass success": (
        "Progressive passing efficiency is below league baseline.",
        "Improve central progression patterns and third-man passing options.",
    ),
    "Low success entering final third": (
        "Final-third entry passing success is below league baseline.",
        "Increase quality of vertical support angles and timing before final-third entry.",
    ),
    "Low vertical progression share": (
        "The share of progressive passes is in the bottom quartile.",
        "Increase vertical passing volume from midfield and first build-up line.",
    ),
    "High ball losses": (
        "Ball-loss rate is in the risk zone versus league baseline.",
        "Reduce forced actions in congested zones and improve support distances.",
    ),
    "Risky losses in own half": (
        "Own-half loss rate is above safe league ranges.",
        "Prioritize safer first-phase exits and cleaner support under pressure.",
    ),
    "Dangerous own-half losses": (
        "Dangerous loss exposure in own half is above league norm.",
        "Protect central rest-defense zones and reduce risky receptions facing own goal.",
    ),
    "Low-quality shot profile": (
        "Chance quality per shot is below league baseline.",
        "Shift final-third actions toward central cutbacks and higher-probability shooting zones.",
    ),
    "Poor box efficiency": (
        "Final-third box actions convert into low xG output versus league baseline.",
        "Improve shot selection and box occupation timing before finishing.",
    ),
    "Low shot accuracy": (
        "Shot-on-target rate is below league baseline.",
        "Create cleaner finishing scenarios and reduce low-balance attempts.",
    ),
    "Low counterpressing impact": (
        "Counterpressing recovery rate is in the bottom quartile.",
        "Compress distances around ball loss and trigger immediate pressure with nearest support.",
    ),
    "Few high recoveries": (
        "Opponent-half recovery rate is below league baseline.",
        "Improve coordinated pressure to win more second balls in advanced zones.",
    ),
    "Low pressing duel success": (
        "Pressing duel success is in the bottom quartile.",
        "Refine pressing body shape and first contact timing to improve duel outcomes.",
    ),
    "Low duel success": (
        "Overall duel success is below league reference values.",
        "Improve duel preparation distances and support structure around contested zones.",
    ),
    "Defensive duel weakness": (
        "Defensive duel win rate is in the bottom quartile.",
        "Improve first-contact timing and cover-shadow positioning in defensive duels.",
    ),
    "Aerial duel weakness": (
        "Aerial duel win rate is below league baseline.",
        "Improve second-ball positioning and timing on aerial contests.",
    ),
}
#: The titles whose evidence has a count of dangerous losses, and a second metric beside it.
COUNTED, SUPPORTED = "Dangerous own-half losses", ("Low-quality shot profile", "shotOnTargetRate")
# The recommendation and the drill of each fused category.
RECOMMENDATIONS = {
    "build_up": "Train press-resistant passing triangles with one-touch escape patterns.",
    "ball_loss": "Add constrained rondo and own-half exit drills under directional pressure.",
    "progression": "Run third-man progression patterns with carry-vs-pass decision triggers.",
    "final_third": "Use shot selection circuits with pre-shot scan constraints.",
    "duels": "Increase aerial and shoulder-contact duel repetitions by role group.",
    "pressing": "Drill coordinated counterpressing with first-5-second recovery targets.",
}
DRILLS = {
    "build_up": "6v4 build-up under press with mandatory support angles",
    "ball_loss": "Directional rondo with immediate transition punishment",
    "progression": "Third-man run and carry release circuit",
    "final_third": "Final-third scenario game with shot/pass quality gates",
    "duels": "Aerial timing and body-position duel blocks",
    "pressing": "Counterpressing wave drill with compactness scoring",
}


def _evidence(metric, value, mean, z, percentile):
    return F.struct(metric.alias("metric"), value.alias("value"), mean.alias("league_average"), z.alias("z"), percentile.alias("percentile"))


def full_insights(found: DataFrame, comparisons: DataFrame) -> DataFrame:
    """baseline.insights() with message, recommendation and evidence.

    The evidence is the metric's own numbers; dangerous (of dangerous losses, null for other rules) and supporting (the
    numbers of shots on target, null for other rules) stand beside it.
    """
    title = F.col("title")
    message, recommendation = (lookup(title, {t: texts[k] for t, texts in RULE_TEXTS.items()}) for k in (0, 1))
    c = lambda name: F.col(name)
    own = _evidence(c("metric"), c("value"), c("mean"), c("z"), c("percentile"))
    second = comparisons.where(F.col("metric") == SUPPORTED[1]).select(*KEYS, _evidence(c("metric"), c("value"), c("mean"), c("z"), c("percentile")).alias("__second"))
    out = found.join(second, list(KEYS), "left")
    return out.withColumns(
        {
            "message": message, "recommendation": recommendation, "evidence": own, "dangerous": F.when(title == COUNTED, F.col("above")),
            "supporting": F.when(title == SUPPORTED[0], F.col("__second")),
        }
    ).drop("__second")


def fused_advice(fused: DataFrame, signals: DataFrame, k: int = 5, keys=("sample_id",)) -> DataFrame:
    """fusion.insights() with the recommendation and the drill of their category."""
    category = F.col("category")
    return fused_insights(fused, signals, k, keys).withColumns({"recommendation": lookup(category, RECOMMENDATIONS), "drill": lookup(category, DRILLS)})
