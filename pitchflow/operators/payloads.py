"""Checks of nested JSON payloads against required fields: errors with the path to their place.

A specification is a tree of Obj and Arr; it is compiled to one expression over the parsed payload, so any number of
payloads is checked in one pass without Python. All errors are listed, outer ones first and then in the order of the
specification; the first is the one a check that stops at once would give.

Nulls, ties and edges: a payload that is null or no JSON is no object. A field that is there with the value null is
there, but is neither an object nor an array. Fields beyond the specification do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Obj:
    """An object with required fields; those of `inner` are checked further."""

    required: tuple[str, ...] = ()
    inner: dict[str, Obj | Arr] = field(default_factory=dict)


@dataclass(frozen=True)
class Arr:
    """An array; each of its items is checked, if `each` is given."""

    each: Obj | Arr | None = None


# The required fields of the two inputs of signal fusion.
INPUT1 = Obj(
    ("baselineModel", "weaknessSignals", "metricComparisons"),
    {
        "baselineModel": Obj(("overallWeaknessScore", "riskLevel", "tacticalProfile", "anomalyScore")),
        "weaknessSignals": Arr(Obj(("signalId", "category", "severityScore", "metric"))),
        "metricComparisons": Obj(),
    },
)
INPUT2 = Obj(
    ("summary", "players", "phases", "teamStats"),
    {
        "summary": Obj(("averageDecisionValue", "lowDecisionPhases", "phasesWithAlternative", "missedShotOrGoalOpportunities")),
        "players": Obj(("needsSupport",), {"needsSupport": Arr()}),
        "phases": Obj(("improvablePhases", "missedShotOrGoalOpportunities"), {"improvablePhases": Arr(), "missedShotOrGoalOpportunities": Arr()}),
        "teamStats": Obj(("decisionByType", "timeline"), {"decisionByType": Arr(), "timeline": Arr()}),
    },
)


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _errors(spec: Obj | Arr, value: Column, path: Column) -> Column:
    """array<string>: what is wrong with a variant at a path."""
    none = F.array().cast("array<string>")
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    if isinstance(spec, Arr):
        wrong = F.array(_said("`", path, "` must be an array"))
        found = none
        if spec.each is not None:
            items = value.cast("array<variant>")
            found = F.flatten(F.transform(items, lambda x, i: _errors(spec.each, x, _said(path, "[", i.cast("string"), "]"))))
        return F.when(~kind.startswith("ARRAY"), wrong).otherwise(F.coalesce(found, none))
    wrong = F.array(_said("`", path, "` must be an object"))
    at = {name: F.try_variant_get(value, f"$.{name}", "variant") for name in (*spec.required, *spec.inner)}
    missing = F.array_compact(F.array(*[F.when(at[name].isNull(), name) for name in spec.required])) if spec.required else none
    own = F.when(F.size(missing) > 0, F.array(_said("Missing required fields in `", path, "`: ", F.array_join(missing, ", ")))).otherwise(none)
    inner = [F.when(at[name].isNull(), none).otherwise(_errors(s, at[name], _said(path, f".{name}"))) for name, s in spec.inner.items()]
    return F.when(~kind.startswith("OBJECT"), wrong).otherwise(F.concat(own, *inner))


def check(rows: DataFrame, payload: str, spec: Obj | Arr, name: str) -> DataFrame:
    """rows with `errors`, all that is wrong with the JSON text in column `payload`, whose root is called `name`, and `error`, the first."""
    parsed = rows.withColumn("__v", F.try_parse_json(payload))
    out = parsed.withColumn("errors", _errors(spec, F.col("__v"), F.lit(name))).drop("__v")
    return out.withColumn("error", F.get("errors", F.lit(0)))
