"""Queries over player days, with their SQL; its numbers are those of the rules, not the operators'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import load as L
from ..operators import models as M
from ..sources.adapters import ACTIONS, PLAYER_DAYS, actions, player_days, sessions, table
from ..sources.shared import written
from .rounding import pick as _pick
from .rounding import rounded as _R

_KEYS = ("player_id", "day")
_AC = ("ac_distance", "ac_high_acc", "ac_load")
_RATIOS = tuple(f"ac_{m}{w}" for m in ("distance", "high_acc", "load") for w in ("", "_3_21", "_7_21"))
_SPLIT_DAY = 20


def _days(spark, sf_dir):
    return player_days(spark, sf_dir)


def _form(spark, sf_dir):
    return _days(spark, sf_dir).withColumn("form", L.form_proxy())


def _features(spark, sf_dir):
    """Written once: bands, zones and models all begin from it."""
    return written(L.personal_z(L.monotony_and_ratios(_form(spark, sf_dir))), "load-features")


def _zones(spark, sf_dir):
    return L.zones(_features(spark, sf_dir))


#: What the anomaly of a player day is found from.
FATIGUE_FEATURES = ("load", "load_mean_7", "load_cv_7", "wow_ratio", "monotony", "strain", "ac_distance", "ac_high_acc", "ac_load", "high_acc_mean_7", "per_min_mean_7", "gap")


def _fatigue(spark, sf_dir):
    """Risks from the isolation forest over all player days."""
    f = L.personal_z(L.rolling_and_ratios(_form(spark, sf_dir), (7,), ("load", "high_acc", "per_min")))
    return written(L.fatigue(L.zones(M.isolation_forest(written(f, "load-features"), FATIGUE_FEATURES, _KEYS))), "fatigue")


def _given(spark, sf_dir):
    """Risks from an anomaly that is given with the rows, which SQL can follow."""
    z = L.scaled_by(_zones(spark, sf_dir), "form")
    return L.fatigue(z.withColumn("anomaly", F.least(F.lit(1.0), F.col("sessions") / 10)))


_MATCH_EXPR = {
    "goals": "coalesce(is_goal, false)", "assists": "tag_through AND accurate", "shots": "event_type = 'shot'", "on_target": "coalesce(on_target, false)", "passes": "event_type = 'pass'",
    "accurate": "coalesce(accurate, false)", "key_passes": "event_type = 'pass' AND tag_progressive", "duels": "event_type IN ('ground_duel', 'aerial_duel')", "won": "coalesce(won, false)",
}


def _match_rows(s, d):
    a = actions(s, d)
    counts = [F.count_if(F.expr(x)).alias(c) for c, x in _MATCH_EXPR.items()]
    minutes = ((F.max("sec") - F.min("sec")) / 60.0 + 1).alias("minutes")
    return a.groupBy("match_id", "player_id").agg(minutes, *counts, F.sum(F.coalesce("xg", F.lit(0.0))).alias("xg"), F.sum(F.when(F.col("tag_through"), F.col("attack_xg")).otherwise(0.0)).alias("xg_assist"))


_CONTEXT = ("minutes", "xg", "xg_assist", "goals_per90", "assists_per90", "xg_per90", "xg_assist_per90", "shots_per90", "key_passes_per90", "pass_accuracy", "duel_win_rate")


def _profiles(s, d):
    """Player profiles over the features of days and of the season's matches."""
    context = L.match_context(_match_rows(s, d))
    named = context.select("player_id", *[F.col(c).alias(f"match_{c}") for c in ("xg_per90", "assists_per90", "duel_win_rate")])
    return L.profiles(L.with_totals(_features(s, d), named))


_OVERRIDES = {"Nobody 3": 77, "  NOBODY 7": 12}


def _devices(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    name = F.expr("CASE user_id % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN '  ' || c_name || ' ' WHEN 2 THEN 'Someone Group' || (user_id % 40) WHEN 3 THEN 'n' || (user_id % 25) ELSE 'nobody ' || (user_id % 10) END")
    return table(s, d, "events").select(F.col("user_id").cast("bigint").alias("user_id")).join(c, "user_id").select(name.alias("device_name"))


def _catalog(s, d):
    full = F.expr("CASE WHEN c_custkey % 4 = 3 THEN 'Ann Group' || (c_custkey % 60) ELSE c_name END")
    return table(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("player_id"), full.alias("full_name"), F.expr("'N' || (c_custkey % 200)").alias("short_name"))


QUERIES = {
    "k1_daily_load": lambda s, d: _pick(_days(s, d), (*_KEYS, "sessions", "session_names", "role"), "distance", "duration", "per_min", "power", "sprints", "high_speed", "high_share", "load", "accel"),
    "w7_rolling": lambda s, d: _pick(L.rolling(_days(s, d)), _KEYS, *[f"{m}_{a}_{n}" for n in L.WINDOWS for m in L.METRICS for a in ("sum", "mean", "std", "cv")], digits=4),
    "w8_monotony": lambda s, d: _pick(L.monotony_and_ratios(_days(s, d)), (*_KEYS, "gap", "recovered"), "monotony", "strain", "monotony_14", "strain_14", "wow_delta", "wow_ratio", digits=4),
    "w10_acute_to_chronic": lambda s, d: _pick(L.monotony_and_ratios(_days(s, d)), _KEYS, *_RATIOS, digits=4),
    "w11_ewma": lambda s, d: _pick(L.ewma(_days(s, d)), _KEYS, *[f"{m}_ewma_{n}" for m in L.AC_METRICS for n in L.SPANS], *[f"ac_{m}_ewma" for m in L.AC_METRICS], digits=4),
    "w12_personal_z": lambda s, d: _pick(L.personal_z(_days(s, d)), _KEYS, *[f"{m}_{x}" for m in L.Z_METRICS for x in ("z", "ratio")], digits=4),
    "w14_targets": lambda s, d: _pick(L.targets(_form(s, d)), _KEYS, "ma14", "next7", "next14"),
    "k16_split": lambda s, d: L.split_by_day(L.targets(_form(s, d)), _SPLIT_DAY).select(*_KEYS, "split"),
    "k6_form_score": lambda s, d: _pick(L.scaled_by(_form(s, d), "form"), (*_KEYS, "role"), "form", "form_score"),
    "k7_personal_bands": lambda s, d: _pick(L.personal_bands(L.monotony_and_ratios(_days(s, d))), ("player_id", *[f"{f}_source" for f in _AC]), *[f"{f}_{x}" for f in _AC for x in ("low", "mid", "high")], digits=5),
    "k8_zones": lambda s, d: _pick(_zones(s, d), (*_KEYS, *[f"{f}_status" for f in _AC], "status"), *[f"{f}_excess" for f in _AC], "excess", digits=5),
    "k9_fatigue": lambda s, d: _fatigue(s, d).select(*_KEYS, "anomaly", "excess", "risk", "risk_level", "overload", "reasons", "static_level"),
    "k10_static_rules": lambda s, d: L.static_rules(_zones(s, d)).select(*_KEYS, "reasons", "static_score", "static_level", "static_reasons"),
    "k13_daily_kpi": lambda s, d: _pick(L.daily_kpi(_given(s, d)), (*_KEYS, "status", "risk_level", "overload", "underload_candidate", "overload_candidate", "form_score_rank", "risk_rank"), "risk", digits=5),
    "w9_daily_ranks": lambda s, d: L.ranked(_form(s, d), "form", "load").select(*_KEYS, "form_rank", "load_rank"),
    "k14_weekly": lambda s, d: L.ranked(L.weekly(_form(s, d)), "form", "load").select(*_KEYS, "iso_year", "iso_week", "form_rank", "load_rank"),
    "k3_quality_report": lambda s, d: _pick(L.quality_report(sessions(s, d), _days(s, d)), ("session_rows", "mapped_rows", "missing_dates", "days", "players", "first_day", "last_day", "repeated", "outliers_distance", "outliers_duration"), "coverage"),
    "k4_match_context": lambda s, d: _pick(L.match_context(_match_rows(s, d)), ("player_id", "matches", "goals", "assists", "shots", "on_target", "passes", "accurate", "key_passes", "duels", "won"), *_CONTEXT, digits=5),
    "k12_player_profiles": lambda s, d: _pick(_profiles(s, d), ("player_id", "days"), *L.PROFILE, digits=5),
    "k17_fatigue_counts": lambda s, d: L.fatigue_counts(_fatigue(s, d)),
    "k17_given_counts": lambda s, d: L.fatigue_counts(_given(s, d)),
    "j16_alert_overlap": lambda s, d: L.alert_overlap(_fatigue(s, d)),
    "j16_given_overlap": lambda s, d: _pick(L.alert_overlap(_given(s, d)), ("static_high", "risk_high", "both", "either"), "jaccard"),
    "j7_name_mapping": lambda s, d: L.name_mapping(_devices(s, d), _catalog(s, d), _OVERRIDES).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ",")),
}

_D = f"""WITH {PLAYER_DAYS}, q AS (SELECT * FROM p),
f AS (SELECT *, 0.5::DOUBLE * per_min + 0.25::DOUBLE * high_share + 2 * power + 20 * sprints AS form FROM q)"""
_OVER = "OVER (PARTITION BY player_id ORDER BY day ROWS BETWEEN {0} PRECEDING AND {1})"
_O = lambda n: _OVER.format(n - 1, "CURRENT ROW")
_DIV = "CASE WHEN coalesce({1}, 0) = 0 THEN 0 ELSE {0} / {1} END"
_PAST = _OVER.format("UNBOUNDED", "1 PRECEDING")
_AC_SQL = ", ".join(f"{_DIV.format(f'(avg({m}) {_O(a)})', f'(avg({m}) {_O(b)})')} AS ac_{m}{'' if a == 7 and b == 28 else f'_{a}_{b}'}" for m in ("distance", "high_acc", "load") for a, b in ((3, 21), (7, 21), (7, 28)))
_Z_ALL = ", ".join(
    f"CASE WHEN count({m}) {_PAST} >= 5 AND stddev_pop({m}) {_PAST} > 1e-9 THEN ({m} - avg({m}) {_PAST}) / stddev_pop({m}) {_PAST} ELSE 0 END AS {m}_z, CASE WHEN count({m}) {_PAST} >= 5 AND avg({m}) {_PAST} <> 0 THEN {m} / avg({m}) {_PAST} ELSE 1 END AS {m}_ratio"
    for m in ("distance", "duration", "per_min", "high_acc", "high_share", "load")
)
_M = f"""{_D}, m0 AS (SELECT *, stddev_pop(load) {_O(7)} AS std7, avg(load) {_O(7)} AS mean7, sum(load) {_O(7)} AS week, stddev_pop(load) {_O(14)} AS std14, avg(load) {_O(14)} AS mean14, sum(load) {_O(14)} AS week14,
  coalesce(sum(load) {_OVER.format(13, '7 PRECEDING')}, 0) AS last, coalesce(day - lag(day) OVER (PARTITION BY player_id ORDER BY day), 0) AS gap, {_AC_SQL}, {_Z_ALL} FROM f),
m AS (SELECT *, CASE WHEN std7 > 1e-9 THEN mean7 / std7 ELSE 0 END AS monotony, CASE WHEN std7 > 1e-9 THEN week * mean7 / std7 ELSE 0 END AS strain,
  CASE WHEN std14 > 1e-9 THEN mean14 / std14 ELSE 0 END AS monotony_14, CASE WHEN std14 > 1e-9 THEN week14 * mean14 / std14 ELSE 0 END AS strain_14, week - last AS wow_delta, {_DIV.format('week', 'last')} AS wow_ratio FROM m0)"""
_OWN = ", ".join(f"count(*) FILTER (WHERE {f} > 0) AS n_{f}, quantile_cont({f}, [0.25, 0.5, 0.75]) FILTER (WHERE {f} > 0) AS o_{f}" for f in _AC)
_ALL = ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) FILTER (WHERE {f} > 0) AS a_{f}" for f in _AC)
_USE = ", ".join(f"CASE WHEN n_{f} >= 8 THEN o_{f}[{k}] ELSE a_{f}[{k}] END AS {f}_{x}" for f in _AC for k, x in ((1, "low"), (2, "mid"), (3, "high"))) + ", " + ", ".join(f"CASE WHEN n_{f} >= 8 THEN 'personal' ELSE 'global_fallback' END AS {f}_source" for f in _AC)
_ZONE = ", ".join(
    f"CASE WHEN {f} <= 0 THEN 'insufficient_data' WHEN {f} < {f}_low THEN 'below' WHEN {f} > {f}_high THEN 'above' ELSE 'optimal' END AS {f}_status, CASE WHEN {f} <= 0 THEN 0 WHEN {f} < {f}_low THEN ({f}_low - {f}) / {f}_low WHEN {f} > {f}_high THEN ({f} - {f}_high) / {f}_high ELSE 0 END AS {f}_excess" for f in _AC
)
_LIST = "[" + ", ".join(f"{f}_status" for f in _AC) + "]"
_B = f"""{_M}, own AS (SELECT player_id, {_OWN} FROM m GROUP BY player_id), al AS (SELECT {_ALL} FROM m), bands AS (SELECT player_id, {_USE} FROM own, al),
z0 AS (SELECT m.*, bands.* EXCLUDE (player_id), {_ZONE} FROM m JOIN bands USING (player_id)),
z AS (SELECT *, CASE WHEN ac_distance_status = 'optimal' AND ac_high_acc_status = 'optimal' AND ac_load_status = 'optimal' THEN 'optimal' WHEN list_contains({_LIST}, 'above') THEN 'above_optimal'
  WHEN list_contains({_LIST}, 'below') THEN 'below_optimal' ELSE 'insufficient_data' END AS status, (ac_distance_excess + ac_high_acc_excess + ac_load_excess) / 3 AS excess FROM z0)"""
_K = f"""{_B}, k0 AS (SELECT *, list_filter([CASE WHEN status = 'above_optimal' THEN 'ac_above_optimal_zone' END, CASE WHEN monotony >= 2 THEN 'high_monotony' END, CASE WHEN load_z >= 1.5 THEN 'load_spike_vs_player_baseline' END,
    CASE WHEN gap <= 0 THEN 'consecutive_day_load' END], lambda x: x IS NOT NULL) AS rs,
  list_filter([CASE WHEN monotony >= 2 THEN 'monotony>=2.0' END, CASE WHEN ac_load >= 1.25 THEN 'ac_load_7_28>=1.25' END, CASE WHEN ac_distance >= 1.25 THEN 'ac_distance_7_28>=1.25' END, CASE WHEN ac_high_acc >= 1.25 THEN 'ac_high_int_7_28>=1.25' END,
    CASE WHEN gap <= 0 AND load_z >= 1 THEN 'consecutive_day_load_and_spike' END], lambda x: x IS NOT NULL) AS sr,
  greatest(0, least(1, 0.65::DOUBLE * least(1, sessions / 10.0::DOUBLE) + 0.35::DOUBLE * excess)) AS risk FROM z),
k AS (SELECT *, CASE WHEN len(rs) = 0 THEN 'anomaly_pattern_detected' ELSE array_to_string(rs[1:3], ' | ') END AS reasons, len(sr) AS static_score, CASE WHEN len(sr) >= 2 THEN 'high' WHEN len(sr) = 1 THEN 'medium' ELSE 'low' END AS static_level,
  CASE WHEN len(sr) = 0 THEN 'none' ELSE array_to_string(sr, ' | ') END AS static_reasons, CASE WHEN risk >= 0.62 THEN 'high' WHEN risk >= 0.38 THEN 'medium' ELSE 'low' END AS risk_level, risk >= 0.62 AS overload,
  CASE WHEN max(form) OVER (PARTITION BY role) > min(form) OVER (PARTITION BY role) THEN 100 * (form - min(form) OVER (PARTITION BY role)) / (max(form) OVER (PARTITION BY role) - min(form) OVER (PARTITION BY role)) ELSE 50 END AS form_score FROM k0)"""
_RANGE = "avg(form) OVER (PARTITION BY player_id ORDER BY day RANGE BETWEEN {0} AND {1})"
_EW = ", ".join(f"list_reduce(past_{m}, lambda a, x: (2.0::DOUBLE / {n + 1}) * x + (1 - 2.0::DOUBLE / {n + 1}) * a) AS {m}_ewma_{n}" for m in ("distance", "high_acc", "load") for n in (7, 28))
_X = f"""WITH {ACTIONS}, mr AS (SELECT match_id, player_id, (max(sec) - min(sec)) / 60.0::DOUBLE + 1 AS minutes, """ + ", ".join(f"count(*) FILTER (WHERE {x}) AS {c}" for c, x in _MATCH_EXPR.items()) + """, sum(coalesce(xg, 0)) AS xg, sum(CASE WHEN tag_through THEN attack_xg ELSE 0 END) AS xg_assist FROM a GROUP BY ALL),
x0 AS (SELECT player_id, count(*) AS matches, sum(minutes) AS minutes, """ + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in (*_MATCH_EXPR, "xg", "xg_assist")) + """ FROM mr GROUP BY player_id),
x AS (SELECT *, """ + ", ".join(f"90 * {c} / minutes AS {c}_per90" for c in ("goals", "assists", "xg", "xg_assist", "shots", "key_passes")) + """, coalesce(100 * accurate / nullif(passes, 0), 0) AS pass_accuracy, coalesce(100 * won / nullif(duels, 0), 0) AS duel_win_rate FROM x0)"""
_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"

SQL = {
    "k1_daily_load": f"{_D} SELECT player_id, day, sessions, session_names, role, {_R(6, 'distance', 'duration', 'per_min', 'power', 'sprints', 'high_speed', 'high_share', 'load', 'accel')} FROM q",
    "w7_rolling": f"{_D} SELECT player_id, day, " + ", ".join(f"round({fn} + 3.3e-8, 4) AS {m}_{a}_{n}" for n in (3, 7, 14, 21, 28) for m in L.METRICS for a, fn in (("sum", f"sum({m}) {_O(n)}"), ("mean", f"avg({m}) {_O(n)}"), ("std", f"stddev_pop({m}) {_O(n)}"), ("cv", _DIV.format(f"(stddev_pop({m}) {_O(n)})", f"(avg({m}) {_O(n)})")))) + " FROM q",
    "w8_monotony": f"{_M} SELECT player_id, day, gap, gap >= 2 AS recovered, {_R(4, 'monotony', 'strain', 'monotony_14', 'strain_14', 'wow_delta', 'wow_ratio')} FROM m",
    "w10_acute_to_chronic": f"{_M} SELECT player_id, day, {_R(4, *_RATIOS)} FROM m",
    "w11_ewma": f"""{_D}, h AS (SELECT player_id, day, """ + ", ".join(f"list({m}) {_OVER.format('UNBOUNDED', 'CURRENT ROW')} AS past_{m}" for m in ("distance", "high_acc", "load")) + f""" FROM q), g AS (SELECT player_id, day, {_EW} FROM h)
        SELECT player_id, day, {_R(4, *[f'{m}_ewma_{n}' for m in ('distance', 'high_acc', 'load') for n in (7, 28)])}, """ + ", ".join(f"round({_DIV.format(f'{m}_ewma_7', f'{m}_ewma_28')} + 3.3e-8, 4) AS ac_{m}_ewma" for m in ("distance", "high_acc", "load")) + " FROM g",
    "w12_personal_z": f"{_M} SELECT player_id, day, {_R(4, *[f'{m}_{x}' for m in ('distance', 'duration', 'per_min', 'high_acc', 'high_share', 'load') for x in ('z', 'ratio')])} FROM m",
    "w14_targets": f"{_D} SELECT player_id, day, round({_RANGE.format('14 PRECEDING', 'CURRENT ROW')} + 3.3e-10, 6) AS ma14, round({_RANGE.format('1 FOLLOWING', '7 FOLLOWING')} + 3.3e-10, 6) AS next7, round({_RANGE.format('1 FOLLOWING', '14 FOLLOWING')} + 3.3e-10, 6) AS next14 FROM f",
    "k16_split": f"{_D} SELECT player_id, day, CASE WHEN day <= 20 THEN 'train' ELSE 'test' END AS split FROM (SELECT player_id, day, {_RANGE.format('1 FOLLOWING', '7 FOLLOWING')} AS next7 FROM f) WHERE next7 IS NOT NULL",
    "k6_form_score": f"{_D} SELECT player_id, day, role, round(form + 3.3e-10, 6) AS form, round(CASE WHEN max(form) OVER r > min(form) OVER r THEN 100 * (form - min(form) OVER r) / (max(form) OVER r - min(form) OVER r) ELSE 50 END + 3.3e-10, 6) AS form_score FROM f WINDOW r AS (PARTITION BY role)",
    "k7_personal_bands": f"{_B} SELECT player_id, {', '.join(f'{f}_source' for f in _AC)}, {_R(5, *[f'{f}_{x}' for f in _AC for x in ('low', 'mid', 'high')])} FROM bands",
    "k8_zones": f"{_B} SELECT player_id, day, {', '.join(f'{f}_status' for f in _AC)}, status, {_R(5, *[f'{f}_excess' for f in _AC], 'excess')} FROM z",
    "k10_static_rules": f"{_K} SELECT player_id, day, reasons, static_score, static_level, static_reasons FROM k",
    "k13_daily_kpi": f"""{_K} SELECT player_id, day, status, risk_level, overload, status = 'below_optimal' AND risk_level = 'low' AS underload_candidate, overload OR status = 'above_optimal' AS overload_candidate,
        row_number() OVER (PARTITION BY day ORDER BY round(form_score, 9) DESC, player_id) AS form_score_rank, row_number() OVER (PARTITION BY day ORDER BY round(k.risk, 9) DESC, player_id) AS risk_rank, round(k.risk + 3.3e-9, 5) AS risk FROM k""",
    "w9_daily_ranks": f"{_D} SELECT player_id, day, row_number() OVER (PARTITION BY day ORDER BY round(form, 9) DESC, player_id) AS form_rank, row_number() OVER (PARTITION BY day ORDER BY round(load, 9) DESC, player_id) AS load_rank FROM f",
    "k14_weekly": f"""{_D}, w AS (SELECT *, isoyear(DATE '2024-01-01' + day::INT) AS iso_year, week(DATE '2024-01-01' + day::INT) AS iso_week FROM f),
        l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY player_id, iso_year, iso_week ORDER BY day DESC) = 1)
        SELECT player_id, day, iso_year, iso_week, row_number() OVER (PARTITION BY day ORDER BY round(form, 9) DESC, player_id) AS form_rank, row_number() OVER (PARTITION BY day ORDER BY round(load, 9) DESC, player_id) AS load_rank FROM l""",
    "k3_quality_report": f"""{_D} SELECT (SELECT count(*) FROM e) AS session_rows, (SELECT count(*) FROM e WHERE user_id IS NOT NULL) AS mapped_rows, (SELECT count(*) FROM e WHERE day IS NULL) AS missing_dates, count(*) AS days, count(DISTINCT player_id) AS players,
        min(day) AS first_day, max(day) AS last_day, 0 AS repeated, count(*) FILTER (WHERE distance > 1.5::DOUBLE * (SELECT quantile_cont(distance, 0.99) FROM q)) AS outliers_distance,
        count(*) FILTER (WHERE duration > 1.5::DOUBLE * (SELECT quantile_cont(duration, 0.99) FROM q)) AS outliers_duration, round((SELECT 100.0::DOUBLE * count(user_id) / count(*) FROM e) + 3.3e-10, 6) AS coverage FROM q""",
    "k4_match_context": f"{_X} SELECT player_id, matches, goals, assists, shots, on_target, passes, accurate, key_passes, duels, won, {_R(5, *_CONTEXT)} FROM x",
    "k12_player_profiles": f"""{_B}, {_X[_X.index("a AS (SELECT event_id"):]}, y AS (SELECT m.*, coalesce(xg_per90, 0) AS match_xg_per90, coalesce(assists_per90, 0) AS match_assists_per90, coalesce(duel_win_rate, 0) AS match_duel_win_rate FROM m LEFT JOIN x USING (player_id))
        SELECT player_id, count(*) AS days, """ + ", ".join(f"round(avg({c}) + 3.3e-9, 5) AS {c}" for c in ("distance", "per_min", "high_share", "high_acc", "load", "sprints", "ac_distance", "ac_high_acc", "ac_load", "monotony", "strain", "match_xg_per90", "match_assists_per90", "match_duel_win_rate")) + " FROM y GROUP BY player_id",
    "k17_given_counts": f"""{_K} SELECT 'level' AS kind, risk_level AS name, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'factor', name, count(*) FROM (SELECT unnest(string_split(reasons, ' | ')) AS name FROM k) GROUP BY ALL
        UNION ALL SELECT 'source', name, count(*) FROM (SELECT unnest([ac_distance_source, ac_high_acc_source, ac_load_source]) AS name FROM bands) GROUP BY ALL
        UNION ALL SELECT 'above', player_id::VARCHAR, n FROM (SELECT player_id, count(*) AS n FROM k WHERE status = 'above_optimal' GROUP BY ALL ORDER BY n DESC, player_id LIMIT 10)""",
    "j16_given_overlap": f"""{_K}, o AS (SELECT count(*) FILTER (WHERE static_level = 'high') AS static_high, count(*) FILTER (WHERE risk_level = 'high') AS risk_high, count(*) FILTER (WHERE static_level = 'high' AND risk_level = 'high') AS "both",
        count(*) FILTER (WHERE static_level = 'high' OR risk_level = 'high') AS either FROM k) SELECT static_high, risk_high, "both", either, round(coalesce("both" / nullif(either, 0)::DOUBLE, 0) + 3.3e-10, 6) AS jaccard FROM o""",
    "j7_name_mapping": f"""WITH dv AS (SELECT CASE user_id % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN '  ' || c_name || ' ' WHEN 2 THEN 'Someone Group' || (user_id % 40) WHEN 3 THEN 'n' || (user_id % 25) ELSE 'nobody ' || (user_id % 10) END AS device_name FROM events JOIN customer ON c_custkey = user_id),
        nm AS (SELECT device_name, count(*) AS rows, {_NORM.format('device_name')} AS norm FROM dv GROUP BY ALL),
        ct AS (SELECT c_custkey AS player_id, {_NORM.format("CASE WHEN c_custkey % 4 = 3 THEN 'Ann Group' || (c_custkey % 60) ELSE c_name END")} AS full_name, {_NORM.format("'N' || (c_custkey % 200)")} AS short_name FROM customer),
        ov(norm, o) AS (VALUES ('nobody 3', 77), ('nobody 7', 12)),
        ex AS (SELECT norm, list(DISTINCT player_id ORDER BY player_id) AS l FROM (SELECT player_id, full_name AS norm FROM ct UNION ALL SELECT player_id, short_name FROM ct) GROUP BY ALL),
        sn AS (SELECT list_last(string_split(full_name, ' ')) AS word, list(DISTINCT player_id ORDER BY player_id) AS l FROM ct GROUP BY ALL),
        j AS (SELECT nm.*, o, ex.l AS el, CASE WHEN o IS NOT NULL THEN [o] ELSE coalesce(ex.l, sn.l, []) END AS c FROM nm LEFT JOIN ov USING (norm) LEFT JOIN ex USING (norm) LEFT JOIN sn ON word = list_last(string_split(norm, ' ')))
        SELECT device_name, rows, CASE WHEN o IS NOT NULL THEN 'override' WHEN len(c) = 1 THEN CASE WHEN el IS NOT NULL THEN 'matched' ELSE 'surname' END WHEN len(c) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status,
        array_to_string(c, ',') AS candidates, CASE WHEN len(c) = 1 THEN c[1] END AS player_id FROM j""",
}
