"""Queries over team matches against their league, with their SQL; its numbers are those of the rules, not the operators'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice as A
from ..operators import baseline as B
from ..sources.adapters import TEAM_MATCHES, table, team_matches
from ..sources.shared import written
from .rounding import pick as _pick
from .rounding import rounded as _R

_STORED = "match_id % 2 = 0"
_ALIASES = ("  SUPPLIER#000000003", "supplier#00000000\u00e5", "Supplier#000000007 ")


def _features(s, d):
    return B.ratios(team_matches(s, d))


def _values(s, d):
    """Written once: league, percentiles and comparison all begin from it."""
    return written(B.long(_features(s, d)), "metric-values")


def _compared(s, d):
    v = _values(s, d)
    return written(B.compare(v, B.league_baseline(v)), "comparisons")


def _full_insights(s, d):
    c = _compared(s, d)
    out = A.full_insights(B.insights(c), c)
    flat = out.select(*B.KEYS, "title", "message", "recommendation", "evidence.*", "dangerous", *[F.col(f"supporting.{x}").alias(f"supporting_{x}") for x in ("metric", "value", "z", "percentile")])
    return _pick(flat, (*B.KEYS, "title", "message", "recommendation", "metric", "supporting_metric"), "value", "league_average", "z", "percentile", "dangerous", "supporting_value", "supporting_z", "supporting_percentile", digits=5)


def _live(s, d):
    """New matches scored against a stored league."""
    v = _values(s, d)
    stored, new = v.where(_STORED), v.where(f"NOT ({_STORED})")
    return written(B.compare(new, B.league_baseline(stored), percentiles=B.percentile_among(new, stored)), "comparisons")


def _strict(s, d):
    """A second assignment of players to teams: some teams' totals are lower, some rows are missing."""
    t = team_matches(s, d).where("(match_id + team_id) % 9 <> 0")
    return t.withColumns({m: F.when(F.col("team_id") % 4 == 0, F.col(m) * 0.9).otherwise(F.col(m)) for m in B.SENSITIVE})


def _names(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"))


def _final(s, d):
    rows = _features(s, d)
    anomalies = rows.where("team_id % 5 <> 0").select(*B.KEYS, F.col("lossRate").alias("anomaly_score"), (F.col("lossRate") > 0.2).alias("is_anomalous"))
    clusters = rows.where("team_id % 3 <> 0").select(*B.KEYS, (F.col("team_id") % 3).alias("cluster"), F.concat(F.lit("profile_"), (F.col("team_id") % 3).cast("string")).alias("profile"))
    r = B.final_report(_compared(s, d), anomalies, clusters)
    return _pick(r, (*B.KEYS, "risk", "weak_metrics", "metrics_compared", "cluster", "profile", "is_anomalous", F.array_join("titles", "; ").alias("titles")), "overall", "anomaly_score", digits=5)


QUERIES = {
    "b4_ratios": lambda s, d: _pick(_features(s, d), B.KEYS, *B.RATIOS),
    "b5_ratio_report": lambda s, d: B.ratio_report(team_matches(s, d)),
    "b7_league_baseline": lambda s, d: _pick(B.league_baseline(_values(s, d)), ("metric", "n"), "mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90"),
    "w6_percentiles": lambda s, d: _pick(B.percentile_of(_values(s, d)), ("metric",), "value", "percentile"),
    "b9_comparisons": lambda s, d: _pick(_compared(s, d), (*B.KEYS, "metric", "status", "is_weakness"), "z", "percentile", digits=5),
    "b10_focus": lambda s, d: B.focus(_compared(s, d), _names(s, d), _ALIASES).groupBy("team_id", "status").agg(F.count(F.lit(1)).alias("n")),
    "b11_rules": lambda s, d: _pick(B.insights(_compared(s, d), len(B.RULES)), (*B.KEYS, "title", "type", "label", "rank"), "severity", "confidence", digits=5),
    "b11_full_insights": _full_insights,
    "b12_insights": lambda s, d: B.insights(_compared(s, d)).select(*B.KEYS, "title", "rank"),
    "b14_weakness_report": lambda s, d: _pick(B.weakness_report(_compared(s, d)), (*B.KEYS, "risk"), *B.BUCKETS, "overall", digits=5),
    "b15_final_report": _final,
    "b16_strengths": lambda s, d: _pick(B.strengths(_compared(s, d)), (*B.KEYS, "metric", "status", "rank"), "value", "mean", digits=5),
    "b16_weakness_signals": lambda s, d: _pick(B.weakness_signals(_compared(s, d)), (*B.KEYS, "rank", "signal_id", "category", "label", "metric", "direction"), "severity", "z", "percentile", digits=5),
    "b17_live_report": lambda s, d: _pick(B.weakness_report(_live(s, d)), (*B.KEYS, "risk"), "overall", digits=5),
    "b17_live_comparisons": lambda s, d: _pick(_live(s, d), (*B.KEYS, "metric", "status"), "z", "percentile", digits=5),
    "b6_sensitivity": lambda s, d: _pick(B.sensitivity(team_matches(s, d), _strict(s, d)), ("metric", "n", "mode"), "total_heuristic", "total_strict", "mean_diff", "mean_pct", "max_pct", digits=4),
    "b6_most_sensitive": lambda s, d: _pick(B.most_sensitive(team_matches(s, d), _strict(s, d)), B.KEYS, "pct", digits=4),
    "b2_surrogate_ids": lambda s, d: B.surrogate_ids(table(s, d, "part"), "p_name"),
    "b18_checks": lambda s, d: B.checks(_features(s, d), tuple(B.RATIOS)),
}

_V = f"""WITH {TEAM_MATCHES}, r AS (SELECT *,
  coalesce(successfulPasses / nullif(passes, 0), 0) AS passSuccessRate,
  coalesce(successfulProgressivePasses / nullif(progressivePasses, 0), 0) AS progressivePassSuccessRate,
  coalesce(successfulPassesToFinalThird / nullif(passesToFinalThird, 0), 0) AS finalThirdPassSuccessRate,
  coalesce(successfulForwardPasses / nullif(forwardPasses, 0), 0) AS forwardPassSuccessRate,
  coalesce(progressivePasses / nullif(passes, 0), 0) AS progressivePassShare,
  coalesce(passesToFinalThird / nullif(passes, 0), 0) AS finalThirdEntryShare,
  coalesce(losses / nullif(passes + dribbles + receivedPass, 0), 0) AS lossRate,
  coalesce(ownHalfLosses / nullif(losses, 0), 0) AS ownHalfLossRate,
  coalesce(dangerousOwnHalfLosses / nullif(losses, 0), 0) AS dangerousLossRate,
  coalesce(shotsOnTarget / nullif(shots, 0), 0) AS shotOnTargetRate,
  coalesce(xgShot / nullif(shots, 0), 0) AS xgPerShot,
  coalesce(xgShot / nullif(touchInBox, 0), 0) AS boxEfficiency,
  coalesce(counterpressingRecoveries / nullif(recoveries, 0), 0) AS counterpressingRate,
  coalesce(opponentHalfRecoveries / nullif(recoveries, 0), 0) AS highRecoveryRate,
  coalesce(duelsWon / nullif(duels, 0), 0) AS duelSuccessRate,
  coalesce(defensiveDuelsWon / nullif(defensiveDuels, 0), 0) AS defensiveDuelSuccessRate,
  coalesce(offensiveDuelsWon / nullif(offensiveDuels, 0), 0) AS offensiveDuelSuccessRate,
  coalesce(aerialDuelsWon / nullif(aerialDuels, 0), 0) AS aerialDuelSuccessRate,
  coalesce(pressingDuelsWon / nullif(pressingDuels, 0), 0) AS pressingDuelSuccessRate FROM t),
dir(metric, k) AS (VALUES ('passSuccessRate', 0), ('progressivePassSuccessRate', 1), ('finalThirdPassSuccessRate', 2), ('forwardPassSuccessRate', 3),
  ('progressivePassShare', 4), ('finalThirdEntryShare', 5), ('lossRate', 6), ('ownHalfLossRate', 7), ('dangerousLossRate', 8), ('shotOnTargetRate', 9), ('xgPerShot', 10),
  ('boxEfficiency', 11), ('counterpressingRate', 12), ('highRecoveryRate', 13), ('duelSuccessRate', 14), ('defensiveDuelSuccessRate', 15),
  ('offensiveDuelSuccessRate', 16), ('aerialDuelSuccessRate', 17), ('pressingDuelSuccessRate', 18)),
v AS (UNPIVOT (SELECT match_id, team_id, COLUMNS(c -> c IN (SELECT metric FROM dir)) FROM r) ON COLUMNS(* EXCLUDE (match_id, team_id)) INTO NAME metric VALUE value)"""
_V = _V.replace("COLUMNS(c -> c IN (SELECT metric FROM dir))", ", ".join(B.RATIOS))
_BASE = f"""{_V}, b AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM v GROUP BY metric)"""
#: Statuses, rules, buckets and levels over c0 (z and percentile of each match, team and metric).
_RULES = """c1 AS (SELECT *, metric IN ('lossRate', 'ownHalfLossRate', 'dangerousLossRate') AS bad_when_high FROM c0),
c2 AS (SELECT *, CASE WHEN z IS NULL THEN 'insufficient_data'
  WHEN bad_when_high THEN CASE WHEN z <= -1.5 THEN 'very_strong' WHEN z <= -0.75 THEN 'strong' WHEN z < 0.75 THEN 'normal' WHEN z < 1.5 THEN 'weak' ELSE 'very_weak' END
  ELSE CASE WHEN z <= -1.5 THEN 'very_weak' WHEN z <= -0.75 THEN 'weak' WHEN z < 0.75 THEN 'normal' WHEN z < 1.5 THEN 'strong' ELSE 'very_strong' END END AS s0 FROM c1),
c AS (SELECT *, CASE WHEN s0 = 'normal' AND (bad_when_high AND percentile >= 75 OR NOT bad_when_high AND percentile <= 25) THEN 'warning' ELSE s0 END AS status FROM c2),
rule(rule, metric, kind, type, title) AS (VALUES (0, 'progressivePassSuccessRate', 'z', 'build_up', 'Low progressive pass success'),
  (1, 'finalThirdPassSuccessRate', 'z', 'build_up', 'Low success entering final third'), (2, 'progressivePassShare', 'p25', 'build_up', 'Low vertical progression share'),
  (3, 'lossRate', 'p75', 'ball_loss', 'High ball losses'), (4, 'ownHalfLossRate', 'p75', 'ball_loss', 'Risky losses in own half'),
  (5, 'dangerousLossRate', 'count', 'ball_loss', 'Dangerous own-half losses'), (6, 'xgPerShot', 'xg', 'final_third', 'Low-quality shot profile'),
  (7, 'boxEfficiency', 'z', 'final_third', 'Poor box efficiency'), (8, 'shotOnTargetRate', 'z', 'final_third', 'Low shot accuracy'),
  (9, 'counterpressingRate', 'p25', 'pressing', 'Low counterpressing impact'), (10, 'highRecoveryRate', 'p25', 'pressing', 'Few high recoveries'),
  (11, 'pressingDuelSuccessRate', 'p25', 'pressing', 'Low pressing duel success'), (12, 'duelSuccessRate', 'p25', 'duels', 'Low duel success'),
  (13, 'defensiveDuelSuccessRate', 'p25', 'duels', 'Defensive duel weakness'), (14, 'aerialDuelSuccessRate', 'p25', 'duels', 'Aerial duel weakness')),
i0 AS (SELECT c.*, rule, kind, type, title, dangerousOwnHalfLosses AS dangerous, o.z AS sot FROM c JOIN rule USING (metric) JOIN t USING (match_id, team_id)
  JOIN (SELECT match_id, team_id, z FROM c WHERE metric = 'shotOnTargetRate') o USING (match_id, team_id)),
i1 AS (SELECT *, CASE WHEN kind = 'z' AND z < -1 THEN least(1, (-1 - z) / 1.5::DOUBLE)
  WHEN kind = 'xg' AND z < -1 THEN least(1, least(1, (-1 - z) / 1.5::DOUBLE) + CASE WHEN sot < -0.5 THEN 0.15::DOUBLE ELSE 0 END)
  WHEN kind = 'p25' AND percentile < 25 THEN (25 - percentile) / 25 WHEN kind = 'p75' AND percentile > 75 THEN (percentile - 75) / 25
  WHEN kind = 'count' AND dangerous > 0 AND value > mean THEN 0.5::DOUBLE * CASE WHEN mean <= 0 THEN 0 ELSE least(1, (value - mean) / mean) END + 0.5::DOUBLE * least(1, dangerous / 3) END AS severity FROM i0),
i AS (SELECT *, 0.55::DOUBLE + 0.45::DOUBLE * severity AS confidence, CASE WHEN severity >= 0.75 THEN 'high' WHEN severity >= 0.45 THEN 'medium' ELSE 'low' END AS label,
  row_number() OVER (PARTITION BY match_id, team_id ORDER BY round(severity, 9) DESC, rule) AS rank FROM i1 WHERE severity IS NOT NULL),
i6 AS (SELECT * FROM i WHERE rank <= 6),
st AS (SELECT match_id, team_id, metric, CASE status WHEN 'very_weak' THEN 0.40::DOUBLE WHEN 'weak' THEN 0.22 WHEN 'warning' THEN 0.16 ELSE 0 END AS score,
  CASE WHEN metric IN ('passSuccessRate', 'progressivePassSuccessRate', 'finalThirdPassSuccessRate', 'progressivePassShare', 'finalThirdEntryShare') THEN 'build_up'
  WHEN metric IN ('lossRate', 'ownHalfLossRate', 'dangerousLossRate') THEN 'ball_loss' WHEN metric IN ('shotOnTargetRate', 'xgPerShot', 'boxEfficiency') THEN 'final_third'
  WHEN metric IN ('counterpressingRate', 'highRecoveryRate', 'pressingDuelSuccessRate') THEN 'pressing'
  WHEN metric IN ('duelSuccessRate', 'defensiveDuelSuccessRate', 'offensiveDuelSuccessRate', 'aerialDuelSuccessRate') THEN 'duels' END AS bucket FROM c),
br AS (SELECT match_id, team_id, bucket, max(score) AS score FROM (SELECT match_id, team_id, bucket, score FROM st UNION ALL SELECT match_id, team_id, type, severity FROM i6) GROUP BY ALL),
w0 AS (SELECT match_id, team_id, max(score) FILTER (WHERE bucket = 'build_up') AS build_up, max(score) FILTER (WHERE bucket = 'ball_loss') AS ball_loss,
  max(score) FILTER (WHERE bucket = 'final_third') AS final_third, max(score) FILTER (WHERE bucket = 'pressing') AS pressing, max(score) FILTER (WHERE bucket = 'duels') AS duels FROM br GROUP BY ALL),
w AS (SELECT w0.*, greatest(0.30::DOUBLE * build_up + 0.25::DOUBLE * ball_loss + 0.20::DOUBLE * final_third + 0.15::DOUBLE * pressing + 0.10::DOUBLE * duels, 0.75::DOUBLE * coalesce(worst, 0)) AS overall
  FROM w0 LEFT JOIN (SELECT match_id, team_id, max(severity) AS worst FROM i6 GROUP BY ALL) USING (match_id, team_id)),
rep AS (SELECT *, CASE WHEN overall < 0.2 THEN 'low' WHEN overall < 0.4 THEN 'medium-low' WHEN overall < 0.6 THEN 'medium' WHEN overall < 0.8 THEN 'medium-high' ELSE 'high' END AS risk FROM w)"""
_C = f"""{_BASE}, c0 AS (SELECT v.*, mean, std, CASE WHEN std <> 0 THEN (value - mean) / std END AS z,
  CASE WHEN std <> 0 THEN 100.0::DOUBLE * cume_dist() OVER (PARTITION BY v.metric ORDER BY value) END AS percentile FROM v JOIN b USING (metric)), {_RULES}"""
_L = f"""{_V}, v0 AS (SELECT * FROM v WHERE match_id % 2 = 0), b AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, list_sort(list(value)) AS l FROM v0 GROUP BY metric),
c0 AS (SELECT v.*, mean, std, CASE WHEN std <> 0 THEN (value - mean) / std END AS z, CASE WHEN std <> 0 THEN 100.0::DOUBLE * len(list_filter(l, lambda x: x <= value)) / len(l) END AS percentile
  FROM v JOIN b USING (metric) WHERE match_id % 2 <> 0), {_RULES}"""
_SENS = ("passes", "losses", "xgShot", "shots", "recoveries", "duels")
_TWO = f"""WITH {TEAM_MATCHES}, u AS (SELECT match_id, team_id, """ + ", ".join(f"CASE WHEN team_id % 4 = 0 THEN {m} * 0.9::DOUBLE ELSE {m} END AS {m}" for m in _SENS) + """ FROM t WHERE (match_id + team_id) % 9 <> 0),
j AS (""" + " UNION ALL ".join(f"SELECT match_id, team_id, '{m}' AS metric, coalesce(t.{m}, 0) AS h, coalesce(u.{m}, 0) AS s FROM t FULL JOIN u USING (match_id, team_id)" for m in _SENS) + """),
p AS (SELECT *, 100.0::DOUBLE * abs(h - s) / greatest(abs(s), 1) AS pct FROM j)"""
_BAD = ", ".join(f"('not_finite_{m}', (SELECT count(*) FROM r WHERE {m} IS NULL OR NOT isfinite({m})))" for m in B.RATIOS)
_ZERO = {m: " + ".join(d) for m, (_, d, _) in B.RATIOS.items()}

SQL = {
    "b4_ratios": f"{_V} SELECT match_id, team_id, {_R(6, *B.RATIOS)} FROM r",
    "b5_ratio_report": f"WITH {TEAM_MATCHES} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (WHERE {d} = 0) AS zero_denominators, 0 AS not_finite FROM t" for m, d in _ZERO.items()),
    "b7_league_baseline": f"{_BASE} SELECT metric, n, {_R(6, 'mean', 'std', 'min', 'max')}, " + ", ".join(f"round(q[{k}] + 3.3e-10, 6) AS {p}" for k, p in enumerate(("p10", "p25", "p50", "p75", "p90"), 1)) + " FROM b",
    "w6_percentiles": f"{_V} SELECT DISTINCT metric, round(value + 3.30e-10, 6) AS value, round(percentile + 3.30e-10, 6) AS percentile FROM (SELECT metric, value, 100.0::DOUBLE * cume_dist() OVER (PARTITION BY metric ORDER BY value) AS percentile FROM v)",
    "b9_comparisons": f"{_C} SELECT match_id, team_id, metric, status, status IN ('weak', 'very_weak') AS is_weakness, {_R(5, 'z', 'percentile')} FROM c",
    "b10_focus": f"{_C} SELECT team_id, status, count(*) AS n FROM c WHERE team_id IN (SELECT s_suppkey FROM supplier WHERE lower(s_name) IN ('supplier#000000003', 'supplier#000000007', 'supplier#00000000a')) GROUP BY ALL",
    "b11_rules": f"{_C} SELECT match_id, team_id, title, type, label, rank, {_R(5, 'severity', 'confidence')} FROM i",
    "b11_full_insights": f"""{_C}, tx(title, message, recommendation) AS (VALUES ('Low progressive pass success', 'Progressive passing efficiency is below league baseline.', 'Improve central progression patterns and third-man passing options.'),
        ('Low success entering final third', 'Final-third entry passing success is below league baseline.', 'Increase quality of vertical support angles and timing before final-third entry.'),
        ('Low vertical progression share', 'The share of progressive passes is in the bottom quartile.', 'Increase vertical passing volume from midfield and first build-up line.'),
        ('High ball losses', 'Ball-loss rate is in the risk zone versus league baseline.', 'Reduce forced actions in congested zones and improve support distances.'),
        ('Risky losses in own half', 'Own-half loss rate is above safe league ranges.', 'Prioritize safer first-phase exits and cleaner support under pressure.'),
        ('Dangerous own-half losses', 'Dangerous loss exposure in own half is above league norm.', 'Protect central rest-defense zones and reduce risky receptions facing own goal.'),
        ('Low-quality shot profile', 'Chance quality per shot is below league baseline.', 'Shift final-third actions toward central cutbacks and higher-probability shooting zones.'),
        ('Poor box efficiency', 'Final-third box actions convert into low xG output versus league baseline.', 'Improve shot selection and box occupation timing before finishing.'),
        ('Low shot accuracy', 'Shot-on-target rate is below league baseline.', 'Create cleaner finishing scenarios and reduce low-balance attempts.'),
        ('Low counterpressing impact', 'Counterpressing recovery rate is in the bottom quartile.', 'Compress distances around ball loss and trigger immediate pressure with nearest support.'),
        ('Few high recoveries', 'Opponent-half recovery rate is below league baseline.', 'Improve coordinated pressure to win more second balls in advanced zones.'),
        ('Low pressing duel success', 'Pressing duel success is in the bottom quartile.', 'Refine pressing body shape and first contact timing to improve duel outcomes.'),
        ('Low duel success', 'Overall duel success is below league reference values.', 'Improve duel preparation distances and support structure around contested zones.'),
        ('Defensive duel weakness', 'Defensive duel win rate is in the bottom quartile.', 'Improve first-contact timing and cover-shadow positioning in defensive duels.'),
        ('Aerial duel weakness', 'Aerial duel win rate is below league baseline.', 'Improve second-ball positioning and timing on aerial contests.')),
        sh AS (SELECT match_id, team_id, value AS sv, z AS sz, percentile AS sp FROM c WHERE metric = 'shotOnTargetRate'),
        q AS (SELECT match_id, team_id, title, message, recommendation, metric, value, mean AS league_average, z, percentile, CASE WHEN kind = 'count' THEN dangerous END AS dangerous,
          CASE WHEN kind = 'xg' THEN 'shotOnTargetRate' END AS supporting_metric, CASE WHEN kind = 'xg' THEN sv END AS supporting_value, CASE WHEN kind = 'xg' THEN sz END AS supporting_z, CASE WHEN kind = 'xg' THEN sp END AS supporting_percentile
          FROM i6 JOIN tx USING (title) JOIN sh USING (match_id, team_id))
        SELECT match_id, team_id, title, message, recommendation, metric, supporting_metric, {_R(5, 'value', 'league_average', 'z', 'percentile', 'dangerous', 'supporting_value', 'supporting_z', 'supporting_percentile')} FROM q""",
    "b12_insights": f"{_C} SELECT match_id, team_id, title, rank FROM i6",
    "b14_weakness_report": f"{_C} SELECT match_id, team_id, risk, {_R(5, 'build_up', 'ball_loss', 'final_third', 'pressing', 'duels', 'overall')} FROM rep",
    "b15_final_report": f"""{_C}, n AS (SELECT match_id, team_id, count(*) FILTER (WHERE status IN ('weak', 'very_weak')) AS weak_metrics, count(*) AS metrics_compared FROM c GROUP BY ALL),
        ti AS (SELECT match_id, team_id, string_agg(title, '; ' ORDER BY rank) AS titles FROM i6 GROUP BY ALL),
        x AS (SELECT rep.*, weak_metrics, metrics_compared, coalesce(titles, '') AS titles, CASE WHEN team_id % 3 <> 0 THEN team_id % 3 END AS cluster,
        CASE WHEN team_id % 3 <> 0 THEN 'profile_' || (team_id % 3) ELSE 'unknown_profile' END AS profile, CASE WHEN team_id % 5 <> 0 THEN lossRate END AS anomaly_score, team_id % 5 <> 0 AND lossRate > 0.2 AS is_anomalous
        FROM rep JOIN n USING (match_id, team_id) JOIN (SELECT match_id, team_id, lossRate FROM r) USING (match_id, team_id) LEFT JOIN ti USING (match_id, team_id))
        SELECT match_id, team_id, risk, weak_metrics, metrics_compared, cluster, profile, is_anomalous, titles, {_R(5, 'overall', 'anomaly_score')} FROM x""",
    "b16_strengths": f"""{_C}, s AS (SELECT c.*, row_number() OVER (PARTITION BY match_id, team_id ORDER BY round(abs(z), 9) DESC, k) AS rank FROM c JOIN dir USING (metric) WHERE status IN ('strong', 'very_strong'))
        SELECT match_id, team_id, metric, status, rank, {_R(5, 'value', 'mean')} FROM s WHERE rank <= 2""",
    "b16_weakness_signals": f"""{_C} SELECT match_id, team_id, rank, type || '.' || regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g') AS signal_id, type AS category, label, metric,
        CASE WHEN bad_when_high THEN 'higher_is_worse' ELSE 'higher_is_better' END AS direction, {_R(5, 'severity', 'z', 'percentile')} FROM i6""",
    "b17_live_report": f"{_L} SELECT match_id, team_id, risk, {_R(5, 'overall')} FROM rep",
    "b17_live_comparisons": f"{_L} SELECT match_id, team_id, metric, status, {_R(5, 'z', 'percentile')} FROM c",
    "b6_sensitivity": f"""{_TWO}, g AS (SELECT metric, count(*) AS n, sum(h) AS total_heuristic, sum(s) AS total_strict, avg(abs(h - s)) AS mean_diff, avg(pct) AS mean_pct, max(pct) AS max_pct FROM p GROUP BY metric)
        SELECT metric, n, CASE WHEN (SELECT max(mean_pct) FROM g) < 3 THEN 'heuristic' ELSE 'strict' END AS mode, {_R(4, 'total_heuristic', 'total_strict', 'mean_diff', 'mean_pct', 'max_pct')} FROM g""",
    "b6_most_sensitive": f"{_TWO}, g0 AS (SELECT match_id, team_id, sum(p.pct) AS pct FROM p GROUP BY ALL), g AS (SELECT * FROM g0 ORDER BY round(g0.pct, 6) DESC, match_id, team_id LIMIT 20) SELECT match_id, team_id, {_R(4, 'pct')} FROM g",
    "b2_surrogate_ids": "SELECT DISTINCT p_name, dense_rank() OVER (ORDER BY lower(p_name)) AS id FROM part WHERE p_name IS NOT NULL",
    "b18_checks": f"""{_V}, k AS (SELECT match_id, team_id, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT match_id, count(*) AS teams FROM k GROUP BY ALL)
        SELECT * FROM (VALUES ('missing_id', (SELECT count(*) FROM r WHERE match_id IS NULL OR team_id IS NULL)), {_BAD}, ('repeated_key', (SELECT count(*) FROM k WHERE n > 1)),
        ('under_two_teams', (SELECT count(*) FROM m WHERE teams < 2)), ('over_two_teams', (SELECT count(*) FROM m WHERE teams > 2))) x("check", failures)""",
}
