"""Queries over decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decision as D
from ..sources.adapters import ACTIONS, actions
from ..sources.shared import written
from .rounding import pick as _pick
from .rounding import rounded as _R


def _scored(s, d):
    """Scores by a fixed rule of place and type; a trained model takes its place in operators.models."""
    a = actions(s, d).where(F.col("event_type").isin(*D.ACTIONS))
    p = {"p_pass": F.col("x") / 200, "p_shot": F.col("x") * F.col("x") / 20000, "p_carry": (F.col("x") + F.col("y")) / 400}
    a = a.withColumns(p).withColumn("value", F.when(F.col("event_type") == "pass", F.col("p_pass")).when(F.col("event_type") == "shot", F.col("p_shot")).otherwise(F.col("p_carry")))
    return written(a, "scored-actions")


def _chosen(s, d):
    return D.choose(_scored(s, d))


def _lookups(s, d):
    """What is asked for: every twentieth action, by event, by second, by player or by minute and player."""
    a = actions(s, d).where("event_id % 20 = 0")
    kind = (F.col("event_id") / 20).cast("bigint") % 4
    of = lambda kinds, c: F.when(kind.isin(*kinds), c)
    return a.select(F.col("event_id").alias("lookup_id"), "match_id", of((0,), F.col("event_id")).alias("event_id"), of((1, 3), F.floor(F.col("sec") / 60)).alias("minute"), of((1,), F.col("sec") % 60).alias("second"), of((2, 3), F.col("player_id")).alias("player_id"))


def _labelled(s, d):
    return D.label(actions(s, d), 600).select(F.col("label").alias("y"), (F.col("x") / 200 + F.col("y") / 1000).alias("p"))


QUERIES = {
    "w1_context": lambda s, d: _pick(D.context(actions(s, d), 1), ("event_id", "prev_type", "prev_position", "prev_x", "prev_y", "gap", "same_player", "same_possession", "zone_x", "zone_y", "final_third", "box", "is_focus"), "goal_distance", "goal_angle"),
    "dq1_feature_matrix": lambda s, d: D.feature_matrix(D.label(actions(s, d), 600), 1).select("event_id", "label", *D.CATEGORICAL, *[F.round(F.col(c) + 3.3e-10, 6).alias(c) for c in D.NUMERIC]),
    "w3_label": lambda s, d: D.label(actions(s, d), 600).select("event_id", "label"),
    "w5_average_rank": lambda s, d: _pick(D.average_rank(_scored(s, d), "value"), (), "value", "rank", digits=8),
    "dq3_best_action": lambda s, d: _pick(_chosen(s, d), ("event_id", "best", "low", "suggested"), "gain"),
    "dq4_player_summary": lambda s, d: _pick(D.player_summary(_chosen(s, d)), ("player_id", "actions", "low_actions", "suggestions", "needs_support"), "score", "mean_gain"),
    "dq5_player_types": lambda s, d: _pick(D.player_summary(_chosen(s, d)), ("player_id", "usual_suggestion", "best_type", "weak_type"), "score_rank"),
    "dq13_lookups": lambda s, d: _pick(D.lookup_phases(_chosen(s, d), _lookups(s, d)), ("lookup_id", "matched", "event_id", "player_id", "best", "suggested", "ranked"), "gain", "value"),
    "dq7_missed": lambda s, d: _pick(D.missed(_chosen(s, d)), ("match_id", "event_id", "rank"), "gain"),
    "dq10_timeline": lambda s, d: _pick(D.timeline(_chosen(s, d)), ("match_id", "bucket", "actions", "low", "with_alternative"), "value"),
    "dq11_by_type": lambda s, d: _pick(D.by_type(_chosen(s, d)), ("decision", "actions", "low"), "value", "gain"),
    "m4_evaluation": lambda s, d: _pick(D.evaluation(_labelled(s, d)), ("n",), "auc", "average_precision", "brier"),
}

_A = f"WITH {ACTIONS}, aa AS (SELECT * FROM a WHERE event_type IN ('pass', 'shot', 'carry'))"
_S = f"""{_A}, s0 AS (SELECT *, x / 200 AS p_pass, x * x / 20000 AS p_shot, (x + y) / 400 AS p_carry FROM aa),
s1 AS (SELECT *, CASE event_type WHEN 'pass' THEN p_pass WHEN 'shot' THEN p_shot ELSE p_carry END AS value, greatest(p_pass, p_shot, p_carry) AS best_value FROM s0),
s2 AS (SELECT *, CASE best_value WHEN p_pass THEN 'pass' WHEN p_shot THEN 'shot' ELSE 'carry' END AS best, best_value - value AS gain, value <= (SELECT quantile_cont(value, 0.25) FROM s1) AS low FROM s1),
ch AS (SELECT *, CASE WHEN low AND best <> event_type AND gain >= 0.02 THEN best END AS suggested FROM s2)"""
_CTX = f"""{_A}, cx AS (SELECT *, (sec // 60)::DOUBLE AS minute, (sec % 60)::DOUBLE AS second, coalesce(lag(event_type) OVER w, 'none') AS prev_type, coalesce(lag(coalesce(position, 'UNK')) OVER w, 'none') AS prev_position, coalesce(lag(x) OVER w, x) AS prev_x, coalesce(lag(y) OVER w, y) AS prev_y,
  greatest(0, coalesce(sec - lag(sec) OVER w, 0)) AS gap, coalesce(lag(player_id) OVER w = player_id, false) AS same_player, coalesce(lag(possession_id) OVER w = possession_id, false) AS same_possession,
  least(9, floor(x / 10))::BIGINT AS zone_x, least(9, floor(y / 10))::BIGINT AS zone_y, x >= 66.7 AS final_third, x >= 83 AND y BETWEEN 21 AND 79 AS box, team_id = 1 AS is_focus,
  sqrt((100 - x) * (100 - x) + (50 - y) * (50 - y)) AS goal_distance, degrees(atan2(abs(50 - y), 100 - x + 1e-6)) AS goal_angle FROM aa WINDOW w AS (PARTITION BY match_id, team_id ORDER BY sec, event_id))"""
_LAB = f"""{_A}, l AS (SELECT *, coalesce(max((event_type = 'shot' OR coalesce(is_goal, false))::INT) OVER (PARTITION BY match_id, team_id ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 600 FOLLOWING), 0) AS label FROM aa)"""

SQL = {
    "w1_context": f"{_CTX} SELECT event_id, prev_type, prev_position, prev_x, prev_y, gap, same_player, same_possession, zone_x, zone_y, final_third, box, is_focus, {_R(6, 'goal_distance', 'goal_angle')} FROM cx",
    "dq1_feature_matrix": f"""{_CTX}, l AS (SELECT event_id, coalesce(max((event_type = 'shot' OR coalesce(is_goal, false))::INT) OVER (PARTITION BY match_id, team_id ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 600 FOLLOWING), 0) AS label FROM aa)
        SELECT event_id, label, event_type, coalesce(position, 'UNK') AS position, period, team_id::VARCHAR AS team_id, flank, prev_type, prev_position, """ + ", ".join(f"round({c}::INT::DOUBLE + 3.3e-10, 6) AS {c}" if c in ("final_third", "box", "is_focus", "same_player", "same_possession") else f"round({c}::DOUBLE + 3.3e-10, 6) AS {c}" for c in D.NUMERIC) + " FROM cx JOIN l USING (event_id)",
    "w3_label": f"{_LAB} SELECT event_id, label FROM l",
    "w5_average_rank": f"{_S} SELECT round(value + 3.30e-12, 8) AS value, round((r + (n - 1) / 2.0::DOUBLE) / total + 3.3e-12, 8) AS rank FROM (SELECT value, min(rk) AS r, count(*) AS n, any_value(total) AS total FROM (SELECT value, rank() OVER (ORDER BY value) AS rk, count(*) OVER () AS total FROM s1) GROUP BY value)",
    "dq3_best_action": f"{_S} SELECT event_id, best, low, suggested, round(gain + 3.30e-10, 6) AS gain FROM ch",
    "dq4_player_summary": f"""{_S}, p AS (SELECT player_id, count(*) AS actions, avg(value) AS score, count(*) FILTER (WHERE low) AS low_actions, count(suggested) AS suggestions, avg(gain) FILTER (WHERE suggested IS NOT NULL) AS mean_gain FROM ch GROUP BY ALL)
        SELECT player_id, actions, low_actions, suggestions, score <= (SELECT quantile_cont(score, 0.25) FROM p) AND actions >= 3 AS needs_support, {_R(6, 'score')}, round(coalesce(mean_gain, 0) + 3.3e-10, 6) AS mean_gain FROM p""",
    "dq5_player_types": f"""{_S}, p AS (SELECT player_id, avg(value) AS score, count(*) FILTER (WHERE suggested = 'pass') AS n1, count(*) FILTER (WHERE suggested = 'shot') AS n2, count(*) FILTER (WHERE suggested = 'carry') AS n3 FROM ch GROUP BY ALL),
        t AS (SELECT player_id, event_type, avg(value) AS v FROM ch GROUP BY ALL), b AS (SELECT player_id, arg_max(event_type, (v, event_type = 'carry', event_type = 'pass')) AS best_type, arg_min(event_type, (v, event_type <> 'carry', event_type <> 'pass')) AS weak_type FROM t GROUP BY ALL),
        r AS (SELECT player_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS score_rank FROM p)
        SELECT player_id, CASE WHEN greatest(n1, n2, n3) = 0 THEN NULL WHEN n1 = greatest(n1, n2, n3) THEN 'pass' WHEN n2 = greatest(n1, n2, n3) THEN 'shot' ELSE 'carry' END AS usual_suggestion, best_type, weak_type, {_R(6, 'score_rank')} FROM p JOIN b USING (player_id) JOIN r USING (player_id)""",
    "dq13_lookups": f"""{_S}, lk AS (SELECT event_id AS lookup_id, match_id, CASE WHEN q = 0 THEN event_id END AS e, CASE WHEN q IN (1, 3) THEN sec // 60 END AS mi, CASE WHEN q = 1 THEN sec % 60 END AS se, CASE WHEN q IN (2, 3) THEN player_id END AS pl
          FROM (SELECT *, (event_id // 20) % 4 AS q FROM a WHERE event_id % 20 = 0)),
        u AS (SELECT event_id, string_agg(act, ',' ORDER BY v DESC, k) AS ranked FROM (""" + " UNION ALL ".join(f"SELECT event_id, '{a}' AS act, {k} AS k, p_{a} AS v FROM ch" for k, a in enumerate(D.ACTIONS)) + f""") GROUP BY event_id),
        j AS (SELECT lookup_id, ch.*, ranked, count(*) OVER (PARTITION BY lookup_id) AS matched, row_number() OVER (PARTITION BY lookup_id ORDER BY round(ch.gain, 9) DESC, round(ch.value, 9), sec, event_id) AS r FROM ch JOIN lk USING (match_id) JOIN u USING (event_id)
          WHERE (e IS NULL OR e = event_id) AND (mi IS NULL OR mi = sec // 60) AND (se IS NULL OR se = sec % 60) AND (pl IS NULL OR pl = player_id))
        SELECT lookup_id, matched, event_id, player_id, best, suggested, ranked, {_R(6, 'gain', 'value')} FROM j WHERE r = 1""",
    "dq7_missed": f"""{_S} SELECT match_id, event_id, rank, round(gain + 3.30e-10, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(gain, 9) DESC, event_id) AS rank FROM ch
        WHERE best_value >= (SELECT quantile_cont(best_value, 0.85) FROM ch) AND gain >= 0.02 AND NOT coalesce(is_goal, false) AND NOT coalesce(on_target, false)) WHERE rank <= 5""",
    "dq10_timeline": f"{_S} SELECT match_id, (floor(sec / 900) * 900)::BIGINT AS bucket, count(*) AS actions, count(*) FILTER (WHERE low) AS low, count(suggested) AS with_alternative, round(avg(value) + 3.3e-10, 6) AS value FROM ch GROUP BY ALL",
    "dq11_by_type": f"{_S} SELECT event_type AS decision, count(*) AS actions, count(*) FILTER (WHERE low) AS low, round(avg(value) + 3.3e-10, 6) AS value, round(avg(gain) + 3.3e-10, 6) AS gain FROM ch GROUP BY ALL",
    "m4_evaluation": f"""{_LAB}, p AS (SELECT label AS y, x / 200 + y / 1000 AS p FROM l), g AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n, sum((p - y) * (p - y)) AS sq FROM p GROUP BY p),
        h AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS al FROM g)
        SELECT sum(n)::BIGINT AS n, round(sum((n - pos) * (tp - pos) + (n - pos) * pos / 2) / (sum(pos) * sum(n - pos)) + 3.3e-10, 6) AS auc, round(sum(pos * tp / al) / sum(pos) + 3.3e-10, 6) AS average_precision, round(sum(sq) / sum(n) + 3.3e-10, 6) AS brier FROM h""",
}
