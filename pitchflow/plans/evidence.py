"""Queries of signals before and after fusion, of result filters and citations, and of input reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import decision as D
from ..operators import docs as G
from ..operators import payloads as P
from ..operators import signals as N
from ..sources.adapters import ACTIONS, EVENTS, PLAYER_DAYS, _events, actions, player_days, table
from . import teams as team_plans
from .reports import _MISSED
from .rounding import pick
from .rounding import rounded as _R

_REQUIRED = ("player_id", "end_x", "recipient_id", "possession_id")
_METRICS = ("lossRate", "xgPerShot", "duelSuccessRate", "counterpressingRate", "passSuccessRate", "unheardOf")
_RAW = {
    "category": "CASE k % 4 WHEN 0 THEN 'duels' WHEN 1 THEN 'unknown' END",
    "score": "CASE WHEN k % 3 = 0 THEN value / 50 - 0.1 END",
    "label": "CASE k % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'critical' WHEN 4 THEN 'other' END",
}
_HIT = {
    "team_id": "CASE WHEN vec_id % 4 <> 0 THEN vec_id % 3 END",
    "document_type": "CASE vec_id % 2 WHEN 0 THEN 'Report' ELSE 'page' END",
    "title": "CASE WHEN vec_id % 3 = 0 THEN 'Vector ' || vec_id WHEN vec_id % 3 = 1 THEN ' ' END",
    "page": "CASE WHEN vec_id % 5 <> 0 THEN vec_id % 7 END",
    "doc": "'v' || (vec_id % 50)",
    "scope": "CASE vec_id % 2 WHEN 0 THEN 'match' ELSE 'club' END",
}
_TITLE = "CASE WHEN doc_id % 3 <> 0 THEN source || ' ' || doc_id END"


def _raw_signals(s, d):
    metric = F.get(F.array(*map(F.lit, _METRICS)), (F.col("event_id") % 6).cast("int"))
    return _events(s, d).select("event_id", metric.alias("metric"), *[F.expr(x).alias(c) for c, x in _RAW.items()])


def _decision_signals(s, d):
    c = D.choose(team_plans._scored(s, d)).withColumn("decision", F.col("event_type"))
    support = D.player_summary(c).where("needs_support").select("player_id", "score", F.col("low_actions").alias("low"), "actions")
    weak = c.where("low").groupBy("player_id").agg(F.min("decision").alias("decision"))
    by_type = c.groupBy("match_id", "decision").agg(F.avg("value").alias("value"), F.count_if("low").alias("low"), F.count(F.lit(1)).alias("actions"))
    out = N.decision_signals(c.where("suggested is not null"), D.missed(c), support.join(weak, "player_id", "left"), by_type)
    return pick(out, ("match_id", "category", "player_id", "decision", "reason"), "severity")


def _hits(s, d, k):
    v = table(s, d, "embeddings")
    return G.cosine_top_k(v, v.where("vec_id % 20 = 0"), k).select("query_id", "vec_id", "score", "rank", *[F.expr(x).alias(c) for c, x in _HIT.items()])


def _embedding_inputs(s, d):
    players = F.expr("transform(sequence(0, doc_id % 9), x -> cast(doc_id + x as string))")
    text = G.embedding_input(F.expr(_TITLE), F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 4 > 0, players), F.col("text"))
    return table(s, d, "documents").select("doc_id", F.sha2(text, 256).alias("input_sha256"))


def _flatten_report(s, d):
    """Rows seen, filtered for their minutes and without an id, and expected players without a row."""
    p = player_days(s, d)
    seen = p.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("duration") <= 60).alias("filtered"), F.count_if(F.col("player_id").isNull()).alias("missing_id"))
    absent = table(s, d, "customer").join(p.select(F.col("player_id").alias("c_custkey")), "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("expected_absent"))
    return seen.join(absent)


def _days_with_clusters(s, d):
    """A label of each player on all player days; players without one get 'none'."""
    p = player_days(s, d)
    label = F.when(F.col("total") >= 1500, "heavy").when(F.col("total") >= 300, "medium")
    labels = p.groupBy("player_id").agg(F.sum("duration").alias("total")).select("player_id", label.alias("cluster"))
    return p.select("player_id", "day", "sessions").join(labels, "player_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit("none")))


#: Payloads of both inputs of signal fusion, by event, sound and damaged ones; the same text in both engines.
_INPUT1 = """CASE WHEN event_id % 13 = 0 THEN 'no json' WHEN event_id % 13 = 1 THEN '[1]' ELSE '{"x": 1' ||
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ', "baselineModel": {"riskLevel": "low", "anomalyScore": null}' WHEN 2 THEN ', "baselineModel": 3'
    ELSE ', "baselineModel": {"overallWeaknessScore": 0.5, "riskLevel": "low", "tacticalProfile": "p", "anomalyScore": 1}' END ||
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ', "weaknessSignals": {}' WHEN 2 THEN ', "weaknessSignals": []'
    WHEN 3 THEN ', "weaknessSignals": [{"signalId": 1, "category": "c", "severityScore": 0.1, "metric": "m"}, {"signalId": 1, "category": null}, 7]'
    ELSE ', "weaknessSignals": [{"signalId": 1, "category": "c", "severityScore": 0.1, "metric": "m"}]' END ||
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', "metricComparisons": null' ELSE ', "metricComparisons": {}' END || '}' END"""
_INPUT2 = """'{"summary": ' || CASE event_id % 4 WHEN 0 THEN '{"averageDecisionValue": 1, "lowDecisionPhases": 2, "phasesWithAlternative": 3, "missedShotOrGoalOpportunities": 4}' WHEN 1 THEN '{"lowDecisionPhases": 2}' WHEN 2 THEN '"s"' ELSE '{}' END ||
  CASE event_id % 3 WHEN 0 THEN ', "players": {"needsSupport": []}' WHEN 1 THEN ', "players": {"needsSupport": 1}' ELSE '' END ||
  CASE event_id % 5 WHEN 0 THEN ', "phases": {"improvablePhases": [], "missedShotOrGoalOpportunities": [1]}' WHEN 1 THEN ', "phases": {"improvablePhases": {}}' ELSE ', "phases": []' END ||
  CASE event_id % 2 WHEN 0 THEN ', "teamStats": {"decisionByType": [1], "timeline": null}' ELSE ', "teamStats": {"timeline": []}' END || '}'"""


def _payload_errors(s, d):
    e = table(s, d, "events").select("event_id", F.expr(_INPUT1).alias("input1"), F.expr(_INPUT2).alias("input2"))
    one = lambda n, spec: P.check(e, n, spec, n).where(F.size("errors") > 0).select("event_id", F.lit(n).alias("input"), F.array_join("errors", "; ").alias("errors"), "error")
    return one("input1", P.INPUT1).unionByName(one("input2", P.INPUT2))


QUERIES = {
    "x1_payload_errors": _payload_errors,
    "x1_input_errors": lambda s, d: N.errors(actions(s, d), _REQUIRED).select("event_id", F.array_join("errors", ",").alias("errors")),
    "x2_baseline_signals": lambda s, d: pick(N.baseline_signals(_raw_signals(s, d)), ("event_id", "category", "metric"), "severity"),
    "x3_decision_signals": _decision_signals,
    "f8_labels": lambda s, d: table(s, d, "documents").select("doc_id", scalar.metric_label(F.expr("lang || upper(substr(source, 1, 1)) || substr(source, 2)"), {"enWeb": "English pages"}).alias("label")),
    "r7_flatten_report": _flatten_report,
    "j9_days_with_clusters": _days_with_clusters,
    "g2_document_reasons": lambda s, d: table(s, d, "documents").select("source", F.coalesce(G.document_problem(F.col("doc_id").cast("string"), F.col("text")), F.lit("taken")).alias("reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n")),
    "g5_embedding_inputs": _embedding_inputs,
    "g9_filtered_or_relaxed": lambda s, d: G.filtered_or_relaxed(_hits(s, d, 8), G.passes(1, ("report",), 0.2), 0.05).select("query_id", "vec_id", "relaxed"),
    "g12_citations": lambda s, d: G.citations(_hits(s, d, 8)),
}

_S = team_plans._S
_CLAMP = "greatest(0, least(1, {0}))"
_OF = "coalesce(CASE {0} WHEN 'pass' THEN 'build_up' WHEN 'carry' THEN 'progression' WHEN 'shot' THEN 'final_third' END, '{1}')"
_SHORT = "CASE WHEN length(doc_id::VARCHAR) < 3 THEN 'id_short' WHEN coalesce(length(text), 0) < 10 THEN 'text_short' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) = '' THEN 'text_blank' ELSE 'taken' END"
_HITS = """sim AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    hits AS (SELECT *, {0} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim) WHERE rank <= 8)""".format(", ".join(f"{x} AS {c}" for c, x in _HIT.items()))

def _missing(path: str, said: str, fields: tuple[str, ...]) -> str:
    """SQL for the message on missing fields of the object at a path, null if none is missing."""
    found = ", ".join(f"CASE WHEN json_type(v, {path} || '.{f}') IS NULL THEN '{f}' END" for f in fields)
    return f"CASE WHEN json_type(v, {path}) = 'OBJECT' AND concat_ws(', ', {found}) <> '' THEN 'Missing required fields in `' || {said} || '`: ' || concat_ws(', ', {found}) END"


def _is(path: str, kind: str) -> str:
    """SQL for the message on a field that is there but of another kind."""
    what = {"OBJECT": "an object", "ARRAY": "an array"}[kind]
    return f"CASE WHEN json_type(v, '$.{path}') <> '{kind}' THEN '`' || root || '.{path}` must be {what}' END"


def _own(path: str, *fields: str) -> str:
    return _missing(f"'$.{path}'", f"root || '.{path}'", fields)


_SIGNAL = "'$.weaknessSignals[' || i || ']'"
_PAYLOADS = f"""WITH t AS (SELECT event_id, 'input1' AS root, {_INPUT1} AS text FROM events UNION ALL SELECT event_id, 'input2', {_INPUT2} FROM events),
p AS (SELECT event_id, root, CASE WHEN json_valid(text) THEN text::JSON END AS v FROM t),
e AS (SELECT event_id, root, CASE WHEN coalesce(json_type(v), '') <> 'OBJECT' THEN ['`' || root || '` must be an object'] WHEN root = 'input1' THEN list_concat(
    [{_missing("'$'", "root", ("baselineModel", "weaknessSignals", "metricComparisons"))}, {_is("baselineModel", "OBJECT")},
     {_own("baselineModel", "overallWeaknessScore", "riskLevel", "tacticalProfile", "anomalyScore")}, {_is("weaknessSignals", "ARRAY")}],
    list_transform(range(CASE WHEN json_type(v, '$.weaknessSignals') = 'ARRAY' THEN json_array_length(v, '$.weaknessSignals')::BIGINT ELSE 0 END), lambda i: CASE
        WHEN json_type(v, {_SIGNAL}) <> 'OBJECT' THEN '`input1.weaknessSignals[' || i || ']` must be an object'
        ELSE {_missing(_SIGNAL, "'input1.weaknessSignals[' || i || ']'", ("signalId", "category", "severityScore", "metric"))} END),
    [{_is("metricComparisons", "OBJECT")}])
  ELSE [{_missing("'$'", "root", ("summary", "players", "phases", "teamStats"))}, {_is("summary", "OBJECT")},
    {_own("summary", "averageDecisionValue", "lowDecisionPhases", "phasesWithAlternative", "missedShotOrGoalOpportunities")},
    {_is("players", "OBJECT")}, {_own("players", "needsSupport")}, {_is("players.needsSupport", "ARRAY")},
    {_is("phases", "OBJECT")}, {_own("phases", "improvablePhases", "missedShotOrGoalOpportunities")}, {_is("phases.improvablePhases", "ARRAY")},
    {_is("phases.missedShotOrGoalOpportunities", "ARRAY")}, {_is("teamStats", "OBJECT")}, {_own("teamStats", "decisionByType", "timeline")},
    {_is("teamStats.decisionByType", "ARRAY")}, {_is("teamStats.timeline", "ARRAY")}] END AS said FROM p),
f AS (SELECT event_id, root, list_filter(said, lambda x: x IS NOT NULL) AS said FROM e)
SELECT event_id, root AS input, array_to_string(said, '; ') AS errors, said[1] AS error FROM f WHERE len(said) > 0"""

SQL = {
    "x1_payload_errors": _PAYLOADS,
    "x1_input_errors": f"WITH {ACTIONS}, x AS (SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _REQUIRED) + ") AS errors FROM a) SELECT * FROM x WHERE errors <> ''",
    "x2_baseline_signals": f"""WITH {EVENTS}, r AS (SELECT event_id, ({list(_METRICS)})[(event_id % 6)::INT + 1] AS metric, {", ".join(f"{x} AS {c}" for c, x in _RAW.items())} FROM e),
        m(metric, of) AS (VALUES ('progressivePassSuccessRate', 'build_up'), ('finalThirdPassSuccessRate', 'build_up'), ('passSuccessRate', 'build_up'), ('forwardPassSuccessRate', 'progression'),
          ('lossRate', 'ball_loss'), ('ownHalfLossRate', 'ball_loss'), ('dangerousLossRate', 'ball_loss'), ('xgPerShot', 'final_third'), ('boxEfficiency', 'final_third'),
          ('shotOnTargetRate', 'final_third'), ('duelSuccessRate', 'duels'), ('defensiveDuelSuccessRate', 'duels'), ('offensiveDuelSuccessRate', 'duels'),
          ('aerialDuelSuccessRate', 'duels'), ('highRecoveryRate', 'pressing'), ('counterpressingRate', 'pressing')),
        z AS (SELECT event_id, CASE WHEN category = 'duels' THEN category ELSE of END AS category, metric,
              CASE WHEN score >= 0 THEN least(1, score) ELSE coalesce(CASE lower(label) WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 WHEN 'critical' THEN 0.95 END, 0.5) END::DOUBLE AS severity FROM r LEFT JOIN m USING (metric))
        SELECT event_id, category, metric, {_R(6, 'severity')} FROM z WHERE category IS NOT NULL""",
    "x3_decision_signals": f"""{_S}, {_MISSED}, mt AS (SELECT * FROM mi QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY round(gain, 9) DESC, event_id) <= 5),
        pl AS (SELECT player_id, count(*) AS actions, avg(value) AS score, count(*) FILTER (WHERE low) AS low, min(event_type) FILTER (WHERE low) AS decision FROM ch GROUP BY ALL),
        ty AS (SELECT match_id, event_type AS decision, avg(value) AS value, count(*) FILTER (WHERE low) AS low, count(*) AS actions FROM ch GROUP BY ALL),
        z AS (SELECT match_id, {_OF.format('event_type', 'progression')} AS category, 0.3::DOUBLE + greatest(0, 0.25::DOUBLE - value) * 1.4::DOUBLE + gain * 4 AS v, player_id, event_type AS decision, 'improvable_phase' AS reason FROM ch WHERE suggested IS NOT NULL
          UNION ALL SELECT match_id, 'final_third', 0.45::DOUBLE + gain * 3.5::DOUBLE, player_id, event_type, 'missed_shot_or_goal_opportunity' FROM mt
          UNION ALL SELECT NULL, {_OF.format('decision', 'ball_loss')}, (1 - score) * 0.75::DOUBLE + low / actions * 0.5::DOUBLE, player_id, decision, 'player_needs_support' FROM pl WHERE score <= (SELECT quantile_cont(score, 0.25) FROM pl) AND actions >= 3
          UNION ALL SELECT match_id, {_OF.format('decision', 'progression')}, (0.25::DOUBLE - value) * 1.8::DOUBLE + low / actions, NULL, decision, 'low_decision_phases' FROM ty),
        y AS (SELECT * EXCLUDE v, {_CLAMP.format('v')} AS severity FROM z) SELECT match_id, category, player_id, decision, reason, {_R(6, 'severity')} FROM y""",
    "f8_labels": """WITH n AS (SELECT doc_id, lang || upper(source[1:1]) || source[2:] AS x FROM documents)
        SELECT doc_id, CASE WHEN x = 'enWeb' THEN 'English pages' ELSE upper(x[1:1]) || regexp_replace(x[2:], '([A-Z])', ' \\1', 'g') END AS label FROM n""",
    "r7_flatten_report": f"""WITH {PLAYER_DAYS} SELECT count(*) AS seen, count(*) FILTER (WHERE duration <= 60) AS filtered, count(*) FILTER (WHERE player_id IS NULL) AS missing_id,
        (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT player_id FROM p WHERE player_id IS NOT NULL)) AS expected_absent FROM p""",
    "j9_days_with_clusters": f"""WITH {PLAYER_DAYS}, t AS (SELECT player_id, sum(duration) AS total FROM p GROUP BY ALL)
        SELECT player_id, day, sessions, CASE WHEN total >= 1500 THEN 'heavy' WHEN total >= 300 THEN 'medium' ELSE 'none' END AS cluster FROM p JOIN t USING (player_id)""",
    "g2_document_reasons": f"SELECT source, {_SHORT} AS reason, count(*) AS n FROM documents GROUP BY ALL",
    "g5_embedding_inputs": f"""SELECT doc_id, sha256('Title: ' || coalesce({_TITLE}, 'n/a') || chr(10) || 'Type: ' || source || chr(10) || 'Category: ' || coalesce(nullif(trim(lang), ''), 'n/a') || chr(10) || 'Players: ' ||
        CASE WHEN doc_id % 4 > 0 THEN array_to_string(list_transform(range(0, least(doc_id % 9, 5) + 1), lambda x: doc_id + x), ', ') ELSE 'n/a' END || chr(10) || 'Text: ' || coalesce(text, '')) AS input_sha256 FROM documents""",
    "g9_filtered_or_relaxed": f"""WITH {_HITS}, k AS (SELECT *, score >= 0.2 AND (team_id IS NULL OR team_id = 1) AND lower(document_type) = 'report' AS keep FROM hits),
        w AS (SELECT *, NOT bool_or(keep) OVER (PARTITION BY query_id) AS relaxed FROM k) SELECT query_id, vec_id, relaxed FROM w WHERE keep OR (relaxed AND score >= 0.05)""",
    "g12_citations": f"""WITH {_HITS}, o AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM o)
        SELECT query_id, string_agg(doc || ' (' || coalesce(nullif(trim(title), ''), document_type) || CASE WHEN page IS NULL THEN '' ELSE ', p.' || page END || ', ' || scope || ')', '; ' ORDER BY r) AS citations FROM t WHERE r <= 4 GROUP BY query_id""",
}
