"""Queries of signal fusion and its calibration, with their SQL; its numbers are those of the rules, not the operators'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice as A
from ..operators import fusion as X
from ..sources.adapters import EVENTS, SIGNALS, _events, signals
from ..sources.shared import written
from .rounding import pick as _pick
from .rounding import rounded as _R

_KNOWN = "k % 11 <> 0"
_FIGURES = ("mae", "band_accuracy", "top1_accuracy", "top3_recall", "objective")
_CONFIG = {
    "baseline_weight": "CASE WHEN k % 5 <> 0 THEN value / 50 - 0.5 END",
    "decision_weight": "CASE WHEN k % 7 <> 0 THEN (k % 13) / 10.0 - 0.2 END",
    "medium": "CASE WHEN k % 3 <> 0 THEN value / 40 END",
    "high": "CASE WHEN k % 4 <> 0 THEN (k % 17) / 12.0 END",
    "critical": "CASE WHEN k % 6 <> 0 THEN (k % 19) / 15.0 END",
}


def _fused(s, d):
    return X.fuse(signals(s, d))


def _truth(s, d):
    """The true severities; some categories have none."""
    return signals(s, d).where(_KNOWN).groupBy("sample_id", "category").agg(F.max("severity").alias("truth"))


def _samples(s, d):
    part = F.expr("(sample_id div 100000 + sample_id) % 20")
    return signals(s, d).select("sample_id").distinct().withColumn("split", F.when(part < 14, "train").when(part < 17, "val").otherwise("test"))


def _tables(s, d):
    return [written(x(s, d), x.__name__.strip("_")) for x in (_fused, _truth, _samples)]


def _configs(s, d):
    return _events(s, d).select("event_id", *[F.expr(x).cast("double").alias(c) for c, x in _CONFIG.items()])


QUERIES = {
    "x4_fusion": lambda s, d: _pick(_fused(s, d), ("sample_id", "category", "n", *[F.array_join(f"evidence_{x}", ",").alias(f"evidence_{x}") for x in ("baseline", "decision")]), "baseline", "decision", "combined", "confidence"),
    "x4_ranked_players": lambda s, d: X.ranked_players(signals(s, d)),
    "x5_configurations": lambda s, d: _pick(X.resolved(_configs(s, d)), ("event_id",), *_CONFIG),
    "x6_insights": lambda s, d: _pick(X.insights(_fused(s, d), signals(s, d)), ("sample_id", "rank", "type", "severity", "message", F.array_join("players", ",").alias("players")), "combined", "confidence"),
    "x6_advice": lambda s, d: A.fused_advice(_fused(s, d), signals(s, d)).select("sample_id", "rank", "category", "recommendation", "drill"),
    "x6_training_focus": lambda s, d: X.training_focus(_fused(s, d)).select("sample_id", "rank", "category", "priority", "objective"),
    "x6_headlines": lambda s, d: X.headline(_fused(s, d)),
    "x7_player_priorities": lambda s, d: _pick(X.player_priorities(signals(s, d)), ("sample_id", "player_id", "n", "categories", "action", "rank"), "priority"),
    "x8_evaluation": lambda s, d: _pick(X.evaluate(*_tables(s, d), X.default_config(s)), ("split", "samples"), *_FIGURES),
    "x9_calibration": lambda s, d: _pick(X.evaluate(*_tables(s, d), X.config_grid(s)).where("split = 'train'"), ("w", "medium", "high", "critical", "samples"), *_FIGURES),
    "x9_calibrated": lambda s, d: _pick(X.calibrated(*_tables(s, d), X.config_grid(s)), ("config", "split", "w", "medium", "high", "critical", "samples"), *_FIGURES),
}

_F = f"""WITH {SIGNALS}, f0 AS (SELECT sample_id, category, coalesce(avg(severity) FILTER (WHERE side = 'baseline'), 0) AS baseline, coalesce(avg(severity) FILTER (WHERE side = 'decision'), 0) AS decision, count(*) AS n,
  coalesce(string_agg(DISTINCT evidence, ',' ORDER BY evidence) FILTER (WHERE side = 'baseline'), '') AS evidence_baseline, coalesce(string_agg(DISTINCT evidence, ',' ORDER BY evidence) FILTER (WHERE side = 'decision'), '') AS evidence_decision FROM s GROUP BY ALL),
f AS (SELECT *, 0.55::DOUBLE * baseline + 0.45::DOUBLE * decision AS combined, least(0.95, n / 6.0::DOUBLE) AS confidence FROM f0),
fr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(combined, 9) DESC, category) AS rank FROM f),
pn AS (SELECT sample_id, category, player_id, count(*) AS n FROM s WHERE side = 'decision' GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY sample_id, category ORDER BY pn.n DESC, player_id) AS rank FROM pn)"""
_BAND = "CASE WHEN {0} >= {1} THEN 'critical' WHEN {0} >= {2} THEN 'high' WHEN {0} >= {3} THEN 'medium' ELSE 'low' END"
_LEVEL = _BAND.format("combined", 0.8, 0.6, 0.4)
_E = f"""{_F}, tr AS (SELECT sample_id, category, max(severity) AS truth FROM s WHERE {_KNOWN} GROUP BY ALL),
sm AS (SELECT DISTINCT sample_id, CASE WHEN (sample_id // 100000 + sample_id) % 20 < 14 THEN 'train' WHEN (sample_id // 100000 + sample_id) % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM s),
cat(category) AS (VALUES ('ball_loss'), ('build_up'), ('duels'), ('final_third'), ('pressing'), ('progression')),
dn AS (SELECT sample_id, split, category, coalesce(baseline, 0) AS baseline, coalesce(decision, 0) AS decision, coalesce(truth, 0) AS truth,
  CASE WHEN truth IS NOT NULL THEN row_number() OVER (PARTITION BY sample_id ORDER BY truth DESC NULLS LAST, category) END AS tr FROM (SELECT * FROM sm, cat) LEFT JOIN f USING (sample_id, category) LEFT JOIN tr USING (sample_id, category)),
grid AS (SELECT row_number() OVER (ORDER BY w, m, h, c) AS number, w * 5 / 100::DOUBLE AS w, m * 5 / 100::DOUBLE AS medium, h * 5 / 100::DOUBLE AS high, c * 5 / 100::DOUBLE AS critical FROM range(6, 16) a(w), range(7, 11) b2(m), range(11, 16) d2(h), range(15, 19) e2(c) WHERE h > m AND c > h),
cf AS (SELECT * FROM grid UNION ALL VALUES (0, 0.55::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE)),
pw AS (SELECT dn.*, w, w * baseline + (1 - w) * decision AS pred FROM dn, (SELECT DISTINCT w FROM cf)),
pk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, w ORDER BY round(pred, 12) DESC, category) AS rk FROM pw),
ps AS (SELECT split, w, sample_id, sum(abs(pred - truth)) AS error, count(*) FILTER (WHERE rk <= 1 AND tr <= 1) AS first, count(*) FILTER (WHERE rk <= 3 AND tr <= 3) AS hit, count(*) FILTER (WHERE tr <= 3) AS three FROM pk GROUP BY ALL),
bw AS (SELECT split, w, count(*) AS samples, sum(error) / (6 * count(*)) AS mae, avg(first) AS top1_accuracy, avg(CASE WHEN three > 0 THEN hit / three ELSE 0 END) AS top3_recall FROM ps GROUP BY ALL),
ba AS (SELECT split, cf.*, avg(({_BAND.format("pred", "critical", "high", "medium")} = {_BAND.format("truth", "critical", "high", "medium")})::INT) AS band_accuracy FROM pk JOIN cf USING (w) GROUP BY ALL),
ev AS (SELECT ba.*, samples, mae, top1_accuracy, top3_recall, mae + 0.25::DOUBLE * (1 - band_accuracy) + 0.2::DOUBLE * (1 - top1_accuracy) + 0.15::DOUBLE * (1 - top3_recall) AS objective FROM ba JOIN bw USING (split, w))"""

SQL = {
    "x4_fusion": f"{_F} SELECT sample_id, category, n, evidence_baseline, evidence_decision, {_R(6, 'baseline', 'decision', 'combined', 'confidence')} FROM f",
    "x4_ranked_players": f"{_F} SELECT * FROM pr WHERE rank <= 3",
    "x5_configurations": f"""WITH {EVENTS}, c AS (SELECT event_id, {", ".join(f"({x})::DOUBLE AS {c}" for c, x in _CONFIG.items())} FROM e),
        d AS (SELECT event_id, coalesce(baseline_weight, 0.55) AS a, coalesce(decision_weight, 0.45) AS b, greatest(0, least(1, coalesce(medium, 0.4))) AS m, least(1, coalesce(high, 0.6)) AS h0, least(1, coalesce(critical, 0.8)) AS c0 FROM c),
        g AS (SELECT *, greatest(m + 0.01::DOUBLE, h0) AS h, greatest(greatest(m + 0.01::DOUBLE, h0) + 0.01::DOUBLE, c0) AS cr FROM d),
        o AS (SELECT event_id, CASE WHEN a + b <= 0 THEN 0.55 ELSE a / (a + b) END AS baseline_weight, CASE WHEN a + b <= 0 THEN 0.45 ELSE b / (a + b) END AS decision_weight,
          CASE WHEN cr > 1 THEN least(m, 0.98) ELSE m END AS medium, CASE WHEN cr > 1 THEN least(h, 0.99) ELSE h END AS high, least(cr, 1) AS critical FROM g) SELECT event_id, {_R(6, *_CONFIG)} FROM o""",
    "x6_insights": f"""{_F}, p4 AS (SELECT sample_id, category, string_agg(player_id, ',' ORDER BY rank) AS players FROM pr WHERE rank <= 4 GROUP BY ALL), z AS (SELECT fr.*, 'risky_' || category AS type, {_LEVEL} AS severity, coalesce(players, '') AS players,
        CASE category WHEN 'build_up' THEN 'Build-up actions are unstable and reduce controlled progression.' WHEN 'ball_loss' THEN 'Ball retention risk is high and creates transition exposure.'
        WHEN 'progression' THEN 'Progression quality is inconsistent and limits vertical threat.' WHEN 'final_third' THEN 'Final-third decisions reduce conversion probability.'
        WHEN 'duels' THEN 'Duel execution is below target in key contests.' ELSE 'Pressing effectiveness is below tactical target.' END AS message FROM fr LEFT JOIN p4 USING (sample_id, category) WHERE fr.rank <= 5)
        SELECT sample_id, rank, type, severity, message, players, {_R(6, 'combined', 'confidence')} FROM z""",
    "x6_advice": f"""{_F}, tx(category, recommendation, drill) AS (VALUES
        ('build_up', 'Train press-resistant passing triangles with one-touch escape patterns.', '6v4 build-up under press with mandatory support angles'),
        ('ball_loss', 'Add constrained rondo and own-half exit drills under directional pressure.', 'Directional rondo with immediate transition punishment'),
        ('progression', 'Run third-man progression patterns with carry-vs-pass decision triggers.', 'Third-man run and carry release circuit'),
        ('final_third', 'Use shot selection circuits with pre-shot scan constraints.', 'Final-third scenario game with shot/pass quality gates'),
        ('duels', 'Increase aerial and shoulder-contact duel repetitions by role group.', 'Aerial timing and body-position duel blocks'),
        ('pressing', 'Drill coordinated counterpressing with first-5-second recovery targets.', 'Counterpressing wave drill with compactness scoring'))
        SELECT sample_id, rank, category, recommendation, drill FROM fr JOIN tx USING (category) WHERE rank <= 5""",
    "x6_training_focus": f"""{_F} SELECT sample_id, rank, category, {_LEVEL} AS priority, CASE category WHEN 'build_up' THEN 'Increase pass security under pressure' WHEN 'ball_loss' THEN 'Reduce dangerous turnovers in own half'
        WHEN 'progression' THEN 'Improve vertical progression timing' WHEN 'final_third' THEN 'Improve chance conversion decisions' WHEN 'duels' THEN 'Improve duel win rate in contested zones' ELSE 'Increase high recoveries after loss' END AS objective FROM fr WHERE rank <= 3""",
    "x6_headlines": f"""{_F} SELECT sample_id, CASE category WHEN 'build_up' THEN 'Build-up instability is the main tactical risk' WHEN 'ball_loss' THEN 'Ball-loss risk is the main tactical concern'
        WHEN 'progression' THEN 'Progression consistency is the main tactical risk' WHEN 'final_third' THEN 'Final-third decision quality is the main tactical risk' WHEN 'duels' THEN 'Duel execution is the main tactical risk'
        ELSE 'Pressing effectiveness is the main tactical risk' END AS headline FROM fr WHERE rank = 1""",
    "x7_player_priorities": f"""WITH {SIGNALS}, g AS (SELECT sample_id, player_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(category) AS c1, least(1, avg(severity) * 0.75::DOUBLE + least(0.25, count(*) * 0.03::DOUBLE)) AS priority FROM s WHERE side = 'decision' GROUP BY ALL)
        SELECT sample_id, player_id, n, categories, CASE c1 WHEN 'build_up' THEN 'Review build-up decisions under pressure.' WHEN 'ball_loss' THEN 'Work on safer retention choices in own-half circulation.'
        WHEN 'progression' THEN 'Improve carry-vs-pass timing for progression phases.' WHEN 'final_third' THEN 'Review final-third pass/shot selection in constrained scenarios.' WHEN 'duels' THEN 'Improve duel timing and body orientation in contested situations.'
        ELSE 'Improve pressing trigger recognition and first reaction speed.' END AS action, rank, round(priority + 3.30e-10, 6) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(priority, 9) DESC, player_id) AS rank FROM g) WHERE rank <= 5""",
    "x8_evaluation": f"{_E} SELECT split, samples, {_R(6, *_FIGURES)} FROM ev WHERE number = 0",
    "x9_calibration": f"{_E} SELECT w, medium, high, critical, samples, {_R(6, *_FIGURES)} FROM ev WHERE split = 'train' AND number > 0",
    "x9_calibrated": f"""{_E}, be AS (SELECT number FROM ev WHERE split = 'train' ORDER BY round(objective + 3.3e-10, 6), number LIMIT 1),
        z AS (SELECT 'best' AS config, * FROM ev WHERE number = (SELECT number FROM be) UNION ALL SELECT 'default', * FROM ev WHERE number = 0) SELECT config, split, w, medium, high, critical, samples, {_R(6, *_FIGURES)} FROM z""",
}
