"""Queries for reports over matches, decisions, load and scalar rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import chains as C
from ..operators import decision as D
from ..operators import insights as I
from ..operators import load as L
from ..sources.adapters import ACTIONS, EVENTS, PLAYER_DAYS, actions, player_days, table
from . import load as load_plans
from . import teams as team_plans
from .rounding import pick as _pick
from .rounding import rounded as _R


_chosen = team_plans._chosen


def _types():
    return F.array_compact(F.array("set_piece", F.when(F.col("with_goal"), "goal_attack"), F.when(F.col("attack_xg") > 0.05, "clear_chance")))


def _substitutions(s, d):
    return actions(s, d).where("event_type = 'aerial_duel' and tag_loss").select("match_id", "team_id", "sec")


def _names(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("player_id"), F.col("c_name").alias("name"))


def _totals(s, d):
    a = actions(s, d).where("event_type = 'shot'")
    return a.groupBy("player_id").agg(F.count(F.lit(1)).alias("shots"), I.count_if(F.col("is_goal")).alias("goals"))


def _trial_players(s, d):
    return player_days(s, d).where("role = 'r0'").select("player_id").distinct()


def _sources(s, d):
    return table(s, d, "documents").where("source is not null").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

QUERIES = {
    "a11_attack_types": lambda s, d: I.attack_types(actions(s, d), _types()),
    "a13_nodes_before_substitution": lambda s, d: _pick(I.pass_nodes(I.until_first_substitution(actions(s, d), _substitutions(s, d))), (*I.KEYS, "player_id", "touches"), "mean_x", "mean_y"),
    "j15_named_edges": lambda s, d: I.named_edges(I.pass_edges(actions(s, d)), _names(s, d)),
    "t4_top_and_bottom": lambda s, d: I.top_and_bottom(I.duelists(actions(s, d)), "won"),
    "c11_sides": lambda s, d: C.sides(actions(s, d)),
    "c12_match_overview": lambda s, d: C.match_overview(actions(s, d)),
    "r8_condensed": lambda s, d: C.condensed(actions(s, d)).select("match_id", "possession_id", F.array_join(F.transform("events", lambda x: F.concat(x["event_type"], F.lit(":"), x["player_id"].cast("string"))), ">").alias("events")),
    "dq8_phases": lambda s, d: _pick(D.phases(_chosen(s, d)), ("match_id", "section", "rank", "event_id"), "value", "gain"),
    "dq9_player_sections": lambda s, d: _pick(D.player_sections(D.player_summary(_chosen(s, d))), ("section", "rank", "player_id"), "score"),
    "dq12_match_summary": lambda s, d: _pick(D.match_summary(_chosen(s, d)), ("match_id", "actions", "players", "low", "with_alternative", "missed_total", "missed_listed"), "value"),
    "dq13_phase_of_player": lambda s, d: _pick(D.phase_of_player(_chosen(s, d)), ("match_id", "player_id", "event_id", "ranked"), "gain"),
    "j14_nodes_of_shooters": lambda s, d: _pick(I.pass_nodes(actions(s, d)).join(actions(s, d).where("event_type = 'shot'").select(*I.KEYS, "player_id"), [*I.KEYS, "player_id"], "left_semi"), (*I.KEYS, "player_id", "touches"), "mean_x"),
    "k15_backtest": lambda s, d: _pick(L.backtest(L.targets(load_plans._form(s, d)), 10), ("player_id", "day"), "err_last", "err_ma14"),
    "k18_latest": lambda s, d: _pick(L.latest(load_plans._form(s, d)), ("player_id", "day", "sessions", "role"), "form"),
    "j8_days_with_totals": lambda s, d: L.with_totals(player_days(s, d).select("player_id", "day", "sessions"), _totals(s, d)),
    "j10_without_excluded": lambda s, d: L.without(player_days(s, d).select("player_id", "day", "sessions"), _trial_players(s, d)),
    "f4_integer_columns": lambda s, d: table(s, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _NUMBERS]).unpivot([], list(_NUMBERS), "column", "value").groupBy("column").agg(scalar.all_integers(F.col("value")).alias("integers")),
    "f18_sentences": lambda s, d: _sources(s, d).select("lang", scalar.to_sentence(F.col("sources"), 3).alias("sentence")),
    "f14_clock": lambda s, d: actions(s, d).select("event_id", scalar.clock(F.col("period"), F.floor(F.col("sec") % 5400 / 60).cast("bigint"), F.col("sec") % 60, 45).alias("clock")),
    "f20_iso_dates": lambda s, d: table(s, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in scalar.iso_parts(F.col("o_orderdate").cast("date")).items()]),
}

_A, _S = f"WITH {ACTIONS}", team_plans._S
_MISSED = """mi AS (SELECT * FROM ch WHERE best_value >= (SELECT quantile_cont(best_value, 0.85) FROM ch) AND gain >= 0.02 AND NOT coalesce(is_goal, false) AND NOT coalesce(on_target, false))"""
_PHASE = "SELECT * FROM (SELECT match_id, '{0}' AS section, row_number() OVER (PARTITION BY match_id ORDER BY round({2}, 9) DESC, event_id) AS rank, event_id, value, gain FROM {1}) WHERE rank <= 5"
_SECTION = "SELECT '{0}' AS section, player_id, score, row_number() OVER (ORDER BY round(score, 9) {2}, player_id) AS rank FROM p WHERE {1}"
_EACH = " UNION ALL ".join(f"SELECT event_id, '{a}' AS act, {k} AS k, p_{a} AS v FROM w" for k, a in enumerate(D.ACTIONS))
_NODES = "n AS (SELECT match_id, team_id, player_id, avg(x) AS mean_x, avg(y) AS mean_y, count(*) AS touches FROM {0} GROUP BY ALL HAVING avg(x) IS NOT NULL)"

SQL = {
    "a11_attack_types": f"""{_A}, q AS (SELECT match_id, team_id, possession_id, arg_min(coalesce(set_piece, ''), (sec, event_id)) AS sp, arg_min(with_shot, (sec, event_id)) AS with_shot, arg_min(with_goal, (sec, event_id)) AS with_goal,
        arg_min(attack_xg, (sec, event_id)) AS ax FROM a WHERE possession_id IS NOT NULL GROUP BY ALL),
        t AS (SELECT *, unnest([nullif(sp, ''), CASE WHEN with_goal THEN 'goal_attack' END, CASE WHEN ax > 0.05 THEN 'clear_chance' END]) AS type FROM q)
        SELECT match_id, team_id, type, count(*) AS attacks, count(*) FILTER (WHERE with_shot) AS shots, count(*) FILTER (WHERE with_goal) AS goals FROM t WHERE type IS NOT NULL GROUP BY ALL""",
    "a13_nodes_before_substitution": f"""{_A}, c AS (SELECT match_id, team_id, min(sec) AS cut FROM a WHERE event_type = 'aerial_duel' AND tag_loss GROUP BY ALL),
        b AS (SELECT a.* FROM a LEFT JOIN c USING (match_id, team_id) WHERE cut IS NULL OR sec < cut), {_NODES.format('b')} SELECT match_id, team_id, player_id, touches, {_R(6, 'mean_x', 'mean_y')} FROM n""",
    "j15_named_edges": f"""{_A}, g AS (SELECT match_id, team_id, player_id AS passer_id, recipient_id, count(*) AS passes FROM a WHERE event_type = 'pass' AND accurate AND recipient_id IS NOT NULL GROUP BY ALL)
        SELECT g.*, p.c_name AS passer_name, r.c_name AS recipient_name FROM g LEFT JOIN customer p ON p.c_custkey = passer_id LEFT JOIN customer r ON r.c_custkey = recipient_id""",
    "t4_top_and_bottom": f"""{_A}, p AS (SELECT match_id, team_id, player_id, count(*) AS duels, count(*) FILTER (WHERE won) AS won FROM a WHERE event_type IN ('ground_duel', 'aerial_duel') GROUP BY ALL)
        SELECT match_id, team_id, player_id, duels, w.won, rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY p.won DESC, player_id) AS rank, row_number() OVER (PARTITION BY match_id, team_id ORDER BY p.won, player_id DESC) AS up FROM p) w WHERE rank <= 3 OR up <= 2""",
    "c11_sides": f"""{_A}, f AS (SELECT match_id, team_id, min((sec, event_id)) AS first FROM a GROUP BY ALL), g AS (SELECT match_id, list(team_id ORDER BY team_id) AS ids, list(team_id ORDER BY first) AS seen FROM f GROUP BY ALL)
        SELECT match_id, ids[1] AS home_id, ids[2] AS away_id, seen[1] AS first_id, seen[2] AS second_id FROM g""",
    "c12_match_overview": f"{_A} SELECT match_id, count(*) AS events, count(DISTINCT team_id) AS teams, max(sec) AS last_sec FROM a GROUP BY ALL",
    "r8_condensed": f"{_A} SELECT match_id, possession_id, string_agg(event_type || ':' || player_id, '>' ORDER BY sec, event_id) AS events FROM a WHERE possession_id IS NOT NULL GROUP BY ALL",
    "dq8_phases": f"""{_S}, {_MISSED}, x AS ({_PHASE.format('best', 'ch', 'value')} UNION ALL {_PHASE.format('improvable', '(SELECT * FROM ch WHERE suggested IS NOT NULL)', 'gain')} UNION ALL {_PHASE.format('missed', 'mi', 'gain')})
        SELECT match_id, section, rank, event_id, {_R(6, 'value', 'gain')} FROM x""",
    "dq9_player_sections": f"""{_S}, pl AS (SELECT player_id, count(*) AS actions, avg(value) AS score FROM ch GROUP BY ALL), p AS (SELECT *, score <= (SELECT quantile_cont(score, 0.25) FROM pl) AND actions >= 3 AS needs_support FROM pl),
        x AS ({_SECTION.format('top', 'true', 'DESC')} UNION ALL {_SECTION.format('under', 'true', 'ASC')} UNION ALL {_SECTION.format('support', 'needs_support', 'ASC')}) SELECT section, rank, player_id, {_R(6, 'score')} FROM x WHERE rank <= 5""",
    "dq12_match_summary": f"""{_S}, {_MISSED}, n AS (SELECT match_id, count(*) AS missed_total FROM mi GROUP BY ALL),
        g AS (SELECT match_id, count(*) AS actions, count(DISTINCT player_id) AS players, avg(value) AS value, count(*) FILTER (WHERE low) AS low, count(suggested) AS with_alternative FROM ch GROUP BY ALL)
        SELECT match_id, actions, players, low, with_alternative, coalesce(missed_total, 0) AS missed_total, least(coalesce(missed_total, 0), 5) AS missed_listed, {_R(6, 'value')} FROM g LEFT JOIN n USING (match_id)""",
    "dq13_phase_of_player": f"""{_S}, w AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY match_id, player_id ORDER BY round(ch.gain, 9) DESC, sec, event_id) = 1),
        u AS (SELECT event_id, string_agg(act, ',' ORDER BY v DESC, k) AS ranked FROM ({_EACH}) GROUP BY event_id) SELECT match_id, player_id, event_id, ranked, {_R(6, 'gain')} FROM w JOIN u USING (event_id)""",
    "j14_nodes_of_shooters": f"{_A}, {_NODES.format('a')} SELECT match_id, team_id, player_id, touches, {_R(6, 'mean_x')} FROM n SEMI JOIN (SELECT * FROM a WHERE event_type = 'shot') z USING (match_id, team_id, player_id)",
    "k15_backtest": f"""{load_plans._D}, t AS (SELECT player_id, day, form, {load_plans._RANGE.format('14 PRECEDING', 'CURRENT ROW')} AS ma14, {load_plans._RANGE.format('1 FOLLOWING', '7 FOLLOWING')} AS next7 FROM f),
        e2 AS (SELECT player_id, day, abs(next7 - form) AS err_last, abs(next7 - ma14) AS err_ma14 FROM t WHERE day >= 10 AND next7 IS NOT NULL) SELECT player_id, day, {_R(6, 'err_last', 'err_ma14')} FROM e2""",
    "k18_latest": f"{load_plans._D} SELECT player_id, day, sessions, role, {_R(6, 'form')} FROM f QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY day DESC) = 1",
    "j8_days_with_totals": f"""{_A}{PLAYER_DAYS[len(EVENTS):]}, t AS (SELECT player_id, count(*) AS shots, count(*) FILTER (WHERE is_goal) AS goals FROM a WHERE event_type = 'shot' GROUP BY ALL)
        SELECT player_id, day, sessions, coalesce(shots, 0) AS shots, coalesce(goals, 0) AS goals FROM p LEFT JOIN t USING (player_id)""",
    "j10_without_excluded": f"WITH {PLAYER_DAYS} SELECT player_id, day, sessions FROM p WHERE role <> 'r0'",
    "f4_integer_columns": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(bool_and({c} = floor({c})), true) AS integers FROM lineitem" for c in _NUMBERS) + ")",
    "f18_sentences": """WITH g AS (SELECT lang, list_sort(list(DISTINCT source))[1:3] AS i FROM documents WHERE source IS NOT NULL GROUP BY lang)
        SELECT lang, CASE len(i) WHEN 0 THEN 'none' WHEN 1 THEN i[1] WHEN 2 THEN i[1] || ' and ' || i[2] ELSE i[1] || ', ' || i[2] || ', and ' || i[3] END AS sentence FROM g""",
    "f14_clock": f"{_A} SELECT event_id, ((sec % 5400) // 60 + CASE WHEN period = '2H' THEN 45 ELSE 0 END) * 60 + sec % 60 AS clock FROM a",
    "f20_iso_dates": "SELECT o_orderkey, isoyear(o_orderdate::DATE) AS iso_year, week(o_orderdate::DATE) AS iso_week, isodow(o_orderdate::DATE) - 1 AS weekday FROM orders",
}
