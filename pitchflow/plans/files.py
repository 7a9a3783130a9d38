"""Queries over files that Spark writes from the given tables and reads back, with their SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fusion as X
from ..sources import match_files as MF
from ..sources import player_files as PF
from ..sources import tables as T
from ..sources.adapters import ACTIONS, PLAYER_DAYS, SIGNALS, actions, player_days, signals
from ..sources.shared import shared_dir, written
from . import fused as fused_plans


def _folder(s):
    return f"{shared_dir(s)}/pitchflow-files-{uuid.uuid4().hex}"


def _match_documents(s, d):
    """A JSON text for each match, in one of four envelopes by its number; some matches come with bad files beside them."""
    a = actions(s, d)
    place = lambda x, y: F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    event = F.struct(
        F.col("event_id").alias("id"), F.col("match_id").alias("matchId"), F.col("period").alias("matchPeriod"), F.floor(F.col("sec") / 60).cast("int").alias("minute"), (F.col("sec") % 60).cast("int").alias("second"),
        F.struct(F.col("event_type").alias("primary")).alias("type"), place("x", "y").alias("location"), F.struct(F.col("team_id").alias("id")).alias("team"),
        F.struct(F.col("player_id").alias("id"), F.when(F.col("player_id") % 3 == 0, F.concat(F.lit("own "), F.col("player_id").cast("string"))).alias("name")).alias("player"),
        F.when(F.col("event_type") == "pass", F.struct(F.col("accurate"), place("end_x", "end_y").alias("endLocation"))).alias("pass"), F.when(F.col("event_type") == "shot", F.struct(F.col("on_target").alias("onTarget"), F.col("is_goal").alias("isGoal"), "xg")).alias("shot"),
        F.when(F.col("event_type") == "carry", F.struct(place("end_x", "end_y").alias("endLocation"))).alias("carry"), F.when(F.col("possession_id").isNotNull(), F.struct(F.col("possession_id").alias("id"), F.struct("flank").alias("attack"))).alias("possession"),
    )
    events = F.transform(F.array_sort(F.collect_list(F.struct("sec", "event_id", event.alias("e")))), lambda x: x["e"]).alias("events")
    players = F.map_from_entries(F.transform(F.array_sort(F.collect_set("player_id")), lambda p: F.struct(p.cast("string").alias("k"), F.struct(F.concat(F.lit("player "), p.cast("string")).alias("name"), F.lit("GK").alias("position")).alias("v")))).alias("players")
    teams = F.map_from_entries(F.transform(F.array_sort(F.collect_set("team_id")), lambda t: F.struct(t.cast("string").alias("k"), F.struct(t.alias("id"), F.concat(F.lit("team "), t.cast("string")).alias("name")).alias("v")))).alias("teams")
    m = a.groupBy("match_id").agg(events, players, teams)
    element = F.struct(F.struct(F.col("match_id").alias("wyId"), F.lit("friendly").alias("label")).alias("match"), "teams", "players", "events")
    kind = (F.col("match_id") + F.expr("match_id div 100000")) % 4
    text = F.when(kind == 0, F.to_json(F.struct(F.array(F.struct(F.array(element).alias("elements"))).alias("matches")))).when(kind == 1, F.to_json(F.struct(F.array(element).alias("elements")))).when(kind == 2, F.to_json(element)).otherwise(F.to_json("events"))
    return m.select("match_id", text.alias("value"))


def _elements(s, d):
    folder = _folder(s)
    docs = _match_documents(s, d)
    bad = docs.where("match_id % 2 = 0").select(F.expr("-match_id - 1").alias("match_id"), F.expr("CASE WHEN (match_id + match_id div 100000) % 4 = 0 THEN '{not json' ELSE '{\"x\": 1}' END").alias("value"))
    rows = docs.unionByName(bad)
    # One file for each match: a match is a document as a whole.
    rows.repartition("match_id").select(F.col("match_id").alias("m"), "value").write.partitionBy("m").option("lineSep", "\n").text(folder)
    return MF.read_elements(s, folder, "*.txt")


def _player_documents(s, d):
    """A JSON text for each day and group of players, named by its two sides; some are broken."""
    p = player_days(s, d).withColumn("match_id", F.expr("day * 1000 + player_id div 30"))
    player = F.struct(
        F.col("player_id").alias("playerId"), F.col("match_id").alias("matchId"), F.when(F.col("player_id") % 5 == 0, F.col("player_id") % 2).alias("teamId"), F.when(F.col("player_id") % 4 != 0, F.col("duration")).alias("minutesOnField"),
        F.struct(F.col("sessions").alias("passes"), F.col("duration").alias("minutesPlayed"), F.when(F.col("player_id") % 7 == 0, F.lit("x")).otherwise(F.col("distance").cast("string")).alias("runs")).alias("total"), F.struct(F.col("per_min").alias("pace")).alias("average"),
    )
    docs = p.groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("player_id", player.alias("p")))), lambda x: x["p"]).alias("players"))
    text = F.when(F.col("match_id") % 17 == 0, "[1]").when(F.col("match_id") % 19 == 0, "{oops").otherwise(F.to_json(F.struct("players")))
    return docs.select("match_id", text.alias("value"))


def _player_files(s, d):
    """The documents as rows of read_files: the same checks, without a file for each."""
    folder = _folder(s)
    _player_documents(s, d).write.partitionBy("match_id").text(folder)
    return PF.read_files(s, folder, ".txt")


def _league_rows(s, d, mode="heuristic"):
    """Player rows with sides by their match and totals of names that nobody has listed; and their teams."""
    rows = PF.player_rows(_player_files(s, d))
    # A match's number is 1000 days and its group; from 30,000 players on groups reach beyond 1000, so the day is not its thousands.
    group, day = F.expr("player_id div 30"), F.expr("(match_id - player_id div 30) div 1000")
    club = lambda n: F.concat(F.lit("club "), n.cast("string"))
    home = F.when(F.col("match_id") % 23 != 0, club(group))
    sides = F.struct(home.alias("home"), F.when(home.isNotNull(), club(group + 1 + day % 3)).alias("away"), F.lit(None).cast("int").alias("home_goals"), F.lit(None).cast("int").alias("away_goals"))
    extra = F.create_map(F.concat(F.lit("extra_"), (F.col("player_id") % 9).cast("string")), F.col("player_id").cast("string"))
    rows = written(rows.withColumns({"context": sides, "total": F.map_concat("total", extra), "file": F.col("match_id").cast("string")}), "league-rows")
    named = s.createDataFrame([("0", "club 0"), ("1", "club 1")], "team_id string, team string").select(F.col("team_id").cast(rows.schema["team_id"].dataType).alias("team_id"), "team")
    return rows, written(PF.assigned_teams(rows, mode, named), "assigned-rows")


def _team_totals(s, d):
    out = PF.team_totals(_league_rows(s, d)[1]).drop("home_goals", "away_goals")
    return out.select(*[F.round(F.col(c) + 3.3e-10, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def _assignment_report(s, d):
    rows, assigned = _league_rows(s, d, "strict")
    return PF.assignment_report(rows, assigned)


def _csv_back(s, d):
    folder = _folder(s)
    rows = player_days(s, d).select("player_id", "day", "role", F.regexp_replace(F.round("distance", 2).cast("decimal(20,2)").cast("string"), "\\.", ",").alias("distance"), F.when(F.col("sessions") > 1, "yes").otherwise("no").alias("busy"), "session_names")
    T.write_csv(rows, folder, ("day", "player_id"))
    return T.read_csv(s, folder, numbers=("player_id", "day", "distance"), booleans=("busy",))


def _labels_back(s, d):
    folder = _folder(s)
    truth = fused_plans._truth(s, d).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "truth"))).alias("true_severity"))
    T.write_json(truth.select(F.col("sample_id").cast("string").alias("sample_id"), "true_severity"), f"{folder}/labels")
    split = F.when(F.col("split") == "val", "VAL").when(F.col("split") == "test", "other").otherwise(F.col("split"))
    T.write_csv(fused_plans._samples(s, d).where("sample_id % 7 <> 0").select("sample_id", split.alias("split")), f"{folder}/manifest")
    return T.labelled_samples(s, f"{folder}/labels", f"{folder}/manifest").select(F.col("sample_id").cast("bigint").alias("sample_id"), "split", "category", F.round(F.col("truth") + 3.3e-10, 6).alias("truth"))


def _topic_back(s, d):
    folder = _folder(s)
    T.write_topic(X.fuse(signals(s, d)).select("sample_id", "category", "n"), "sample_id", folder)
    back = s.read.schema("key string, value string").json(folder)
    return back.select("key", F.from_json("value", "sample_id bigint, category string, n bigint").alias("v")).select("key", "v.*")


def _paths(s, d):
    docs = _match_documents(s, d)
    got = MF.get_path(F.col("value"), "elements.0.match.wyId", "bigint", -1)
    return docs.select("match_id", got.alias("found"), MF.get_path(F.col("value"), "match.label").alias("label"))


def _picked(s, d):
    e = written(_elements(s, d), "elements")  # three steps read them, and they are parsed once
    asked = e.where("reason is null").select("file", MF.match_id_of(F.col("element")).alias("match_id")).where("match_id % 3 <> 0").select("file", F.when(F.col("match_id") % 3 == 1, F.col("match_id")).otherwise(F.lit(-5)).alias("match_id"))
    return MF.pick_match(e, asked).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_ACTION = ("event_id", "match_id", "period", "minute", "second", "team_id", "team_name", "player_id", "player_name", "position", "event_type", "x", "y", "pass_end_x", "carry_end_x", "shot_xg", "shot_is_goal", "possession_id", "possession_flank")

QUERIES = {
    "s5_events_in_order": lambda s, d: MF.events_of(_elements(s, d)).select("match_id", "pos", F.col("event.id").alias("event_id")),
    "s6_envelopes": lambda s, d: _elements(s, d).groupBy(F.coalesce("reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("element.events"), F.lit(0))).alias("events")),
    "s7_picked_matches": _picked,
    "r5_flat_actions": lambda s, d: MF.actions_of(_elements(s, d)).select(*_ACTION),
    "r6_metadata": lambda s, d: MF.metadata_of(_elements(s, d)).where("match_id is not null").select("match_id", "label", F.array_join(F.transform("teams", lambda t: t["name"]), ",").alias("teams")),
    "f17_paths": _paths,
    "s2_player_file_reasons": lambda s, d: PF.report(_player_files(s, d)),
    "s4_player_file_totals": lambda s, d: PF.totals(_player_files(s, d)),
    "r3_player_minutes": lambda s, d: PF.player_rows(_player_files(s, d)).select("match_id", "player_id", F.round(F.col("minutes") + 3.3e-10, 6).alias("minutes")),
    "b1_team_totals": _team_totals,
    "b3_assignment_report": _assignment_report,
    "r4_long_metrics": lambda s, d: PF.long_metrics(PF.player_rows(_player_files(s, d))).select("match_id", "player_id", F.col("group").alias("kind"), "metric", F.round(F.col("value") + 3.3e-10, 6).alias("value")),
    "r4_wide_metrics": lambda s, d: PF.wide_metrics(PF.player_rows(_player_files(s, d)), {"total": ("passes", "runs"), "average": ("pace", "none")}).select("match_id", "player_id", "total_passes", F.round(F.col("total_runs") + 3.3e-10, 6).alias("total_runs"), F.round(F.col("average_pace") + 3.3e-10, 6).alias("average_pace"), "average_none"),
    "s8_csv": lambda s, d: _csv_back(s, d).select("player_id", "day", "role", "distance", "busy", "session_names"),
    "s8_column_kinds": lambda s, d: T.column_kinds(player_days(s, d).select(*[F.col(c).cast("string").alias(c) for c in ("player_id", "role", "duration", "per_min")])),
    "s10_labels": _labels_back,
    "s12_topic_rows": _topic_back,
}

_A = f"WITH {ACTIONS}"
_KIND = "(match_id + match_id // 100000) % 4"
_PL = """, pl AS (SELECT *, day * 1000 + player_id // 30 AS match_id FROM p), ok AS (SELECT * FROM pl WHERE match_id % 17 <> 0 AND match_id % 19 <> 0),
  mi AS (SELECT *, duration AS minutes FROM ok), rw AS (SELECT * FROM mi WHERE minutes > 0)"""

_TEAMS = """WITH {p}{pl}, cx AS (SELECT *, CASE WHEN match_id % 23 <> 0 THEN 'club ' || (player_id // 30) END AS home,
    CASE WHEN match_id % 23 <> 0 THEN 'club ' || (player_id // 30 + 1 + day % 3) END AS away FROM rw),
ex AS (SELECT *, CASE WHEN player_id % 5 = 0 AND 'club ' || (player_id % 2) IN (home, away) THEN 'club ' || (player_id % 2) END AS named FROM cx),
fl AS (SELECT player_id, count(DISTINCT match_id) AS files FROM cx GROUP BY player_id),
sh AS (SELECT player_id, team, count(DISTINCT match_id) AS n FROM (SELECT player_id, match_id, unnest([home, away]) AS team FROM cx) WHERE team IS NOT NULL GROUP BY ALL),
bf AS (SELECT player_id, min(team) AS team FROM sh JOIN fl USING (player_id) WHERE n = files GROUP BY player_id HAVING count(*) = 1),
rs AS (SELECT ex.*, coalesce(named, CASE WHEN bf.team IN (home, away) THEN bf.team END) AS resolved FROM ex LEFT JOIN bf USING (player_id)),
kk AS (SELECT *, count(*) FILTER (WHERE resolved = home) OVER m AS h, count(*) FILTER (WHERE resolved = away) OVER m AS a,
    sum((resolved IS NULL)::INT) OVER (PARTITION BY match_id ORDER BY player_id) AS k FROM rs WINDOW m AS (PARTITION BY match_id)),
tm AS (SELECT *, coalesce(resolved, CASE WHEN CASE WHEN k <= abs(a - h) THEN h <= a ELSE (k - abs(a - h)) % 2 = 1 END THEN home ELSE away END) AS team,
    CASE WHEN named IS NOT NULL THEN 'explicit' WHEN resolved IS NOT NULL THEN 'intersection' ELSE 'fallback' END AS method FROM kk)"""

SQL = {
    "b1_team_totals": _TEAMS + """, ids AS (SELECT team, row_number() OVER (ORDER BY lower(team), team) AS team_id FROM (SELECT DISTINCT unnest([home, away]) AS team FROM tm) WHERE team IS NOT NULL)
        SELECT match_id, team_id, team, min(home) AS home, min(away) AS away, count(*) AS players, round(sum(minutes) + 3.3e-10, 6) AS minutes,
        count(*) FILTER (WHERE method = 'explicit') AS explicit, count(*) FILTER (WHERE method = 'intersection') AS intersection, count(*) FILTER (WHERE method = 'fallback') AS fallback,
        round(sum(sessions)::DOUBLE + 3.3e-10, 6) AS "total_passes", round(sum(duration) + 3.3e-10, 6) AS "total_minutesPlayed", round(coalesce(sum(distance) FILTER (WHERE player_id % 7 <> 0), 0) + 3.3e-10, 6) AS "total_runs", """
        + ", ".join(f'round(coalesce(sum(player_id) FILTER (WHERE player_id % 9 = {k}), 0)::DOUBLE + 3.3e-10, 6) AS "total_extra_{k}"' for k in range(9))
        + " FROM tm JOIN ids USING (team) WHERE home IS NOT NULL GROUP BY match_id, team_id, team",
    "b3_assignment_report": _TEAMS + """, w AS (SELECT count(*) AS rows, count(*) FILTER (WHERE home IS NULL) AS without_sides FROM tm), g AS (SELECT * FROM tm WHERE home IS NOT NULL AND method <> 'fallback'),
        c AS (SELECT count(*) FILTER (WHERE method = 'explicit') AS explicit, count(*) FILTER (WHERE method = 'intersection') AS intersection, 0::BIGINT AS fallback, count(*) AS n FROM g),
        t AS (SELECT count(*) FILTER (WHERE n = 2) AS two_teams, count(*) FILTER (WHERE n <> 2) AS other_matches FROM (SELECT match_id, count(DISTINCT team) AS n FROM g GROUP BY match_id))
        SELECT rows, without_sides, explicit, intersection, fallback, two_teams, other_matches, rows - without_sides - n AS dropped FROM w, c, t""",
    "s5_events_in_order": f"{_A} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY sec, event_id) - 1 AS pos, event_id FROM a",
    "s6_envelopes": f"""{_A}, m AS (SELECT match_id, count(*) AS n FROM a GROUP BY ALL) SELECT 'loaded' AS reason, count(*) AS n, sum(n)::BIGINT AS events FROM m UNION ALL SELECT 'json_parse_error', count(*), 0 FROM m WHERE match_id % 2 = 0 AND {_KIND} = 0
        UNION ALL SELECT 'no_match_structure', count(*), 0 FROM m WHERE match_id % 2 = 0 AND {_KIND} <> 0""",
    "s7_picked_matches": f"{_A}, m AS (SELECT DISTINCT match_id FROM a) SELECT CASE WHEN match_id % 3 = 2 THEN 'not_found' ELSE 'found' END AS outcome, count(*) AS n FROM m GROUP BY ALL",
    "r5_flat_actions": f"""{_A} SELECT event_id, match_id, period, sec // 60 AS minute, sec % 60 AS second, team_id::VARCHAR AS team_id, CASE WHEN {_KIND} = 3 THEN 'Unknown Team' ELSE 'team ' || team_id END AS team_name, player_id::VARCHAR AS player_id,
        CASE WHEN player_id % 3 = 0 THEN 'own ' || player_id WHEN {_KIND} = 3 THEN 'Unknown Player' ELSE 'player ' || player_id END AS player_name, CASE WHEN {_KIND} = 3 THEN 'UNK' ELSE 'GK' END AS position, event_type, x, y,
        CASE WHEN event_type = 'pass' THEN end_x END AS pass_end_x, CASE WHEN event_type = 'carry' THEN end_x END AS carry_end_x, CASE WHEN event_type = 'shot' THEN xg END AS shot_xg, CASE WHEN event_type = 'shot' THEN is_goal END AS shot_is_goal,
        possession_id, CASE WHEN possession_id IS NOT NULL THEN flank END AS possession_flank FROM a WHERE event_type IN ('pass', 'shot', 'carry')""",
    "r6_metadata": f"{_A} SELECT match_id, 'friendly' AS label, string_agg(DISTINCT 'team ' || team_id, ',' ORDER BY 'team ' || team_id) AS teams FROM a WHERE {_KIND} <> 3 AND match_id <> 0 GROUP BY match_id",
    "f17_paths": f"{_A} SELECT DISTINCT match_id, CASE WHEN {_KIND} = 1 THEN match_id ELSE -1 END AS found, CASE WHEN {_KIND} = 2 THEN 'friendly' END AS label FROM a",
    "s8_csv": "WITH {p} SELECT player_id::DOUBLE AS player_id, day::DOUBLE AS day, role, round(distance, 2) AS distance, sessions > 1 AS busy, nullif(session_names, '') AS session_names FROM p",
    "s8_column_kinds": "SELECT * FROM (VALUES ('player_id', 'integer'), ('role', 'text'), ('duration', 'integer'), ('per_min', 'number')) x(\"column\", kind)",
    "s2_player_file_reasons": "WITH {p}{pl}, m AS (SELECT DISTINCT match_id FROM pl) SELECT CASE WHEN match_id % 17 = 0 THEN 'top_level_not_object' WHEN match_id % 19 = 0 THEN 'json_parse_error' ELSE 'loaded' END AS reason, count(*) AS files FROM m GROUP BY ALL",
    "s4_player_file_totals": """WITH {p}{pl}, m AS (SELECT DISTINCT match_id FROM pl) SELECT count(*) AS files, count(*) FILTER (WHERE match_id % 17 <> 0 AND match_id % 19 <> 0) AS valid, count(*) FILTER (WHERE match_id % 17 = 0 OR match_id % 19 = 0) AS invalid,
        count(*) FILTER (WHERE match_id % 17 <> 0 AND match_id % 19 = 0) AS read_errors, count(*) FILTER (WHERE match_id % 17 = 0) AS schema_errors, count(*) FILTER (WHERE match_id % 17 <> 0 AND match_id % 19 <> 0) AS matches FROM m""",
    "r3_player_minutes": "WITH {p}{pl} SELECT match_id, player_id, round(minutes + 3.3e-10, 6) AS minutes FROM rw",
    "r4_long_metrics": """WITH {p}{pl} SELECT match_id, player_id, 'total' AS kind, 'passes' AS metric, round(sessions::DOUBLE + 3.3e-10, 6) AS value FROM rw UNION ALL SELECT match_id, player_id, 'total', 'minutesPlayed', round(duration + 3.3e-10, 6) FROM rw
        UNION ALL SELECT match_id, player_id, 'total', 'runs', round(distance + 3.3e-10, 6) FROM rw WHERE player_id % 7 <> 0 UNION ALL SELECT match_id, player_id, 'average', 'pace', round(per_min + 3.3e-10, 6) FROM rw""",
    "r4_wide_metrics": "WITH {p}{pl} SELECT match_id, player_id, sessions::DOUBLE AS total_passes, CASE WHEN player_id % 7 <> 0 THEN round(distance + 3.3e-10, 6) END AS total_runs, round(per_min + 3.3e-10, 6) AS average_pace, NULL::DOUBLE AS average_none FROM rw",
    "s10_labels": f"""WITH {SIGNALS}, tr AS (SELECT sample_id, category, max(severity) AS truth FROM s WHERE k % 11 <> 0 GROUP BY ALL) SELECT sample_id, CASE WHEN (sample_id // 100000 + sample_id) % 20 < 14 THEN 'train' WHEN (sample_id // 100000 + sample_id) % 20 < 17 THEN 'val' ELSE 'train' END AS split,
        category, round(truth + 3.3e-10, 6) AS truth FROM tr WHERE sample_id % 7 <> 0""",
    "s12_topic_rows": f"WITH {SIGNALS} SELECT sample_id::VARCHAR AS key, sample_id, category, count(*) AS n FROM s GROUP BY ALL",
}

SQL = {name: q.replace("{p}", PLAYER_DAYS).replace("{pl}", _PL) for name, q in SQL.items()}
