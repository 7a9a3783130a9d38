"""Match documents in JSON: four envelopes, events in their order, flat actions and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMED = "struct<id: bigint, name: string, position: string>"
PLACE = "struct<x: double, y: double>"
#: The fields of an event that anything reads; others are never parsed.
EVENT = f"""struct<id: bigint, matchId: bigint, matchPeriod: string, minute: int, second: int,
  type: struct<primary: string, secondary: array<string>>, location: {PLACE}, team: {NAMED}, player: {NAMED},
  pass: struct<accurate: boolean, recipient: {NAMED}, endLocation: {PLACE}, length: double, angle: double>,
  shot: struct<onTarget: boolean, isGoal: boolean, xg: double, bodyPart: string>,
  groundDuel: struct<won: boolean, opponent: {NAMED}>, aerialDuel: struct<won: boolean, opponent: {NAMED}>,
  carry: struct<endLocation: {PLACE}, progression: double>, infraction: struct<type: string, yellowCard: boolean, redCard: boolean>,
  possession: struct<id: bigint, duration: double, types: array<string>, team: {NAMED}, endLocation: {PLACE},
    attack: struct<flank: string, withShot: boolean, withGoal: boolean, xg: double>>>"""
ELEMENT = f"""struct<match: struct<wyId: bigint, id: bigint, label: string, date: string, status: string, venue: string>,
  teams: map<string, struct<id: bigint, name: string, formation: string>>, players: map<string, {NAMED}>, events: array<{EVENT}>>"""
ACTION_TYPES = ("pass", "shot", "carry")


def read_elements(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, reason, position, element: a row for each match in each file, or one with the reason for a file without any.

    Envelopes: {matches: [{elements}]}, {elements}, a single match with its events, a bare list of events or of matches.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return elements_of(raw.select(F.url_decode("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value")))


def elements_of(documents: DataFrame) -> DataFrame:
    """read_elements of rows (file, value)."""
    v = F.try_parse_json("value")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("__v", path, "variant")), F.lit(""))
    d = documents.withColumn("__v", v)
    d = d.withColumns({f"__{k}": kind(f"$.{k}") for k in ("matches", "elements", "match", "events")} | {"__top": F.coalesce(F.schema_of_variant("__v"), F.lit("")), "__first": kind("$[0].type")})
    parsed = lambda schema: F.from_json("value", schema)
    is_list, has = lambda c: F.col(f"__{c}").startswith("ARRAY"), lambda c: F.col(f"__{c}") != ""
    top_list = F.col("__top").startswith("ARRAY")
    nested = F.flatten(F.transform(parsed(f"struct<matches: array<struct<elements: array<{ELEMENT}>>>>")["matches"], lambda m: F.coalesce(m["elements"], F.array().cast(f"array<{ELEMENT}>"))))
    events = parsed(f"array<{EVENT}>")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("match", "struct<wyId: bigint, id: bigint, label: string, date: string, status: string, venue: string>"), ("teams", "map<string, struct<id: bigint, name: string, formation: string>>"), ("players", f"map<string, {NAMED}>"))]
    elements = (
        F.when(F.col("__v").isNull(), None)
        .when(is_list("matches"), nested)
        .when(is_list("elements"), parsed(f"struct<elements: array<{ELEMENT}>>")["elements"])
        .when(~top_list & has("events"), F.array(parsed(ELEMENT)))
        .when(top_list & (F.col("__first") != ""), F.array(F.struct(*none, events.alias("events")).cast(ELEMENT)))
        .when(top_list, F.filter(parsed(f"array<{ELEMENT}>"), lambda e: e["events"].isNotNull()))
    )
    d = d.withColumn("elements", F.filter(elements, lambda e: e.isNotNull()))
    reason = F.when(F.col("__v").isNull(), "json_parse_error").when(F.coalesce(F.size("elements"), F.lit(0)) <= 0, "no_match_structure")
    return d.select("file", reason.alias("reason"), F.posexplode_outer(F.when(reason.isNull(), F.col("elements"))).alias("position", "element"))


def match_id_of(element: Column) -> Column:
    """The match's id, else that of its first event."""
    # An id of 0 counts as none.
    some = lambda x: F.when(x != 0, x)
    return F.coalesce(some(element["match"]["wyId"]), element["match"]["id"], F.get(element["events"], F.lit(0))["matchId"])


def pick_match(elements: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """file, outcome, element: the match that is asked for by (file, match_id), or the only one of a file.

    Outcomes: 'found', 'not_found', and 'ambiguous' where a file has several matches and none is asked for. The first
    of several with one id is taken.
    """
    e = elements.where("reason is null").withColumn("__id", match_id_of(F.col("element")))
    by_file = e.groupBy("file").agg(F.count(F.lit(1)).alias("__n"))
    asked = wanted.select("file", F.col("match_id").alias("__asked")) if wanted is not None else by_file.select("file", F.lit(None).cast("bigint").alias("__asked"))
    files = by_file.join(asked, "file", "left")
    first = lambda rows: F.min_by("element", "position").alias("element")
    found = e.join(files, "file").where(F.coalesce(F.col("__id") == F.col("__asked"), F.col("__asked").isNull() & (F.col("__n") == 1)))
    one = found.groupBy("file").agg(first(found))
    outcome = F.when(F.col("element").isNotNull(), "found").when(F.col("__asked").isNull(), "ambiguous").otherwise("not_found")
    return files.join(one, "file", "left").select("file", outcome.alias("outcome"), "element")


def events_of(elements: DataFrame) -> DataFrame:
    """file, match_id, pos, event: the events in their order in the file."""
    rows = elements.where("reason is null")
    return rows.select("file", match_id_of(F.col("element")).alias("match_id"), F.posexplode("element.events").alias("pos", "event"))


def actions_of(elements: DataFrame, types: tuple[str, ...] = ACTION_TYPES) -> DataFrame:
    """Flat actions: names from the event, else from the match's teams and players, else a default."""
    rows = elements.where("reason is null").select("file", match_id_of(F.col("element")).alias("__match"), "element.teams", "element.players", F.posexplode("element.events").alias("pos", "e")).where(F.col("e.type.primary").isin(*types))
    known = lambda table, key: F.element_at(F.col(table), F.col(key).cast("string"))
    some = lambda c: F.nullif(c, F.lit(""))
    team, player = known("teams", "e.team.id"), known("players", "e.player.id")
    place = {"x": "e.location.x", "y": "e.location.y", "pass_end_x": "e.pass.endLocation.x", "pass_end_y": "e.pass.endLocation.y", "carry_end_x": "e.carry.endLocation.x", "carry_end_y": "e.carry.endLocation.y"}
    plain = {
        "pass_accurate": "e.pass.accurate", "pass_recipient_id": "e.pass.recipient.id", "pass_recipient_name": "e.pass.recipient.name", "pass_length": "e.pass.length", "pass_angle": "e.pass.angle",
        "shot_xg": "e.shot.xg", "shot_on_target": "e.shot.onTarget", "shot_is_goal": "e.shot.isGoal", "possession_id": "e.possession.id", "possession_flank": "e.possession.attack.flank",
        "possession_with_shot": "e.possession.attack.withShot", "possession_with_goal": "e.possession.attack.withGoal",
    }
    minute, second = F.coalesce("e.minute", F.lit(0)), F.coalesce("e.second", F.lit(0))
    return rows.select(
        "file",
        F.coalesce("e.id", (F.col("pos") + 1).cast("bigint")).alias("event_id"),
        F.coalesce("e.matchId", "__match", F.lit(0).cast("bigint")).alias("match_id"),
        F.coalesce(some(F.col("e.matchPeriod")), F.lit("UNK")).alias("period"),
        minute.alias("minute"),
        second.alias("second"),
        (minute * 60 + second).alias("sec"),
        F.coalesce(F.col("e.team.id").cast("string"), F.lit("")).alias("team_id"),
        F.coalesce(some(F.col("e.team.name")), some(team["name"]), F.lit("Unknown Team")).alias("team_name"),
        F.coalesce(F.col("e.player.id").cast("string"), F.lit("")).alias("player_id"),
        F.coalesce(some(F.col("e.player.name")), some(player["name"]), F.lit("Unknown Player")).alias("player_name"),
        F.coalesce(some(F.col("e.player.position")), some(player["position"]), F.lit("UNK")).alias("position"),
        F.col("e.type.primary").alias("event_type"),
        *[F.col(path).alias(name) for name, path in (place | plain).items()],
    )


def metadata_of(elements: DataFrame) -> DataFrame:
    """match_id, label, date, status, venue and the teams of every match as (id, name, formation), by id."""
    m = F.col("element.match")
    teams = F.array_sort(F.transform(F.map_values("element.teams"), lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"), t["formation"].alias("formation"))))
    return elements.where("reason is null").select("file", F.coalesce(F.when(m["wyId"] != 0, m["wyId"]), m["id"]).alias("match_id"), *[m[c].alias(c) for c in ("label", "date", "status", "venue")], F.coalesce(teams, F.array().cast("array<struct<id: bigint, name: string, formation: string>>")).alias("teams"))


def get_path(document: Column, path: str, kind: str = "string", default=None) -> Column:
    """The value under a dotted path of a JSON text ('events.0.id'); the default where any step is missing. Numbers in the
    path are keys of an object or, where there is none of that name, places in a list."""
    steps = path.split(".")
    keys = "$" + "".join(f"['{p}']" for p in steps)
    places = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)
    found = F.coalesce(*[F.try_variant_get(F.try_parse_json(document), p, kind) for p in dict.fromkeys((keys, places))])
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))
