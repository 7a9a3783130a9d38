"""Player statistics files: one JSON object a file, checked, reported and flattened to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import to_number
from .shared import written

POSITION = "STRUCT<position: STRUCT<code: STRING, name: STRING>, percent: DOUBLE>"
PLAYER = f"playerId BIGINT, matchId STRING, competitionId BIGINT, seasonId BIGINT, roundId BIGINT, teamId BIGINT, minutesOnField DOUBLE, positions ARRAY<{POSITION}>, total MAP<STRING, STRING>, average MAP<STRING, STRING>, percent MAP<STRING, STRING>"
NAME = r"^(.+?) - (.+?), (\d+)-(\d+)(?:_(\d+))?_players_stats\.json$"
GROUPS = ("total", "average", "percent")


def read_files(spark: SparkSession, path: str, suffix: str = "_players_stats.json") -> DataFrame:
    """file, reason, players: every file with why it is refused, or null, by its lower-cased name. Nothing raises for a bad file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").format("binaryFile").load(path)
    name = F.url_decode(F.element_at(F.split(F.col("path"), "/"), -1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    raw = raw.select(name.alias("file"), F.regexp_replace(text, "^\ufeff", "").alias("value"))
    raw = raw.select("file", "value", F.try_parse_json("value").alias("v"), F.from_json("value", f"struct<players: array<struct<{PLAYER}>>>").alias("doc"))
    kind = F.schema_of_variant("v")
    ids = F.array_distinct(F.transform("doc.players", lambda p: p["matchId"].try_cast("bigint")))
    reason = (
        F.when(F.col("value").isNull(), "file_read_error")
        .when(F.col("v").isNull(), "json_parse_error")
        .when(~kind.startswith("OBJECT"), "top_level_not_object")
        .when(F.col("doc.players").isNull(), "players_missing")
        .when(F.size("doc.players") == 0, "players_empty")
        .when(F.exists("doc.players", lambda p: p.isNull()), "player_not_object")
        .when(F.exists("doc.players", lambda p: p["matchId"].try_cast("bigint").isNull()), "match_id_not_integer")
        .when(F.size(ids) > 1, "several_match_ids")
    )
    return raw.select("file", reason.alias("reason"), F.col("doc.players").alias("players"))


def in_order(files: DataFrame) -> DataFrame:
    """Files by name, whatever its case; equal ones by case."""
    return files.orderBy(F.lower("file"), "file")


def report(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def totals(files: DataFrame) -> DataFrame:
    """One row: files, good and bad ones, those that could not be read, those of another form, and distinct matches."""
    unread = F.col("reason").isin("file_read_error", "json_parse_error")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count("reason").alias("invalid"), F.count_if(unread).alias("read_errors"),
        F.count_if(F.col("reason").isNotNull() & ~unread).alias("schema_errors"), F.countDistinct(F.when(F.col("reason").isNull(), F.get("players", F.lit(0))["matchId"])).alias("matches"),
    )


def first_errors(files: DataFrame, n: int = 10) -> DataFrame:
    """file and reason of the first n refused files by name."""
    return in_order(files.where("reason is not null").select("file", "reason")).limit(n)


def match_context(file):
    """Home, away and score from a file's name; null where it does not follow the form."""
    part = lambda k: F.nullif(F.regexp_extract(file, NAME, k), F.lit(""))
    return F.struct(part(1).alias("home"), part(2).alias("away"), part(3).try_cast("int").alias("home_goals"), part(4).try_cast("int").alias("away_goals"))


def player_rows(files: DataFrame) -> DataFrame:
    """One row for each player of a good file who has minutes, or none noted. Minutes are the first number among five
    fields; the main position is the first of most percent."""
    good = files.where("reason is null").select("file", F.posexplode("players").alias("pos", "p"))
    found = F.aggregate(
        F.coalesce("p.positions", F.array().cast("array<struct<position:struct<code:string,name:string>,percent:double>>")),
        F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("percent")),
        lambda a, x: F.when(x["percent"].isNotNull() & (a["percent"].isNull() | (x["percent"] > a["percent"])), F.struct(x["position"]["code"].alias("code"), x["position"]["name"].alias("name"), x["percent"].alias("percent"))).otherwise(a),
    )
    joined = lambda c: F.array_join(F.filter(F.transform("p.positions", lambda x: x["position"][c]), lambda x: x != ""), "|")
    number = lambda group, key: to_number(F.element_at(F.col(f"p.{group}"), key))
    minutes = F.coalesce("p.minutesOnField", number("total", "minutesOnField"), number("average", "minutesOnField"), number("total", "minutesPlayed"), number("average", "minutesPlayed"))
    rows = good.select(
        "file", "pos", F.col("p.playerId").alias("player_id"), F.col("p.matchId").try_cast("bigint").alias("match_id"), F.col("p.teamId").alias("team_id"), *[F.col(f"p.{c}Id").alias(f"{c}_id") for c in ("competition", "season", "round")],
        minutes.alias("minutes"), F.coalesce(F.size("p.positions"), F.lit(0)).alias("position_count"), joined("code").alias("positions"), joined("name").alias("position_names"),
        found["code"].alias("main_position"), found["name"].alias("main_position_name"), found["percent"].alias("main_percent"), match_context(F.col("file")).alias("context"), *[F.col(f"p.{g}").alias(g) for g in GROUPS],
    )
    return rows.where("minutes is null or minutes > 0")


def metrics(rows: DataFrame) -> DataFrame:
    """Long metrics of the totals: file, player_id, metric, value; values that are no numbers are left out."""
    return long_metrics(rows).where("group = 'total'").drop("group")


def long_metrics(rows: DataFrame) -> DataFrame:
    """file, pos, player_id, match_id, group, metric, value for every number of the three metric maps."""
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.coalesce(F.col(g), F.create_map().cast("map<string,string>")).alias("m")) for g in GROUPS])).alias("g")
    long = rows.select("file", "pos", "player_id", "match_id", each).select("file", "pos", "player_id", "match_id", "g.group", F.explode("g.m").alias("metric", "text"))
    return long.withColumn("value", to_number(F.col("text"))).where("value is not null").drop("text")


def wide_metrics(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """The metrics that are asked for, by group, as columns <group>_<metric> beside each row."""
    value = lambda g, m: to_number(F.element_at(F.col(g), m))
    return rows.withColumns({f"{g}_{m}": value(g, m) for g, metrics_ in names.items() for m in metrics_}).drop(*GROUPS)


def assigned_teams(rows: DataFrame, mode: str = "heuristic", explicit: DataFrame | None = None) -> DataFrame:
    """Each player row with its team and the method: explicit (team_id -> team, where it is one of the match), the one name that all files of the
    player share, else, in mode 'heuristic', dealt to the smaller side; in mode 'strict' such rows are dropped.

    Unresolved rows go in the order of their place in the file; with h and a rows on the sides before, the first
    |a - h| go to the smaller side, then they alternate, home first.
    """
    pairs = rows.select("file", "player_id", F.explode(F.array("context.home", "context.away")).alias("team")).distinct()
    files = rows.groupBy("player_id").agg(F.countDistinct("file").alias("files"))
    shared = pairs.groupBy("player_id", "team").agg(F.countDistinct("file").alias("n")).join(files, "player_id").where("n = files")
    one = shared.groupBy("player_id").agg(F.min("team").alias("__by_files"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    r = rows.join(one, "player_id", "left")
    if explicit is not None:
        r = r.join(explicit.select("team_id", F.col("team").alias("__named")), "team_id", "left")
    else:
        r = r.withColumn("__named", F.lit(None).cast("string"))
    of_match = lambda c: F.when(F.col(c).isin(F.col("context.home"), F.col("context.away")), F.col(c))
    r = r.withColumns({"__named": of_match("__named"), "__by_files": of_match("__by_files")}).withColumn("resolved", F.coalesce("__named", "__by_files"))
    sides = r.groupBy("file").agg(F.count_if(F.col("resolved") == F.col("context.home")).alias("h"), F.count_if(F.col("resolved") == F.col("context.away")).alias("a"))
    k = F.sum(F.col("resolved").isNull().cast("int")).over(Window.partitionBy("file").orderBy("pos"))
    r = r.join(sides, "file").withColumn("k", k)
    gap = F.abs(F.col("a") - F.col("h"))
    home = F.when(F.col("k") <= gap, F.col("h") <= F.col("a")).otherwise((F.col("k") - gap) % 2 == 1)
    team = F.coalesce("resolved", F.when(home, F.col("context.home")).otherwise(F.col("context.away")))
    method = F.when(F.col("__named").isNotNull(), "explicit").when(F.col("resolved").isNotNull(), "intersection").otherwise("fallback")
    out = r.withColumns({"team": team, "method": method}).drop("h", "a", "k", "resolved", "__named", "__by_files")
    return out.where("method <> 'fallback'") if mode == "strict" else out


def team_rows(assigned: DataFrame, metrics_: tuple[str, ...] = ()) -> DataFrame:
    """match_id, team: players, minutes, players by method and the sums of the totals asked for."""
    total = lambda m: F.sum(F.coalesce(to_number(F.element_at(F.col("total"), m)), F.lit(0.0))).alias(m)
    by_method = [F.count_if(F.col("method") == m).alias(m) for m in ("explicit", "intersection", "fallback")]
    return assigned.groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("players"), F.sum("minutes").alias("minutes"), *by_method, *[total(m) for m in metrics_])


#: The most names that team_totals() makes columns of.
MOST_METRICS = 2000


def team_ids(rows: DataFrame) -> DataFrame:
    """team, team_id: all names of home and away sides, numbered from 1 in their order without case. A row for each club."""
    names = rows.select(F.explode(F.array("context.home", "context.away")).alias("team")).where("team is not null").distinct()
    return names.withColumn("team_id", F.row_number().over(Window.orderBy(F.lower("team"), "team")).cast("bigint"))


def team_totals(assigned: DataFrame) -> DataFrame:
    """team_rows() with every total that any player has, as total_<name>: no name need be known before.

    Numbers are summed by match, team and name before they become columns; the names, at most MOST_METRICS, are read
    from those sums. A team without a number for a name has 0. Rows without a match go, as files without sides do.
    """
    known = assigned.where("match_id is not null and context.home is not null and team is not null")
    teams = team_rows(known).withColumnRenamed("team", "__team")
    sides = known.groupBy("match_id", F.col("team").alias("__team")).agg(F.min("context").alias("c"))
    long = known.select("match_id", F.col("team").alias("__team"), F.explode("total").alias("metric", "text")).withColumn("value", to_number(F.col("text")))
    sums = written(long.groupBy("match_id", "__team", "metric").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")), "team-totals")
    names = [r[0] for r in sums.select("metric").distinct().orderBy("metric").limit(MOST_METRICS + 1).collect()]
    if len(names) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} names of totals")
    wide = sums.groupBy("match_id", "__team").pivot("metric", names).agg(F.first("value")).select("match_id", "__team", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"total_{n}") for n in names])
    out = teams.join(sides, ["match_id", "__team"]).join(wide, ["match_id", "__team"], "left").na.fill(0.0, [f"total_{n}" for n in names])
    ids = team_ids(known).withColumnRenamed("team", "__team")
    return out.join(ids, "__team").select(
        "match_id", "team_id", F.col("__team").alias("team"), F.col("c.home").alias("home"), F.col("c.away").alias("away"), F.col("c.home_goals").alias("home_goals"), F.col("c.away_goals").alias("away_goals"),
        *[c for c in teams.columns if c not in ("match_id", "__team")], *[f"total_{n}" for n in names],
    )


def assignment_report(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: player rows, rows without sides in their file's name, rows by method, rows dropped, and matches by their number of teams."""
    counted = assigned.where("context.home is not null").agg(*[F.count_if(F.col("method") == m).alias(m) for m in ("explicit", "intersection", "fallback")], F.count(F.lit(1)).alias("assigned"))
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("context.home").isNull()).alias("without_sides"))
    teams = assigned.where("context.home is not null").groupBy("match_id").agg(F.countDistinct("team").alias("n")).agg(F.count_if(F.col("n") == 2).alias("two_teams"), F.count_if(F.col("n") != 2).alias("other_matches"))
    return whole.join(F.broadcast(counted)).join(F.broadcast(teams)).withColumn("dropped", F.col("rows") - F.col("without_sides") - F.col("assigned")).drop("assigned")
