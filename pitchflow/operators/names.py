"""Names that are nearly alike: candidates by a q-gram index, ranked by edit distance, and the table for their review.

Two names are compared as they are and with their words sorted, so that swapped first and last names meet; the score
is 1 - distance / longer length, the better of both. A name of an initial and a last word meets the names it
abbreviates, at the score ABBREVIATED.

Index. Of two texts of a score of `least` the longer one, of n letters, is at most k = (1 - least) n edits away. It is
cut into k + 1 segments, of which one at least stands unchanged in the shorter one, moved by few places (Li, Deng, Wang,
Feng 2011): where segment i is the first one up to which there are no more than i edits, it has none itself, there are i
before it and up to k - i behind it. So texts meet by a segment, its number and the length of the longer one; no text
meets all others.

Nulls, ties and edges: null and empty names have no candidates. Equal scores are ordered by player_id. Names of up to
two letters meet equal ones only. Repeated rows of a catalog count once. Letters are compared after normal_name().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_name
from ..sources.shared import written
from .load import name_mapping

#: The score of a name against one it abbreviates, the least score, and when the best candidate is taken: from ACCEPT on
#: and LEAD before the next one.
ABBREVIATED, LEAST, ACCEPT, LEAD = 0.9, 0.75, 0.9, 0.05
Q = F.col


def _large(rows: DataFrame) -> DataFrame:
    """A side of a join of names, never sent whole to the driver: equal names and segments take little room in Parquet and
    are estimated by it, but were up to 640 MB when broadcast."""
    return rows.hint("merge")


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def _forms(names: DataFrame) -> DataFrame:
    """norm, text: the names as they are and with their words sorted."""
    return names.select("norm", F.explode(F.array_distinct(F.array(Q("norm"), _sorted_words(Q("norm"))))).alias("text"))


def _segments(texts: DataFrame, least: float) -> DataFrame:
    """text, key: the segments of each text as the longer one of a pair."""
    cut = texts.select("text", F.length("text").alias("n")).withColumn("k", _edits(Q("n"), least)).select("*", F.explode(F.sequence(F.lit(0), "k")).alias("i"))
    return cut.select("text", F.xxhash64("n", "i", F.substring("text", _start() + 1, _start(1) - _start())).alias("key"))


def _runs(texts: DataFrame, least: float, more: int) -> DataFrame:
    """text, key: the runs of each text that may be a segment of a text longer by `more` letters at least."""
    most = F.floor(Q("m") / least + 1e-9).cast("int")
    lengths = texts.select("text", F.length("text").alias("m")).where(Q("m") + more <= most).select("*", F.explode(F.sequence(Q("m") + more, most)).alias("n"))
    segments = lengths.withColumn("k", _edits(Q("n"), least)).select("*", F.explode(F.sequence(F.lit(0), "k")).alias("i"))
    left, size = Q("k") - Q("i"), _start(1) - _start()
    lowest = F.greatest(_start() - Q("i"), _start() + Q("m") - Q("n") - left, F.lit(0))
    highest = F.least(_start() + Q("i"), _start() + Q("m") - Q("n") + left, Q("m") - size)
    placed = segments.select("text", "n", "i", size.alias("size"), lowest.alias("lowest"), highest.alias("highest")).where("lowest <= highest")
    run = F.explode(F.array_distinct(F.transform(F.sequence("lowest", "highest"), lambda at: F.substring("text", at + 1, Q("size"))))).alias("run")
    return placed.select("text", "n", "i", run).select("text", F.xxhash64("n", "i", "run").alias("key"))


def _edits(n: Column, least: float) -> Column:
    return F.floor(n * (1 - least) + 1e-9).cast("int")


def _start(more: int = 0) -> Column:
    """Where segment i + more of k + 1 begins in a text of n letters."""
    return F.floor((Q("i") + more) * Q("n") / (Q("k") + 1)).cast("int")


def _met(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: different texts that share a key, once for each key that they share."""
    below = _segments(left, least).withColumnRenamed("text", "a").join(_large(_runs(right, least, 0).withColumnRenamed("text", "b")), "key")
    above = _segments(right, least).withColumnRenamed("text", "b").join(_large(_runs(left, least, 1).withColumnRenamed("text", "a")), "key")
    return below.select("a", "b").unionByName(above.select("a", "b")).where("a <> b")


def close_texts(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b, score: texts of both sides (column `text`) of a score of `least` or more, which is 0.75 at least.

    Below that segments have one or two letters, and nearly all texts meet.
    """
    if least < LEAST:
        raise ValueError(f"the index finds scores of {LEAST} or more")
    a, b = written(left.select("text").distinct(), "texts"), written(right.select("text").distinct(), "texts")
    longer = F.greatest(F.length("a"), F.length("b"))
    scores = _met(a, b, least).withColumn("longer", longer).withColumn("most", _edits(Q("longer"), least)).withColumn("edits", F.expr("levenshtein(a, b, most)"))
    # A key is a hash, so texts that only share it may meet as well.
    close = scores.where("edits >= 0").select("a", "b", (1 - Q("edits") / Q("longer")).alias("score")).where(Q("score") >= least).distinct()
    return close.unionByName(a.join(_large(b), "text").select(Q("text").alias("a"), Q("text").alias("b"), F.lit(1.0).alias("score")))


def _abbreviation(c: Column) -> Column:
    """The initial and the last word, sorted, of a name of several words."""
    words = F.split(c, " ")
    short = F.array(F.substring(F.get(words, F.lit(0)), 1, 1), F.element_at(words, -1))
    return F.when(F.size(words) > 1, F.array_join(F.array_sort(short), " "))


def fuzzy_candidates(names: DataFrame, catalog: DataFrame, least: float = LEAST, top: int = 5) -> DataFrame:
    """norm, player_id, score, rank: for each name (column `name`) the `top` players whose full or short name is closest."""
    asked = names.select(normal_name(Q("name")).alias("norm")).where("norm <> ''").distinct()
    both = F.array_compact(F.array(normal_name(Q("full_name")), normal_name(Q("short_name"))))
    known = written(catalog.select("player_id", F.explode(both).alias("norm")).where("norm <> ''").distinct(), "known-names")
    left, right = _forms(asked), _forms(known.select("norm").distinct())
    close = close_texts(left, right, least)
    by_form = close.join(_large(left.select(Q("text").alias("a"), "norm")), "a").join(_large(right.select(Q("text").alias("b"), Q("norm").alias("known"))), "b")
    # An abbreviation has a word of one letter; a dot behind it does not count.
    plain = _sorted_words(F.regexp_replace("norm", r"\.", ""))
    short = asked.where(F.exists(F.split(F.regexp_replace("norm", r"\.", ""), " "), lambda w: F.length(w) == 1)).select("norm", plain.alias("key"))
    long = known.select(Q("norm").alias("known"), _abbreviation(Q("norm")).alias("key")).where("key is not null").distinct()
    abbreviated = short.join(_large(long), "key").select("norm", "known", F.lit(ABBREVIATED).alias("score"))
    found = by_form.select("norm", "known", "score").unionByName(abbreviated)
    players = found.join(_large(known.select("player_id", Q("norm").alias("known"))), "known").groupBy("norm", "player_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("norm").orderBy(F.desc("score"), "player_id")
    return players.withColumn("rank", F.row_number().over(order)).where(Q("rank") <= top)


def name_review(devices: DataFrame, catalog: DataFrame, overrides: dict[str, int] | None = None, least: float = LEAST, top: int = 5) -> DataFrame:
    """One row for each device name: device_name, norm, rows, status, candidate_ids, candidate_names, scores, player_id, short_name, full_name.

    What name_mapping() decides stands; for the names it leaves unmatched the closest players are listed. The best is
    taken ('fuzzy') if its score is ACCEPT or more and LEAD above the next one; else the name is for 'review'.
    """
    mapped = written(name_mapping(devices, catalog, overrides), "mapped-names").withColumn("norm", normal_name(Q("device_name")))
    close = fuzzy_candidates(mapped.where("status = 'unmatched'").select(Q("device_name").alias("name")), catalog, least, top)
    listed = F.array_sort(F.collect_list(F.struct("rank", "player_id", "score")))
    close = close.groupBy("norm").agg(listed.alias("close"))
    best, second = F.get("close", F.lit(0))["score"], F.coalesce(F.get("close", F.lit(1))["score"], F.lit(0.0))
    # Scores are fractions of small whole numbers; rounding keeps their differences from depending on the last bit.
    taken = (best >= ACCEPT) & (F.round(best - second, 9) >= LEAD)
    out = mapped.join(_large(close), "norm", "left")
    ids = F.when(Q("close").isNull(), Q("candidates")).otherwise(F.transform("close", lambda x: x["player_id"]))
    status = F.when(Q("close").isNull(), Q("status")).when(taken, "fuzzy").otherwise("review")
    out = out.select("device_name", "norm", "rows", status.alias("status"), ids.alias("ids"), F.when(Q("close").isNull(), Q("player_id")).when(taken, F.get("close", F.lit(0))["player_id"]).alias("player_id"), F.transform("close", lambda x: x["score"]).alias("scores"))
    known = catalog.select("player_id", "short_name", "full_name").dropDuplicates(["player_id"])
    name = F.concat(Q("player_id").cast("string"), F.lit(":"), F.coalesce("short_name", F.lit("")), F.lit("|"), F.coalesce("full_name", F.lit("")))
    named = out.select("device_name", F.posexplode("ids").alias("at", "player_id")).join(_large(known.select("player_id", name.alias("name"))), "player_id")
    named = named.groupBy("device_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " || ").alias("candidate_names"))
    joined = out.join(_large(named), "device_name", "left").join(_large(known), "player_id", "left")
    text = lambda c: F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit(""))
    return joined.select(
        "device_name", "norm", "rows", "status", text(Q("ids")).alias("candidate_ids"), F.coalesce("candidate_names", F.lit("")).alias("candidate_names"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"), "player_id", "short_name", "full_name",
    )
