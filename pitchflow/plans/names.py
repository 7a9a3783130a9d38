"""Queries of names that are nearly alike, over names that the first words of documents stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names as N
from ..sources.adapters import table

#: The first three words of a document as a name, in Spark and in DuckDB alike; every fifth is written otherwise.
_FIRST = r"trim(regexp_replace(regexp_replace(substring(coalesce(text, ''), 1, 60), '[^A-Za-z]+', ' '{g}), '^ *([A-Za-z]+ [A-Za-z]+ ?[A-Za-z]*).*$', '{one}'))"
_WRITTEN = """CASE doc_id % 5 WHEN 0 THEN upper(full_name) WHEN 1 THEN substring(full_name, 1, 4) || 'x' || substring(full_name, 6)
  WHEN 2 THEN regexp_replace(full_name, '^([A-Za-z]+) (.*)$', '{two} {one}') WHEN 3 THEN substring(full_name, 1, 1) || '. ' || regexp_replace(full_name, '^.* ', '') ELSE substring(full_name, 2) || 'q' END"""
_OVERRIDES = {"nobody of that name": 3}


def _catalog(s, d):
    full = F.expr(_FIRST.format(g="", one="$1"))
    return table(s, d, "documents").select(F.col("doc_id").cast("bigint").alias("player_id"), full.alias("full_name")).withColumn("short_name", F.expr("substring(full_name, 1, 3)"))


def _devices(s, d):
    rows = _catalog(s, d).withColumn("doc_id", F.col("player_id"))
    return rows.where("doc_id % 3 <> 2").select(F.expr(_WRITTEN.format(one="$1", two="$2")).alias("device_name"))


def _review(s, d):
    out = N.name_review(_devices(s, d), _catalog(s, d), _OVERRIDES)
    return out.withColumn("scores", F.array_join(F.transform("scores", lambda x: F.round(x * 10000).cast("int").cast("string")), ","))


QUERIES = {
    "j7_fuzzy_candidates": lambda s, d: N.fuzzy_candidates(_devices(s, d).withColumnRenamed("device_name", "name"), _catalog(s, d)).withColumn("score", F.round("score", 9)),
    "j7_name_review": _review,
}

_NAMES = rf"""WITH ct AS (SELECT doc_id, {_FIRST.format(g=", 'g'", one=chr(92) + "1")} AS full_name FROM documents),
cat AS (SELECT doc_id AS player_id, full_name, substring(full_name, 1, 3) AS short_name FROM ct),
dv AS (SELECT {_WRITTEN.format(one=chr(92) + "1", two=chr(92) + "2")} AS device_name FROM ct WHERE doc_id % 3 <> 2),
kn AS (SELECT DISTINCT player_id, lower(n) AS known FROM (SELECT player_id, unnest([full_name, short_name]) AS n FROM cat) WHERE n <> ''),
asked AS (SELECT DISTINCT lower(trim(device_name)) AS norm FROM dv WHERE trim(device_name) <> ''),
pairs AS (SELECT norm, player_id, known, list_aggregate(list_sort(string_split(norm, ' ')), 'string_agg', ' ') AS sn,
                 list_aggregate(list_sort(string_split(known, ' ')), 'string_agg', ' ') AS sk, string_split(known, ' ') AS kw,
                 string_split(replace(norm, '.', ''), ' ') AS nw FROM asked, kn),
forms AS (SELECT norm, player_id, greatest(1 - levenshtein(norm, known) / greatest(length(norm), length(known))::DOUBLE, 1 - levenshtein(sn, sk) / greatest(length(sn), length(sk))::DOUBLE,
                 1 - levenshtein(sn, known) / greatest(length(sn), length(known))::DOUBLE, 1 - levenshtein(norm, sk) / greatest(length(norm), length(sk))::DOUBLE) AS score,
                 CASE WHEN len(kw) > 1 AND len(list_filter(nw, lambda w: length(w) = 1)) > 0 AND list_sort(nw) = list_sort([kw[1][1], kw[-1]]) THEN 0.9 ELSE 0 END AS short FROM pairs),
best AS (SELECT norm, player_id, max(greatest(score, short)) AS score FROM forms WHERE score >= 0.75 OR short > 0 GROUP BY norm, player_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, player_id) AS rank FROM best)"""

SQL = {
    "j7_fuzzy_candidates": f"{_NAMES} SELECT norm, player_id, round(score, 9) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5",
    "j7_name_review": f"""{_NAMES},
names AS (SELECT device_name, lower(trim(device_name)) AS norm, count(*) AS rows FROM dv GROUP BY device_name),
ex AS (SELECT known AS norm, list_sort(list(player_id)) AS ids FROM kn GROUP BY known),
sur AS (SELECT word, list_sort(list(DISTINCT player_id)) AS ids FROM (SELECT player_id, string_split(lower(full_name), ' ')[-1] AS word FROM cat) WHERE word <> '' GROUP BY word),
m AS (SELECT device_name, names.norm, rows, coalesce(ex.ids, sur.ids) AS ids, ex.ids IS NOT NULL AS exact FROM names LEFT JOIN ex ON ex.norm = names.norm LEFT JOIN sur ON sur.word = string_split(names.norm, ' ')[-1]),
cl AS (SELECT norm, list(player_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores FROM ranked WHERE rank <= 5 GROUP BY norm),
o AS (SELECT device_name, m.norm, rows, m.ids AS own, cl.ids AS close, scores, exact, m.ids IS NULL AND cl.ids IS NOT NULL AS fuzzy,
             scores[1] >= 0.9 AND round(scores[1] - coalesce(scores[2], 0), 9) >= 0.05 AS taken FROM m LEFT JOIN cl ON cl.norm = m.norm),
r AS (SELECT device_name, norm, rows, CASE WHEN fuzzy THEN CASE WHEN taken THEN 'fuzzy' ELSE 'review' END WHEN own IS NULL THEN 'unmatched' WHEN len(own) > 1 THEN 'ambiguous' WHEN exact THEN 'matched' ELSE 'surname' END AS status,
             CASE WHEN fuzzy THEN close ELSE coalesce(own, []) END AS ids, CASE WHEN fuzzy AND taken THEN close[1] WHEN NOT fuzzy AND len(own) = 1 THEN own[1] END AS player_id,
             CASE WHEN fuzzy THEN list_transform(scores, lambda x: round(x * 10000)::INT::VARCHAR) ELSE [] END AS scores FROM o),
nm AS (SELECT device_name, string_agg(player_id || ':' || short_name || '|' || full_name, ' || ' ORDER BY place) AS candidate_names
       FROM (SELECT device_name, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM r) JOIN cat ON cat.player_id = id GROUP BY device_name)
SELECT r.device_name, r.norm, r.rows, r.status, array_to_string(ids, ',') AS candidate_ids, coalesce(candidate_names, '') AS candidate_names,
       array_to_string(scores, ',') AS scores, r.player_id, cat.short_name, cat.full_name
FROM r LEFT JOIN nm USING (device_name) LEFT JOIN cat ON cat.player_id = r.player_id""",
}
