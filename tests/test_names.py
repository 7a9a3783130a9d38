"""Names nearly alike against all pairs, and the review of names that are misspelt, swapped and abbreviated."""

import random

import pytest

from pitchflow.operators import names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_close_texts_are_those_of_all_pairs(spark):
    rng = random.Random(1)

    def changed(t):
        t = list(t)
        for _ in range(rng.randrange(1, 2 + len(t) // 4)):
            at = rng.randrange(len(t) + 1)
            kind = rng.randrange(3)
            t[at : at + (kind > 0)] = [rng.choice("abc ")] if kind < 2 else []
        return "".join(t)

    texts = {"".join(rng.choice("abc d") for _ in range(rng.choice([1, 2, 3, 4, 6, 8, 9, 10, 11, 14, 20, 30]))).strip() or "a" for _ in range(120)}
    others = {changed(t) for t in texts for _ in range(2)} - {""}
    a, b = (spark.createDataFrame([(t,) for t in sorted(x)], "text string") for x in (texts, others))
    got = {(r.a, r.b): r.score for r in names.close_texts(a, b).collect()}
    want = {(x, y): 1 - distance(x, y) / max(len(x), len(y)) for x in texts for y in others}
    want = {k: v for k, v in want.items() if v >= names.LEAST}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 150
    with pytest.raises(ValueError, match="0.75"):
        names.close_texts(a, b, 0.5)


def test_texts_meet_by_segments_and_their_places_only(spark):
    """Names of a few common runs of letters: nearly all pairs share one, few are close, and few are compared."""
    rng = random.Random(2)
    parts = ["the", "and", "ion", "ent", "ing", "her", "tha", "nth"]
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.choice([5, 6, 7]))) for _ in range(300)})
    a, b = (spark.createDataFrame([(t,) for t in some], "text string") for some in (texts[::2], texts[1::2]))
    met = {(r.a, r.b) for r in names._met(a, b, names.LEAST).collect()}
    close = {(x, y) for x in texts[::2] for y in texts[1::2] if 1 - distance(x, y) / max(len(x), len(y)) >= names.LEAST}
    assert close <= met and {(r.a, r.b) for r in names.close_texts(a, b).collect()} == close
    runs = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    sharing = sum(bool(runs(x) & runs(y)) for x in texts[::2] for y in texts[1::2])
    assert len(met) < sharing / 2


def test_review(spark):
    catalog = [(1, "J. Smith", "John Smith"), (2, "A. Jones", "Anna Jones"), (3, None, "Maria Lopez"), (4, "M. Lopes", "Mario Lopez"), (5, "P. Müller", "Peter Müller")]
    known = spark.createDataFrame([(*r, "x") for r in catalog], "player_id bigint, short_name string, full_name string, norm string")
    seen = ["John Smith", "Jon Smyth", "smith john", "J Smith", "Maria  Lopes", "Petr Muller", "Nobody Atall", "Tom", None, "", "Boss"] + ["Jon Smyth"]
    devices = spark.createDataFrame([(n, 1) for n in seen], "device_name string, rank int")
    got = {r.device_name: r for r in names.name_review(devices, known, {"boss": 2}).collect()}
    assert (got["John Smith"].status, got["John Smith"].player_id, got["John Smith"].full_name) == ("matched", 1, "John Smith")
    assert (got["Boss"].status, got["Boss"].player_id) == ("override", 2)
    assert (got["Jon Smyth"].rows, got["Jon Smyth"].status, got["Jon Smyth"].candidate_ids) == (2, "review", "1")
    assert (got["smith john"].status, got["smith john"].player_id, got["smith john"].scores) == ("fuzzy", 1, [1.0])
    assert got["J Smith"].player_id == 1
    assert got["Petr Muller"].candidate_names == "5:P. Müller|Peter Müller"
    assert got["Maria  Lopes"].candidate_ids.split(",")[0] == "3" and got["Maria  Lopes"].status in ("fuzzy", "review")
    assert (got["Nobody Atall"].status, got["Nobody Atall"].candidate_ids, got["Nobody Atall"].candidate_names) == ("unmatched", "", "")
    assert names.fuzzy_candidates(devices.limit(0).withColumnRenamed("device_name", "name"), known).count() == 0


def test_tables_of_names_are_not_broadcast(spark):
    """Their size in Parquet says little of their size in the driver's memory."""
    catalog = spark.createDataFrame([(1, "J. Smith", "John Smith"), (2, "A. Jones", "Anna Jones")], "player_id bigint, short_name string, full_name string")
    devices = spark.createDataFrame([("Jon Smith",), ("J Smith",), ("Anna Jones",)], "device_name string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    close, review = names.fuzzy_candidates(devices.withColumnRenamed("device_name", "name"), catalog), names.name_review(devices, catalog)
    for df in (close, review):
        assert len(df.collect()) == 3 and "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert plan(names.name_mapping(devices, catalog)).count("SortMergeJoin") == 2
