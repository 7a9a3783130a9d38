"""Match documents in all envelopes with bad ones among them, tables as CSV and JSON, documents, contexts and answers."""

import json

from pyspark.sql import functions as F

from pitchflow.operators import chains, documents
from pitchflow.operators import docs as G
from pitchflow.sources import match_files, player_files, tables
from pitchflow.streaming import live


def event(i, kind="pass", match=7, **more):
    return {"id": i, "matchId": match, "type": {"primary": kind}, "minute": 1, "second": i, "team": {"id": 1}, "player": {"id": 5}, **more}


ELEMENT = {"match": {"wyId": 7, "label": "A - B"}, "teams": {"1": {"id": 1, "name": "Reds", "formation": "4-4-2"}}, "players": {"5": {"name": "Five", "position": "CB"}}, "events": [event(2), event(1, "shot", location={"x": 90.0, "y": 40.0}), event(3, "touch")]}


def elements(spark, **texts):
    rows = [(name, body if isinstance(body, str) else json.dumps(body)) for name, body in texts.items()]
    return match_files.elements_of(spark.createDataFrame(rows, "file string, value string"))


def test_envelopes(spark):
    other = {**ELEMENT, "match": {"id": 8}}
    e = elements(spark, many={"matches": [{"elements": [ELEMENT]}, {"elements": [other]}, {}]}, some={"elements": [other]}, one=ELEMENT, events_only={"events": [event(1, match=9)]}, bare=[event(4, match=10)], listed=[{"x": 1}, other], bad="{oops", none={"x": 1}, empty=[])
    got = [tuple(r) for r in e.select("file", "reason", "position", match_files.match_id_of(F.col("element")).alias("id")).collect()]
    assert len(got) == 10 and ("many", None, 1, 8) in got
    assert {(r[0], r[3]) for r in got if r[3] is not None} == {("many", 7), ("many", 8), ("some", 8), ("one", 7), ("events_only", 9), ("bare", 10), ("listed", 8)}
    assert {(r[0], r[1]) for r in got if r[1]} == {("bad", "json_parse_error"), ("none", "no_match_structure"), ("empty", "no_match_structure")}
    picked = {r.file: r.outcome for r in match_files.pick_match(e).collect()}
    assert picked["many"] == "ambiguous" and picked["some"] == "found"
    asked = spark.createDataFrame([("many", 8), ("some", 99)], "file string, match_id bigint")
    picked = {r.file: (r.outcome, r.id) for r in match_files.pick_match(e, asked).select("file", "outcome", match_files.match_id_of(F.col("element")).alias("id")).collect()}
    assert picked["many"] == ("found", 8) and picked["some"] == ("not_found", None)


def test_flat_actions_and_metadata(spark):
    nameless = {"events": [event(1, team={"id": 3}, player={}), event(2, player={"id": 5, "name": "Own", "position": "ST"})]}
    e = elements(spark, one=ELEMENT, two=nameless)
    assert [r.id for r in match_files.events_of(e.where("file = 'one'")).orderBy("pos").select("event.id").collect()] == [2, 1, 3]
    a = {(r.file, r.event_id): r for r in match_files.actions_of(e).collect()}
    assert sorted(k for f, k in a if f == "one") == [1, 2]  # no touches
    r = a["one", 1]
    assert (r.team_name, r.player_name, r.position, r.x, r.sec, r.period) == ("Reds", "Five", "CB", 90.0, 61, "UNK")
    assert (a["two", 1].team_name, a["two", 1].player_name, a["two", 1].player_id, a["two", 2].player_name) == ("Unknown Team", "Unknown Player", "", "Own")
    m = match_files.metadata_of(e.where("file = 'one'")).first()
    assert (m.match_id, m.label, [tuple(t) for t in m.teams]) == (7, "A - B", [(1, "Reds", "4-4-2")])
    text = spark.createDataFrame([(json.dumps(ELEMENT),), ("no",)], "t string")
    got = text.select(match_files.get_path(F.col("t"), "teams.1.name").alias("a"), match_files.get_path(F.col("t"), "events.0.id", "bigint", -1).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Reds", 2), (None, -1)]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,score,ok,day,note\n1,\"3,5\",Yes,2024-02-03,\" x \"\n2,abc,no,never,\n".encode())
    got = tables.read_csv(spark, f"file://{tmp_path}/a.csv", numbers=("id", "score"), booleans=("ok",), dates=("day",)).collect()
    assert [(r.id, r.score, r.ok, str(r.day), r.note) for r in got] == [(1.0, 3.5, True, "2024-02-03", "x"), (2.0, None, False, "None", None)]
    kinds = spark.createDataFrame([("1", "1.5", "a", None), ("2", "", "3", " ")], "i string, n string, t string, e string")
    assert {r["column"]: r.kind for r in tables.column_kinds(kinds).collect()} == {"i": "integer", "n": "number", "t": "text", "e": "empty"}
    assert tables.ordered(kinds, ("t", "zz")).columns == ["t", "e", "i", "n"]
    tables.write_json(kinds, f"{tmp_path}/j", ("t",))
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    tables.write_topic(kinds.select("i", "t"), "i", f"{tmp_path}/topic")
    assert {json.loads(r.value)["t"] for r in spark.read.json(f"{tmp_path}/topic").collect()} == {"a", "3"}


def test_team_assignment_modes(spark, tmp_path):
    def player(pid, team, minutes, **total):
        return {"playerId": pid, "matchId": 1, "teamId": team, "minutesOnField": minutes, "positions": [{"position": {"code": "cb", "name": "CB"}, "percent": None}, {"position": {"code": "", "name": "LB"}, "percent": 10}], "total": total, "average": {"minutesPlayed": "12,5"}}

    body = {"players": [player(1, 100, 90, passes="3"), player(2, 200, None, passes="4"), player(3, None, 0), player(4, 300, None)]}
    (tmp_path / "Reds - Blues, 2-1_players_stats.json").write_text("﻿" + json.dumps(body))
    (tmp_path / "odd_players_stats.json").write_bytes(b"\xff\xfe{}")
    files = player_files.read_files(spark, f"file://{tmp_path}")
    assert {(r.file, r.reason) for r in files.collect()} == {("Reds - Blues, 2-1_players_stats.json", None), ("odd_players_stats.json", "file_read_error")}
    t = player_files.totals(files).first()
    assert (t.files, t.valid, t.invalid, t.read_errors, t.schema_errors, t.matches) == (2, 1, 1, 1, 0, 1) and player_files.first_errors(files).count() == 1
    rows = player_files.player_rows(files)
    got = {r.player_id: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 4] and got[2].minutes == 12.5 and (got[1].position_count, got[1].positions, got[1].position_names, got[1].main_position_name) == (2, "cb", "CB|LB", "LB")
    wide = {r.player_id: (r.total_passes, r.average_minutesPlayed) for r in player_files.wide_metrics(rows, {"total": ("passes",), "average": ("minutesPlayed",)}).collect()}
    assert wide[1] == (3.0, 12.5) and wide[4] == (None, 12.5)
    named = spark.createDataFrame([(100, "Blues"), (300, "Elsewhere")], "team_id bigint, team string")
    heuristic = {r.player_id: (r.team, r.method) for r in player_files.assigned_teams(rows, explicit=named).collect()}
    assert heuristic == {1: ("Blues", "explicit"), 2: ("Reds", "fallback"), 4: ("Reds", "fallback")}
    strict = player_files.assigned_teams(rows, "strict", named)
    assert [(r.team, r.players, r.explicit, r.fallback, r.passes) for r in player_files.team_rows(strict, ("passes",)).collect()] == [("Blues", 1, 1, 0, 3.0)]


def test_chain_outcomes(spark):
    columns = "match_id bigint, event_id bigint, sec bigint, team_id bigint, player_id bigint, event_type string, x double, end_x double, won boolean, set_piece string, xg double, on_target boolean, is_goal boolean, accurate boolean, tag_loss boolean, tag_duel_lost boolean, tag_offside boolean, possession_id bigint, possession_team_id bigint, possession_duration double, possession_end_x double"
    row = lambda i, p, kind, x, end=None, offside=False, team=1, pteam=None: (1, i, i, team, 10 - i, kind, x, end, None, None, None, None, None, True, False, False, offside, p, pteam, 2.5, 33.0)
    rows = [row(1, 1, "pass", 10.0, 40.0), row(2, 1, "infraction", 70.0), row(3, 2, "infraction", 30.0, team=2), row(4, 3, "pass", 60.0, 80.0, True, team=2, pteam=1), row(5, 3, "pass", None, None, True, team=2, pteam=1)]
    got = {r.chain_id: r for r in chains.chains(spark.createDataFrame(rows, columns)).collect()}
    assert (got["p1"].result, got["p1"].players, got["p1"].duration) == ("foul_won", [9, 8], 2.5)
    assert got["p1"].score == 2 / 8 * 20 + 60 / 80 * 20 + 0.7 * 15 + 8  # a foul from x of 66 on
    assert got["p2"].score == 1 / 8 * 20 + 0 + 0.3 * 15 + 4 and (got["p2"].trigger, got["p2"].zone) == ("recovery", "low")
    assert (got["p3"].result, got["p3"].team_id, got["p3"].end_x) == ("offside", 1, 33.0)


def test_club_documents(spark):
    pages = [(1, "Filozofie identitate si ADN, model de joc, style of play si principles."), (2, "Constructie build up cu superioritate, depth, width si breaking first line."), (3, "Pressing cu agresivitate, timing si trigger in tranzitie dupa ball loss."), (4, "Player profile si rol pe pozitie. Role interpretation pentru midfielder."), (5, "  \n "), (6, None)]
    df = spark.createDataFrame([("Red Foxes", p, t) for p, t in pages], "club string, page bigint, text string")
    got = {r.doc_id: r for r in documents.club_documents(df).collect()}
    assert {r.document_type for r in got.values()} == {"club_philosophy", "game_phase", "tactical_principle", "player_role_profile"}
    assert got["red_foxes_club_philosophy_overview"].pages == [1] and got["red_foxes_game_phase_build_up"].pages == [2] and got["red_foxes_game_phase_final_third"].pages == [1, 2]
    assert got["red_foxes_player_role_profile_1"].category == "player_profile" and "red_foxes_tactical_principle_final_third" not in got
    assert documents.club_documents(df.limit(0)).count() == 0


def test_answers_and_budgets(spark):
    hits = spark.createDataFrame([(1, 1, "A critical\nweakness", "report"), (1, 2, "x" * 130, "page"), (1, 3, "Training focus", "plan"), (2, 1, "", "page")], "query_id bigint, rank int, text string, document_type string")
    got = {r.query_id: r.answer for r in documents.extractive_answer(hits).collect()}
    assert got[1].split("\n")[1:3] == ["- A critical weakness", "- " + "x" * 120 + "..."] and "- Risk named in report." in got[1] and "- Follow the advice in plan." in got[1]
    assert "- No explicit risk." in got[2] and "- Not enough evidence for more." in got[2]
    capped = spark.createDataFrame([("a\n- 1\n - 2\nb\n- 3\n\n",)], "t string").select(documents.capped_bullets(F.col("t"), 1).alias("t")).first().t
    assert capped == "a\n- 1\nb"
    docs = spark.createDataFrame([("a", 3.0, "d1", 50), ("a", 2.0, "d2", 70), ("a", 1.0, "d3", 40), ("b", 1.0, "d4", 500), (None, 1.0, "d5", None)], "k string, s double, d string, n bigint")
    assert {r.k: (r.used, r.docs) for r in G.within_budget(docs, "k", "n", "s", "d", 100).collect()} == {"a": (90, "d1,d3"), "b": (500, "d4"), None: (0, "d5")}
    assert G.within_budget(docs.limit(0), "k", "n", "s", "d", 100).count() == 0
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 9)], "id string, n bigint")
    assert sorted(r.unique_id for r in G.unique_ids(ids, "id", "n").collect()) == ["a", "a_2", "a_3", "b"]
    pages = spark.createDataFrame([(1, "none"), (2, "none"), (3, "none")], "page_id bigint, text string")
    assert sorted((r.topic, r.page_id) for r in G.topic_pages(pages, {"t": ("zz",)}, first=2).collect()) == [("t", 1), ("t", 2)]
    lists = [spark.createDataFrame(rows, "player_id bigint, score double") for rows in ([(1, 0.5), (2, 0.1)], [(1, 0.4), (2, 0.1), (3, None)])]
    assert {r.player_id: r.score for r in documents.lowest_by_player(*lists).collect()} == {1: 0.4, 2: 0.1, 3: None}


def test_snapshot_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps([{"id": 1, "n": 2}]))
    (tmp_path / "in" / "2.json").write_text(json.dumps({"events": [{"id": 1, "n": 2}, {"id": 3, "n": 4}, {"n": 9}]}))
    rows = live.snapshot_rows(live.snapshot_stream(spark, f"file://{tmp_path}/in"), "id: bigint, n: bigint").withColumn("ts", F.current_timestamp())
    q = live.first_copies(rows, "id").writeStream.format("memory").queryName("snap").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("snap").collect()) == [1, 3]


def test_embeddings_by_a_given_encoder(spark):
    import numpy as np
    import pytest

    docs = spark.createDataFrame([(k, "x" * k if k else None) for k in range(10)], "id bigint, text string")
    got = {r.id: r.embedding for r in G.embedded(docs, lambda texts: np.array([[len(t), 3.0] for t in texts]), 2, batch=3).collect()}
    assert all(abs(got[k][0] - k / (k * k + 9) ** 0.5) < 1e-6 for k in range(10))
    with pytest.raises(Exception, match="and not 5 numbers"):
        G.embedded(docs, lambda texts: np.zeros((len(texts), 2)), 5).collect()


def test_search_holds_one_pair_of_blocks_at_a_time(spark):
    """Memory does not grow with the pairs in a batch; equal scores go by id, also across blocks."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from pitchflow.operators import docs as G

    rng = np.random.default_rng(1)
    ids, v = np.arange(6000), rng.normal(size=(6000, 16))
    vectors = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v.tolist())], names=["vec_id", "embedding"])
    b = pa.Table.from_batches(list(G._blocks([vectors]))).combine_chunks().to_batches()[0]
    pairs = pa.RecordBatch.from_arrays([*b.columns, *b.columns], names=["ids", "v", "qids", "q"])
    tracemalloc.start()
    for _ in G._search([pairs], 8):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 2**20

    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(1500)], "vec_id bigint, embedding array<double>")
    got = G.cosine_top_k(same, same.where("vec_id in (0, 1400)"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (1400, 0), (1400, 1), (1400, 2)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 * 2**20


def test_match_files_are_parsed_once_for_the_pick(spark):
    from pitchflow.plans import files

    out = files._picked(spark, "/root/testdata/sf0.001")
    assert {r.outcome for r in out.collect()} == {"found", "not_found"}
    assert "from_json" not in out._jdf.queryExecution().toString()
