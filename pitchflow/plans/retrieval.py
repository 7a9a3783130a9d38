"""Queries over documents, conversations, streams and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import baseline as B
from ..operators import chains as C
from ..operators import clusters as K
from ..operators import decision as D
from ..operators import docs as G
from ..operators import insights as I
from ..operators import load as L
from ..operators import models as M
from ..sources.adapters import ACTIONS, actions, table
from ..sources.shared import shared_dir, written
from ..streaming import live, matches
from . import league as league_plans
from . import load as load_plans
from . import match as match_plans


def _shared(spark) -> str:
    """A new folder under the one that all executors share."""
    return f"{shared_dir(spark)}/pitchflow-{uuid.uuid4().hex}"


def _pages(s, d):
    return table(s, d, "pages").select("page_id", F.col("html").alias("text"))


def _search(s, d):
    v = table(s, d, "embeddings")
    return G.cosine_top_k(v, v.where("vec_id % 20 = 0")).withColumn("score", F.round("score", 6))


def _blended(s, d):
    v = table(s, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    return G.blend(G.cosine_top_k(v.where("label % 2 = 0"), q, 8).drop("rank"), G.cosine_top_k(v.where("label % 2 = 1"), q, 8).drop("rank"), 6).select("query_id", "vec_id", "rank", "scope")


def _run(query, folder: str, name: str = "state") -> None:
    query.option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()


#: What the live queries need of an event. A state holds each event whole and a batch reads all of a match it touches, so
#: columns that no result depends on are left out before the stream.
_OF_EVENT = ("event_id", "match_id", "team_id", "sec")
_OF_CHAINS = (
    *_OF_EVENT, "player_id", "event_type", "x", "end_x", "accurate", "won", "xg", "on_target", "is_goal", "tag_loss", "tag_offside", "tag_duel_lost",
    "possession_id", "possession_team_id", "possession_duration", "possession_end_x", "set_piece",
)
_OF_INSIGHTS = (*_OF_EVENT, "player_id", "recipient_id", "event_type", "period", "x", "accurate", "won", "tag_loss", "tag_duel_lost")


def _live_chains(s, d):
    """The stream of events in batches of files, snapshots of the matches each touches, then the newest of each match."""
    folder = _shared(s)
    rows = actions(s, d).select(*_OF_CHAINS)
    rows.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    _run(matches.live_sink(matches.match_states(stream), f"{folder}/out", lambda e: C.team_stats(C.chains(e))), folder)
    return match_plans._rounded(live.latest(s, f"{folder}/out"), "mean_length", "mean_duration", "xg", "mean_score", "conversion")


def _live_insights(s, d):
    """Events that come twice, the second time as they are to stand; pressing, losses and passes of the last copies, live."""
    folder = _shared(s)
    rows = actions(s, d).select(*_OF_INSIGHTS).withColumn("ingest", F.lit(2))
    stale = rows.where("event_id % 3 = 0").withColumns({"ingest": F.lit(1), "x": F.lit(1.0), "won": F.lit(False), "tag_loss": F.lit(True)})
    stale.unionByName(rows).repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    analyse = lambda e: {"pressing": I.pressing(e), "losses": I.losses_by_zone(e), "passing": I.pass_edges(e)}
    _run(matches.live_sink(matches.match_states(stream, order="ingest"), f"{folder}/out", analyse), folder)

    def of(name, *columns):
        sums = [F.sum(c).cast("bigint").alias(f"{name}_{c}") for c in columns]
        return live.latest(s, f"{folder}/out/{name}").groupBy("match_id", "team_id").agg(*sums)

    both = of("pressing", "duels", "won").join(of("losses", "total", "loss_tag"), ["match_id", "team_id"], "full_outer")
    return both.join(of("passing", "passes"), ["match_id", "team_id"], "full_outer")


#: How far a row may be behind the stream in the query of late rows.
LATE_DAYS = 10


def _late_events(s, d):
    """Three files, one a batch; what is over ten days behind the files before goes to the side. Events of both by match and team."""
    folder = _shared(s)
    stamps = table(s, d, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = written(actions(s, d).select(*_OF_EVENT).join(stamps, "event_id"), "stamped")
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    states = matches.match_states(stream, stamp="ts", bound=f"{LATE_DAYS} days")
    _run(matches.live_sink(states, f"{folder}/out", lambda e: e.select("match_id", "team_id", "event_id"), f"{folder}/late"), folder)
    one = lambda rows, n: rows.select("match_id", "team_id", F.lit(n).alias("late"))
    late = s.read.schema(rows.schema).parquet(f"{folder}/late")
    both = one(live.latest(s, f"{folder}/out"), 0).unionByName(one(late, 1))
    return both.groupBy("match_id", "team_id").agg(F.count_if(F.col("late") == 0).alias("events"), F.count_if(F.col("late") == 1).alias("late"))


#: What the live counts count, by name.
COUNTED = {"losses": "tag_loss", "duels": "event_type IN ('ground_duel', 'aerial_duel')", "duels_won": "won"}


def _live_counts(s, d):
    """Events that come twice, counted once by match, team and minute in the state of the stream."""
    folder = _shared(s)
    rows = actions(s, d)
    rows.unionByName(rows.where("event_id % 3 = 0")).repartition(4, "event_id", "sec").write.parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    _run(matches.counts_sink(matches.counts_by_minute(stream, counted=COUNTED), f"{folder}/out"), folder)
    return matches.newest_counts(s.read.parquet(f"{folder}/out"))


def _deduplicated(s, d):
    """Events that arrive twice, through the stream's state."""
    folder = _shared(s)
    e = table(s, d, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("bigint").alias("user_id"))
    e.unionByName(e).write.parquet(f"{folder}/in")
    stream = s.readStream.schema(e.schema).parquet(f"{folder}/in")
    q = live.first_copies(stream, ttl="60 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    q.start().awaitTermination()
    return s.read.schema(e.schema).parquet(f"{folder}/out").select("event_id", "user_id")


#: The forest of the decision queries; the operator's own defaults are 700 trees of depth 14.
TREES, DEPTH = 100, 10


def _matrix(s, d):
    rows = D.feature_matrix(D.label(actions(s, d), 600))
    return written(rows.withColumn("fold", M.fold_of(F.col("match_id"))), "feature-matrix")


def _decision_model(s, d, trees=TREES, depth=DEPTH):
    """Every action with each action in its place, by the forest of its fold of matches, which was fitted on the others."""
    scored = M.scored_by_fold(_matrix(s, d), D.CATEGORICAL, D.NUMERIC, trees=trees, depth=depth)
    return D.choose(written(scored, "model-scores"))


#: The net of the query has the layers of the reference's settings, with larger mini-batches and fewer epochs.
NET = {"hidden": (256, 128, 64), "batch": 4096, "epochs": 15, "patience": 5, "rate": 1e-3}


def _model_selection(s, d):
    """The forest against the neural net, in three folds of matches."""
    rows = _matrix(s, d).withColumn("fold", F.col("fold") % 3)
    scorers = {
        "random_forest": lambda r: M.forest_scores(r, D.CATEGORICAL, D.NUMERIC, trees=40, depth=8),
        "neural_net": lambda r: M.net_scores(r, D.CATEGORICAL, D.NUMERIC, **NET),
    }
    return M.candidates(rows, scorers)


#: What future form is predicted from.
FORM_FEATURES = (
    "per_min_mean_7", "high_share_mean_7", "load_mean_7", "load_cv_7", "ac_distance", "ac_high_acc", "ac_load", "ac_distance_3_21", "ac_high_acc_3_21", "ac_load_3_21",
    "ac_distance_ewma", "ac_high_acc_ewma", "ac_load_ewma", "monotony", "strain", "gap", "distance_z", "high_acc_z", "load_z",
    "match_xg_per90", "match_xg_assist_per90", "match_goals_per90", "match_assists_per90", "match_pass_accuracy", "match_duel_win_rate",
)


def _form_rows(s, d):
    """Player days with all features of the form model, today's form and the means before and after."""
    days = L.targets(L.personal_z(L.rolling_and_ratios(load_plans._form(s, d), (7,), ("per_min", "high_share", "load"))))
    context = L.match_context(load_plans._match_rows(s, d))
    named = context.select("player_id", *[F.col(c.removeprefix("match_")).alias(c) for c in FORM_FEATURES if c.startswith("match_")])
    return written(L.with_totals(L.ewma(days), named), "form-rows")


def _form_model(s, d):
    out, _ = M.future_form(_form_rows(s, d), FORM_FEATURES, "next7", 20, "ma14", trees=60, depth=8)
    return M.errors(written(out, "form-predictions"), "next7", forest="prediction", last_form="form", mean_14_days="ma14")


def _form_importances(s, d):
    return M.future_form(_form_rows(s, d), FORM_FEATURES, "next7", 20, "ma14", trees=60, depth=8)[1]


def _fatigue_model(s, d):
    return load_plans._fatigue(s, d).select("player_id", "day", "anomaly", "is_anomaly")


#: What teams are clustered by.
TEAM_FEATURES = (
    "passSuccessRate", "progressivePassSuccessRate", "finalThirdPassSuccessRate", "lossRate", "ownHalfLossRate", "dangerousLossRate", "shotOnTargetRate", "xgPerShot", "boxEfficiency",
    "counterpressingRate", "highRecoveryRate", "duelSuccessRate",
)


def _team_clusters(s, d):
    return K.named_team_clusters(K.clusters(league_plans._features(s, d), TEAM_FEATURES, 5, scale=False)).select("match_id", "team_id", "cluster", "profile", F.array_join("explanation", "; ").alias("explanation"))


def _team_cluster_rows(s, d):
    """The clusters themselves: how many team matches, and their mean features."""
    found = K.named_team_clusters(K.clusters(league_plans._features(s, d), TEAM_FEATURES, 5, scale=False))
    return K.cluster_rows(found, TEAM_FEATURES, ("cluster", "profile"))


def _player_clusters(s, d):
    return K.player_clusters(written(load_plans._profiles(s, d), "player-profiles"), L.PROFILE)[0].select("player_id", "cluster", "profile", "pca_1", "pca_2")


#: What the anomaly of a team's match is found from, the share of anomalous matches and the trees.
ANOMALY_FEATURES = (
    "passSuccessRate", "progressivePassSuccessRate", "finalThirdPassSuccessRate", "lossRate", "ownHalfLossRate", "dangerousLossRate",
    "shotOnTargetRate", "xgPerShot", "boxEfficiency", "counterpressingRate", "highRecoveryRate", "duelSuccessRate",
)
CONTAMINATION, ANOMALY_TREES = 0.1, 300


def _final_report_of_models(s, d):
    """The final report with the anomalies of the isolation forest and the clusters of k-means."""
    rows = written(league_plans._features(s, d), "team-features")
    found = M.isolation_forest(rows, ANOMALY_FEATURES, B.KEYS, ANOMALY_TREES, contamination=CONTAMINATION)
    anomalies = found.select(*B.KEYS, F.col("anomaly").alias("anomaly_score"), F.col("is_anomaly").alias("is_anomalous"))
    clusters = K.named_team_clusters(K.clusters(rows, TEAM_FEATURES, 5, scale=False)).select(*B.KEYS, "cluster", "profile")
    report = B.final_report(league_plans._compared(s, d), anomalies, clusters)
    return report.select(*B.KEYS, "risk", "overall", "weak_metrics", "anomaly_score", "is_anomalous", "cluster", "profile", F.array_join("titles", "; ").alias("titles"))


def _days_of_clustered_players(s, d):
    clustered = K.player_clusters(written(load_plans._profiles(s, d), "player-profiles"), L.PROFILE)[0]
    return K.with_clusters(load_plans._days(s, d).select("player_id", "day", "distance", "load"), clustered)


#: Words that the given pages, of invented languages, do have beside words of the game that they may have.
_TOPICS = {
    "pressing": ("press", "recover", "thing", "ention"), "build_up": ("pass", "build", "stion", "keiten"),
    "set_pieces": ("corner", "free kick", "ación", "mente"), "roles": ("keeper", "winger", "eaux", "ement"),
}


QUERIES = {
    "g3_topic_pages": lambda s, d: G.topic_pages(_pages(s, d), _TOPICS),
    "g7_cosine_top_k": _search,
    "g10_blended": _blended,
    "w16_recent_messages": lambda s, d: G.recent_messages(table(s, d, "conversations")).select("conv_id", "turn", "role", "back"),
    "w17_context_budget": lambda s, d: G.within_budget(table(s, d, "conversations").withColumn("n", F.length("text")), "conv_id", "n", "turn", "turn", 600),
    "w18_unique_ids": lambda s, d: G.unique_ids(table(s, d, "documents").select("doc_id", F.col("source").alias("id")), "id", "doc_id").select("doc_id", "unique_id"),
    "g14_collections": lambda s, d: G.collection_listing(table(s, d, "documents")),
    "g1_team_documents": lambda s, d: G.team_documents(C.team_stats(C.chains(actions(s, d)))),
    "f6_slugs": lambda s, d: table(s, d, "customer").select("c_custkey", scalar.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"), scalar.normal_name(F.col("c_name")).alias("name")),
    "st1_dedup": _deduplicated,
    "st4_live_chains": _live_chains,
    "st5_late_events": _late_events,
    "st6_live_insights": _live_insights,
    "st6_live_counts": _live_counts,
    "m1_decision_model": lambda s, d: _decision_model(s, d).select("event_id", "event_type", "p_pass", "p_shot", "p_carry", "value", "best", "gain", "low", "suggested"),
    "m3_model_selection": _model_selection,
    "dq4_model_players": lambda s, d: D.player_summary(_decision_model(s, d)),
    "m5_form_importances": _form_importances,
    "m5_form_model": _form_model,
    "m7_fatigue_anomalies": _fatigue_model,
    "m8_team_clusters": _team_clusters,
    "m8_team_cluster_rows": _team_cluster_rows,
    "m9_player_clusters": _player_clusters,
    "b15_final_report_of_models": _final_report_of_models,
    "j9_days_of_clustered_players": _days_of_clustered_players,
}

_SCORES = """SELECT page_id, 'pressing' AS topic, contains(h, 'press')::INT + contains(h, 'recover')::INT + contains(h, 'thing')::INT + contains(h, 'ention')::INT AS score FROM pg
    UNION ALL SELECT page_id, 'build_up', contains(h, 'pass')::INT + contains(h, 'build')::INT + contains(h, 'stion')::INT + contains(h, 'keiten')::INT FROM pg
    UNION ALL SELECT page_id, 'set_pieces', contains(h, 'corner')::INT + contains(h, 'free kick')::INT + contains(h, 'ación')::INT + contains(h, 'mente')::INT FROM pg
    UNION ALL SELECT page_id, 'roles', contains(h, 'keeper')::INT + contains(h, 'winger')::INT + contains(h, 'eaux')::INT + contains(h, 'ement')::INT FROM pg"""
_SIM = "sim AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"

SQL = {
    "g3_topic_pages": f"WITH pg AS (SELECT page_id, lower(coalesce(html, '')) AS h FROM pages) SELECT page_id, topic, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, page_id) AS rank FROM ({_SCORES}) WHERE score > 0) WHERE rank <= 4",
    "g7_cosine_top_k": f"WITH {_SIM} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim) WHERE rank <= 5",
    "g10_blended": f"""WITH {_SIM}, r AS (SELECT *, label % 2 AS scope, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY score DESC, vec_id) AS k FROM sim)
        SELECT query_id, vec_id, rank, scope FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (k <= 3) DESC, score DESC, vec_id) AS rank FROM r WHERE k <= 8) WHERE rank <= 6""",
    "w16_recent_messages": "SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5",
    "w17_context_budget": """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
        w AS (SELECT conv_id, 0::BIGINT AS r, 0::BIGINT AS used, '' AS docs FROM (SELECT DISTINCT conv_id FROM t)
          UNION ALL SELECT w.conv_id, t.r, CASE WHEN used + n > 600 THEN used ELSE used + n END, CASE WHEN used + n > 600 THEN docs WHEN docs = '' THEN turn::VARCHAR ELSE docs || ',' || turn END FROM w JOIN t ON t.conv_id = w.conv_id AND t.r = w.r + 1)
        SELECT w.conv_id, CASE WHEN docs = '' THEN n ELSE used END AS used, CASE WHEN docs = '' THEN turn::VARCHAR ELSE docs END AS docs FROM w JOIN t ON t.conv_id = w.conv_id AND t.r = 1 QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.r DESC) = 1""",
    "w18_unique_ids": "SELECT doc_id, CASE WHEN n > 1 THEN source || '_' || n ELSE source END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)",
    "g14_collections": "WITH g AS (SELECT source, count(*) AS docs, count(DISTINCT lang) AS types, trim(regexp_replace(arg_min(text, doc_id), '\\s+', ' ', 'g')) AS t FROM documents GROUP BY source) SELECT source, docs, types, CASE WHEN length(t) > 40 THEN rtrim(t[1:40]) || '...' ELSE t END AS preview FROM g",
    "g1_team_documents": match_plans._STATS + """ SELECT 'chains:' || match_id || ':' || team_id AS doc_id, match_id, team_id, 'possession_chains' AS document_type,
        printf('Team %d played %d possession chains in match %d, %d of them ended in a shot and %d in a goal.', team_id, chains, match_id, shots, goals) AS text FROM st""",
    "f6_slugs": "SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(concat_ws(' ', c_name, c_mktsegment))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(lower(trim(c_name)), '\\s+', ' ', 'g') AS name FROM customer",
    "st1_dedup": "SELECT DISTINCT event_id, user_id FROM events",
    "st4_live_chains": match_plans.SQL["c8_team_stats"],
    "st5_late_events": f"""WITH {ACTIONS}, t AS (SELECT match_id, team_id, a.event_id % 3 AS f, epoch_ms(events.ts) AS ms FROM a JOIN events ON events.event_id = a.event_id),
        m AS (SELECT f, max(max(ms)) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10 * 86400000 AS mark FROM t GROUP BY f)
        SELECT match_id, team_id, count(*) FILTER (WHERE mark IS NULL OR ms >= mark) AS events, count(*) FILTER (WHERE ms < mark) AS late FROM t JOIN m USING (f) GROUP BY match_id, team_id""",
    "st6_live_counts": f"""WITH {ACTIONS} SELECT match_id, team_id, sec // 60 AS minute, count(*) FILTER (WHERE tag_loss) AS losses,
        count(*) FILTER (WHERE event_type IN ('ground_duel', 'aerial_duel')) AS duels, count(*) FILTER (WHERE won) AS duels_won FROM a GROUP BY ALL""",
    "st6_live_insights": f"""{match_plans._L}, pr AS (SELECT match_id, team_id, count(*) AS pressing_duels, count(*) FILTER (WHERE a.won) AS pressing_won FROM a WHERE event_type IN ('ground_duel', 'aerial_duel') GROUP BY ALL),
        lo AS (SELECT match_id, team_id, count(*) AS losses_total, count(*) FILTER (WHERE loss = 'loss_tag') AS losses_loss_tag FROM l GROUP BY ALL), pa AS (SELECT match_id, team_id, count(*) AS passing_passes FROM a WHERE event_type = 'pass' AND accurate AND recipient_id IS NOT NULL GROUP BY ALL)
        SELECT match_id, team_id, pressing_duels, pressing_won, losses_total, losses_loss_tag, passing_passes FROM pr FULL JOIN lo USING (match_id, team_id) FULL JOIN pa USING (match_id, team_id)""",
}
