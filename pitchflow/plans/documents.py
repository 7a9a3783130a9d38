"""Queries that turn results into text documents, contexts and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import decision as D
from ..operators import docs as G
from ..operators import documents as T
from ..operators import fusion as X
from ..operators import insights as I
from ..sources.adapters import actions, signals, table
from . import evidence as evidence_plans
from . import league as league_plans
from . import match as match_plans
from . import reports as report_plans
from . import teams as team_plans


def _out(docs):
    return docs.select("doc_id", "document_type", "category", "text")


def _losses(s, d):
    a = actions(s, d)
    return T.ball_losses(I.losses_by_zone(a), I.losses_by_player(a), I.hot_cells(I.loss_grid(a)))


def _pressing(s, d):
    a = actions(s, d)
    return T.pressing(I.pressing(a), I.top_and_bottom(I.duelists(a), "won"))


def _breaks(s, d):
    a = actions(s, d)
    return T.line_breaks(I.line_breaks(a), I.line_breaking_runs(a))


def _attacks(s, d):
    a = actions(s, d)
    return T.attacking_patterns(I.attacks_by_flank(a), I.attackers(a), I.attack_types(a, report_plans._types()))


def _network(s, d):
    a = actions(s, d)
    return T.passing_network(I.pass_nodes(a), I.pass_edges(a), I.flank_usage(I.pass_nodes(a)))


def _decisions(s, d):
    c = team_plans._chosen(s, d)
    by_type = c.groupBy("match_id", F.col("event_type").alias("decision")).agg(F.count(F.lit(1)).alias("actions"), F.avg("value").alias("value"))
    return T.decision_quality(D.match_summary(c), by_type, c.where("suggested is not null"), _lowest(s, d).withColumn("match_id", F.lit(0)))


def _lowest(s, d):
    p = D.player_summary(team_plans._chosen(s, d))
    return T.lowest_by_player(p.where("needs_support").withColumn("score", F.col("score") + 0.001), p.where("score_rank <= 0.4"))


def _baseline(s, d):
    c = league_plans._compared(s, d)
    rows = league_plans._features(s, d)
    report = B.final_report(c, rows.select(*B.KEYS, F.col("lossRate").alias("anomaly_score"), (F.col("lossRate") > 0.2).alias("is_anomalous")), rows.select(*B.KEYS, F.lit(0).alias("cluster"), F.lit("mixed_profile").alias("profile")))
    return T.tactical_baseline(report, B.weakness_signals(c))


def _fusion(s, d):
    g = signals(s, d)
    f = X.fuse(g)
    of = lambda rows: rows.withColumnRenamed("sample_id", "match_id")
    return T.fusion(of(X.insights(f, g)), of(X.training_focus(f)), of(X.headline(f)), of(X.player_priorities(g)))


_SECTIONS = {
    "club_philosophy": {"overview": ("license", "zzzz")},
    "game_phase": {"build_up": ("and", "pro", "version"), "defense": ("zzzz",)},
    "tactical_principle": {"pressing": ("from", "mit"), "transition": ("zzzz",)},
    "player_role_profile": {"roles": ("email", "key", "qu")},
}


def _pages(s, d):
    """The documents as pages of clubs, forty pages a club."""
    return table(s, d, "documents").select(F.expr("doc_id div 40").alias("club"), F.expr("doc_id % 40").alias("page"), "text")


def _club(s, d):
    c = T.club_documents(_pages(s, d), most=500, sections=_SECTIONS)
    return c.select("doc_id", "document_type", "category", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.sha2("text", 256).alias("text_sha256"))


def _sources(s, d):
    """Hits of every query with the text of a document behind each."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return evidence_plans._hits(s, d, 8).join(docs, "vec_id", "left").withColumn("text", F.coalesce(F.translate(F.substring("text", 1, 700), "\t\r\x0b\x0c", "    "), F.lit("")))


def _context(s, d):
    blocks = T.context_blocks(_sources(s, d)).withColumn("size", F.col("size") + 0)
    return G.within_budget(blocks, "query_id", "size", "score", "vec_id", 1500)


def _answers(s, d):
    a = T.extractive_answer(_sources(s, d).withColumn("question", F.concat(F.lit("What is near vector "), F.col("query_id").cast("string"), F.lit("?"))))
    return a.select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.length(T.capped_bullets(F.col("answer"), 3)).alias("capped_chars"))


def _metadata(s, d):
    """What stands behind the documents of pressing players, from their metadata."""
    docs = _pressing(s, d).where("document_type = 'pressing_player_profile'")
    return docs.select("doc_id", *[F.element_at("metadata", k).cast("bigint").alias(k) for k in ("player_id", "duels", "won", "rank")], F.element_at("metadata", "service").alias("service"))


QUERIES = {
    "g1_metadata": _metadata,
    "g1_ball_losses": lambda s, d: _out(_losses(s, d)),
    "g1_pressing": lambda s, d: _out(_pressing(s, d)),
    "g1_line_breaks": lambda s, d: _out(_breaks(s, d)),
    "g1_attacking_patterns": lambda s, d: _out(_attacks(s, d)),
    "g1_passing_network": lambda s, d: _out(_network(s, d)),
    "g1_player_profiles": lambda s, d: _out(T.player_profiles(I.player_profiles(actions(s, d)))),
    "g1_decision_quality": lambda s, d: _out(_decisions(s, d)),
    "g1_tactical_baseline": lambda s, d: _out(_baseline(s, d)),
    "g1_fusion": lambda s, d: _out(_fusion(s, d)),
    "g4_club_documents": _club,
    "g11_contexts": _context,
    "g13_answers": _answers,
    "t6_lowest_by_player": lambda s, d: _lowest(s, d).select("player_id", F.round(F.col("score") + 3.3e-10, 6).alias("score")),
}

_L, _A = match_plans._L, match_plans._A
_NUM = "printf('%.{1}f', round({0} + 3.3 * pow(10, -{1} - 4), {1}) + 0.0::DOUBLE)"
_N = lambda x, digits: _NUM.format(f"({x})", digits)
_ID = "'match_' || match_id || '_{0}_{1}_t' || team_id"
_PART = "|| '_' || regexp_replace(regexp_replace(lower({0}::VARCHAR), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _doc(service, kind, category, text, source, part=None):
    return f"SELECT {_ID.format(service, kind)} {_PART.format(part) if part else ''} AS doc_id, '{kind}' AS document_type, '{category}' AS category, {text} AS text FROM {source}"


_RUNS = match_plans.SQL["a7_line_breaking_runs"]
_SRC = f"""WITH {evidence_plans._HITS}, sr AS (SELECT hits.*, coalesce(translate(text[1:700], chr(9) || chr(13) || chr(11) || chr(12), '    '), '') AS text FROM hits LEFT JOIN documents ON doc_id = vec_id),
  fl AS (SELECT *, trim(replace(text, chr(10), ' ')) AS flat FROM sr)"""
_SEC = " UNION ALL ".join(
    f"SELECT club, page, text, '{kind}' AS kind, '{name}' AS section, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + " AS score FROM pg" for kind, names in _SECTIONS.items() for name, words in names.items()
)

_NETWORK = f"""WITH n AS ({match_plans.SQL["a14_pass_nodes"]}), ed AS ({match_plans.SQL["a15_pass_edges"]}), fu AS ({match_plans.SQL["a17_flank_usage"]}),
nk AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY touches DESC, player_id) AS most, row_number() OVER (PARTITION BY match_id, team_id ORDER BY touches, player_id) AS least FROM n),
ek AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY passes DESC, passer_id, recipient_id) AS k FROM ed WHERE recipient_id IS NOT NULL),
su AS (SELECT match_id, team_id, count(*) AS players, sum(touches) AS touches FROM n GROUP BY ALL), pa AS (SELECT match_id, team_id, sum(passes) AS passes FROM ek GROUP BY ALL),
sz AS (SELECT su.*, coalesce(passes, 0) AS passes FROM su LEFT JOIN pa USING (match_id, team_id)),
hu AS (SELECT match_id, team_id, string_agg('player ' || player_id || ' (' || touches || ')', '; ' ORDER BY most) AS t FROM nk WHERE most <= 3 GROUP BY ALL),
al AS (SELECT match_id, team_id, string_agg('player ' || player_id || ' (' || touches || ')', '; ' ORDER BY least) AS t FROM nk WHERE least <= 2 GROUP BY ALL),
cn AS (SELECT match_id, team_id, string_agg(passer_id || ' to ' || recipient_id || ' (' || passes || ')', '; ' ORDER BY k) AS t FROM ek WHERE k <= 5 GROUP BY ALL)"""
_PROFILE = "'match_' || match_id || '_player_profile_service_{0}_' || player_id"

SQL = {
    "g1_metadata": f"""WITH tb AS ({report_plans.SQL["t4_top_and_bottom"]}), x AS (SELECT {_ID.format("pressing_intensity_service", "pressing_player_profile")} {_PART.format("player_id")} AS doc_id, player_id, duels, tb.won, rank FROM tb)
        SELECT doc_id, player_id::BIGINT AS player_id, duels::BIGINT AS duels, won::BIGINT AS won, rank::BIGINT AS rank, 'pressing-intensity-service' AS service FROM x""",
    "g1_passing_network": f"""{_NETWORK} {_doc("passing_network_service", "passing_network_summary", "passing_network", "players || ' players with ' || touches || ' touches and ' || passes || ' passes.'", "sz")}
        UNION ALL {_doc("passing_network_service", "passing_hubs_summary", "passing_network", "'Most touches: ' || t || '.'", "hu")}
        UNION ALL {_doc("passing_network_service", "isolated_players_summary", "passing_network", "'Fewest touches: ' || t || '.'", "al")}
        UNION ALL {_doc("passing_network_service", "passing_connections_summary", "passing_network", "'Most passes: ' || t || '.'", "cn")}
        UNION ALL {_doc("passing_network_service", "flank_usage_summary", "passing_network", "'Left ' || " + _N('"left"', 1) + " || ', center ' || " + _N("center", 1) + " || ', right ' || " + _N('"right"', 1) + " || ' percent of touches.'", "fu")}""",
    "g1_player_profiles": f"""WITH pp AS ({match_plans.SQL["a16_player_profiles"]})
        SELECT {_PROFILE.format("player_movement_profile")} AS doc_id, 'player_movement_profile' AS document_type, 'player_profile' AS category,
          touches || ' touches, ' || receptions || ' of them received, around (' || {_N("mean_x", 1)} || ', ' || {_N("mean_y", 1)} || ').' AS text FROM pp
        UNION ALL SELECT {_PROFILE.format("player_role_interpretation")}, 'player_role_interpretation', 'player_profile', 'player ' || player_id || ' plays mostly in the ' ||
          CASE WHEN attacking_third >= middle_third AND attacking_third >= defensive_third THEN 'attacking' WHEN defensive_third > middle_third THEN 'defensive' ELSE 'middle' END || ' third.' FROM pp""",
    "g1_ball_losses": f"""{_L}, z AS (SELECT match_id, team_id, count(*) AS total, count(*) FILTER (WHERE zone = 'defensive_third') AS d, count(*) FILTER (WHERE zone = 'middle_third') AS m, count(*) FILTER (WHERE zone = 'attacking_third') AS t FROM l GROUP BY ALL),
        p0 AS (SELECT match_id, team_id, player_id, count(*) AS losses, count(*) FILTER (WHERE zone = 'defensive_third') AS dangerous FROM l GROUP BY ALL), p AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY match_id, team_id ORDER BY dangerous DESC, losses DESC, player_id) <= 5),
        g0 AS (SELECT match_id, team_id, least(floor(y / 100 * 8), 7)::BIGINT AS row, least(floor(x / 100 * 12), 11)::BIGINT AS col, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY match_id, team_id ORDER BY g0.n DESC, g0.row, g0.col) <= 5),
        h AS (SELECT match_id, team_id, string_agg(g.row || ',' || g.col || ': ' || g.n, '; ' ORDER BY g.n DESC, g.row, g.col) AS t FROM g GROUP BY ALL)
        {_doc("ball_losses_service", "ball_losses_summary", "ball_losses", "total || ' losses, danger score ' || " + _N("(3 * d + m + 0.3::DOUBLE * t) / total", 3) + " || '; in the defensive third ' || d || ', middle ' || m || ', attacking ' || t || '.'", "z")}
        UNION ALL {_doc("ball_losses_service", "ball_loss_player_profile", "ball_losses", "'player ' || player_id || ' lost the ball ' || losses || ' times, ' || dangerous || ' of them dangerously.'", "p", "player_id")}
        UNION ALL {_doc("ball_losses_service", "ball_loss_heatmap_summary", "ball_losses", "'Cells with most losses (row,col: losses): ' || t || '.'", "h")}""",
    "g1_pressing": f"""{_A}, d AS (SELECT match_id, team_id, count(*) AS duels, count(*) FILTER (WHERE a.won) AS won, count(*) FILTER (WHERE period = '1H') AS d1, count(*) FILTER (WHERE period = '1H' AND a.won) AS w1 FROM a WHERE event_type IN ('ground_duel', 'aerial_duel') GROUP BY ALL),
        e2 AS (SELECT *, coalesce(w1 / nullif(d1, 0)::DOUBLE, 0) AS r1, coalesce((d.won - w1) / nullif(duels - d1, 0)::DOUBLE, 0) AS r2 FROM d), tb AS ({report_plans.SQL["t4_top_and_bottom"]})
        {_doc("pressing_intensity_service", "pressing_summary", "pressing", "'Pressing efficiency ' || " + _N("e2.won / duels::DOUBLE", 2) + " || ' over ' || duels || ' duels; change from the first to the second half ' || " + _N("r2 - r1", 2) + " || '.'", "e2")}
        UNION ALL {_doc("pressing_intensity_service", "pressing_player_profile", "pressing", "'player ' || player_id || ' won ' || tb.won || ' of ' || duels || ' pressing duels.'", "tb", "player_id")}
        UNION ALL {_doc("pressing_intensity_service", "pressing_timeline_summary", "pressing", "'First half efficiency ' || " + _N("r1", 2) + " || ', second half ' || " + _N("r2", 2) + " || '.'", "e2")}""",
    "g1_line_breaks": f"""{_A}, p AS (SELECT match_id, team_id, count(*) AS total, count(*) FILTER (WHERE tag_through) AS through, count(*) FILTER (WHERE accurate) / count(*)::DOUBLE AS completion FROM a WHERE event_type = 'pass' AND (tag_progressive OR tag_through) GROUP BY ALL),
        ru AS (SELECT * FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY match_id, team_id ORDER BY carries + passes DESC, player_id) <= 5)
        {_doc("line_breaks_service", "line_breaks_summary", "line_breaks", "total || ' line-breaking passes, ' || through || ' of them through balls, completion ' || " + _N("completion", 2) + " || '.'", "p")}
        UNION ALL {_doc("line_breaks_service", "line_break_player_profile", "line_breaks", "carries || ' carries and ' || passes || ' passes broke lines, ' || into_box || ' into the box; ' || led_to_shot || ' led to a shot.'", "ru", "player_id")}""",
    "g1_attacking_patterns": f"""{match_plans._ATT}, t AS (SELECT match_id, team_id, count(*) FILTER (WHERE flank = 'left') AS l, count(*) FILTER (WHERE flank = 'center') AS c, count(*) FILTER (WHERE flank = 'right') AS r, count(*) FILTER (WHERE with_shot) AS shots, count(*) FILTER (WHERE with_goal) AS goals FROM q GROUP BY ALL),
        pf AS (SELECT match_id, team_id, player_id, flank, count(*) AS n, sum(attack_xg) AS x FROM q GROUP BY ALL), pa AS (SELECT match_id, team_id, player_id, sum(n)::BIGINT AS attacks, sum(x) AS xg, arg_max(flank, (n, {match_plans._TIE})) AS flank FROM pf GROUP BY ALL),
        pk AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY attacks DESC, player_id) AS rk FROM pa), ty AS ({report_plans.SQL["a11_attack_types"]})
        {_doc("attacking_patterns_service", "attacking_patterns_summary", "attacking_patterns", "'Attacks on the left ' || l || ', in the center ' || c || ', on the right ' || r || '; ' || shots || ' with a shot and ' || goals || ' with a goal.'", "t")}
        UNION ALL {_doc("attacking_patterns_service", "attacking_player_profile", "attacking_patterns", "'player ' || player_id || ' took part in ' || attacks || ' attacks, mostly on the ' || flank || ', worth ' || " + _N("xg", 2) + " || ' xG.'", "pk WHERE rk <= 5", "player_id")}
        UNION ALL {_doc("attacking_patterns_service", "top_attacker_summary", "attacking_patterns", "'player ' || player_id || ' leads with ' || attacks || ' attacks.'", "pk WHERE rk = 1", "player_id")}
        UNION ALL {_doc("attacking_patterns_service", "attacking_type_profile", "attacking_patterns", "attacks || ' attacks by ' || type || ': ' || shots || ' with a shot, ' || goals || ' with a goal.'", "ty", "type")}""",
    "g4_club_documents": f"""WITH p0 AS (SELECT doc_id // 40 AS club, doc_id % 40 AS page, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
        pg AS (SELECT club, page, CASE WHEN length(t) > 500 THEN rtrim(t[1:500]) || '...' ELSE t END AS text FROM p0 WHERE t <> ''), sc AS ({_SEC}),
        rk AS (SELECT *, row_number() OVER (PARTITION BY club, kind, section ORDER BY score DESC, page) AS r, max(score) OVER (PARTITION BY club, kind, section) AS most, row_number() OVER (PARTITION BY club, kind, section ORDER BY page) AS first FROM sc),
        tk AS (SELECT * FROM rk WHERE (score > 0 AND r <= 4) OR (most = 0 AND kind IN ('club_philosophy', 'game_phase') AND first <= 2)),
        al AS (SELECT club, kind, section, string_agg(page, ',' ORDER BY page) AS pages, string_agg(text, ' ' ORDER BY r) AS text FROM tk WHERE kind <> 'player_role_profile' GROUP BY ALL UNION ALL SELECT club, kind, r::VARCHAR, page::VARCHAR, text FROM tk WHERE kind = 'player_role_profile')
        SELECT club || '_' || CASE WHEN kind = 'club_philosophy' THEN 'club_philosophy_overview' ELSE kind || '_' || section END AS doc_id, kind AS document_type,
        CASE kind WHEN 'club_philosophy' THEN 'club_knowledge' WHEN 'player_role_profile' THEN 'player_profile' ELSE section END AS category, pages, sha256(text) AS text_sha256 FROM al""",
    "g11_contexts": f"""{_SRC.replace("WITH ", "WITH RECURSIVE ", 1)}, bl AS (SELECT query_id, vec_id, rank, length('[' || doc || ' | ' || scope || ' | ' || document_type || ' | ' || {_N("score", 4)} || ']' || chr(10) || coalesce(nullif(trim(title), ''), 'n/a') || chr(10)
          || CASE WHEN length(flat) > 360 THEN rtrim(flat[1:360]) || '...' ELSE flat END || chr(10) || chr(10)) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS r FROM fl),
        w AS (SELECT query_id, 0::BIGINT AS r, 0::BIGINT AS used, '' AS docs FROM (SELECT DISTINCT query_id FROM bl)
          UNION ALL SELECT w.query_id, bl.r, CASE WHEN used + n > 1500 THEN used ELSE used + n END, CASE WHEN used + n > 1500 THEN docs WHEN docs = '' THEN vec_id::VARCHAR ELSE docs || ',' || vec_id END FROM w JOIN bl ON bl.query_id = w.query_id AND bl.r = w.r + 1)
        SELECT query_id, used, docs FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1""",
    "g13_answers": f"""{_SRC}, x AS (SELECT query_id, rank, document_type, '- ' || CASE WHEN length(flat) > 120 THEN rtrim(flat[1:120]) || '...' ELSE flat END AS q, regexp_matches(lower(text), 'critical|risk|weakness') AS ri, regexp_matches(lower(text), 'recommend|training|focus') AS ac FROM fl WHERE rank <= 5),
        l AS (SELECT query_id, list(q ORDER BY rank)[1:2] AS o, (list('- Risk named in ' || document_type || '.' ORDER BY rank) FILTER (WHERE ri))[1:2] AS r, (list('- Follow the advice in ' || document_type || '.' ORDER BY rank) FILTER (WHERE ac))[1:2] AS t FROM x GROUP BY ALL),
        an AS (SELECT query_id, 'Observations:' || chr(10) || '- Question: What is near vector ' || query_id || '?' || chr(10) || array_to_string(CASE WHEN len(o) < 2 THEN list_append(o, '- Not enough evidence for more.') ELSE o END, chr(10)) || chr(10) || chr(10) || 'Risks:' || chr(10) || coalesce(array_to_string(r, chr(10)), '- No explicit risk.')
          || chr(10) || chr(10) || 'Actions:' || chr(10) || coalesce(array_to_string(t, chr(10)), '- No explicit advice.') AS answer FROM l),
        ln AS (SELECT query_id, answer, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM an),
        cp AS (SELECT *, sum(starts_with(ltrim(line), '-')::INT) OVER (PARTITION BY query_id ORDER BY i) AS b FROM ln)
        SELECT query_id, sha256(any_value(answer)) AS answer_sha256, length(regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT starts_with(ltrim(line), '-') OR b <= 3), '^\\s+|\\s+$', '', 'g'))::INT AS capped_chars FROM cp GROUP BY query_id""",
    "t6_lowest_by_player": f"""{team_plans._S}, p AS (SELECT player_id, count(*) AS actions, avg(value) AS score FROM ch GROUP BY ALL), r AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS rk FROM p),
        u AS (SELECT player_id, score + 0.001::DOUBLE AS score FROM p WHERE score <= (SELECT quantile_cont(score, 0.25) FROM p) AND actions >= 3 UNION ALL SELECT player_id, score FROM r WHERE rk <= 0.4) SELECT player_id, round(min(score) + 3.3e-10, 6) AS score FROM u GROUP BY ALL""",
}
