"""Text documents from structured results: one projection for each kind of result.

Every function returns rows of doc_id, match_id, team_id, document_type, title, category, text. Numbers are rounded
half up before they are printed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.scalar import clip_text, number_text, slug, text_or

COLUMNS = ("doc_id", "match_id", "team_id", "document_type", "title", "category", "text")


def doc_id_of(match_id: Column, service: str, kind: str, part: Column | None = None) -> Column:
    """match_<id>_<service>_<type>, and the slug of a part behind it."""
    base = F.concat(F.lit("match_"), match_id.cast("string"), F.lit(f"_{service.replace('-', '_')}_{kind}"))
    if part is None:
        return base
    named = slug(part.cast("string"))
    return F.concat(base, F.lit("_"), F.when(named == "", "unknown").otherwise(named))


def document(rows: DataFrame, service: str, kind: str, category: str, title: Column, text: Column, part: Column | None = None) -> DataFrame:
    team = F.col("team_id") if "team_id" in rows.columns else F.lit(None).cast("bigint")
    of_team = F.concat(F.lit("t"), team.cast("string")) if "team_id" in rows.columns else None
    # Open metadata: every plain value of the row that the document was written from, as text.
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, ArrayType | MapType | StructType) and not f.name.startswith("__") and f.name not in ("match_id", "team_id")]
    pairs = [x for c in plain for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(F.lit("service"), F.lit(service), *pairs), lambda _, v: v.isNotNull())
    both = F.concat_ws(" ", *[x for x in (of_team, part.cast("string") if part is not None else None) if x is not None])
    return rows.select(doc_id_of(F.col("match_id"), service, kind, both).alias("doc_id"), "match_id", team.alias("team_id"), F.lit(kind).alias("document_type"), title.alias("title"), F.lit(category).alias("category"), text.alias("text"), metadata.alias("metadata"))


def _say(template: str, *values: Column) -> Column:
    """The template with the values in place of its {}."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, rest in zip(values, parts[1:], strict=True):
        out += [F.coalesce(v.cast("string"), F.lit("n/a")), F.lit(rest)]
    return F.concat(*out)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _best(rows: DataFrame, k: int, *order: Column, keys=("match_id", "team_id")) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def _player(c: str = "player_id") -> Column:
    return F.concat(F.lit("player "), F.col(c).cast("string"))


def ball_losses(zones: DataFrame, players: DataFrame, cells: DataFrame) -> DataFrame:
    """From losses_by_zone, losses_by_player and hot_cells."""
    s, c = "ball-losses-service", "ball_losses"
    summary = _say("{} losses, danger score {}; in the defensive third {}, middle {}, attacking {}.", F.col("total"), number_text(F.col("danger_score"), 3), F.col("defensive_third"), F.col("middle_third"), F.col("attacking_third"))
    profile = _say("{} lost the ball {} times, {} of them dangerously.", _player(), F.col("losses"), F.col("dangerous"))
    hot = cells.groupBy("match_id", "team_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%d,%d: %d", "row", "col", "n").alias("t")))), lambda x: x["t"]), "; ").alias("t"))
    return _all(
        document(zones, s, "ball_losses_summary", c, F.lit("Ball losses summary"), summary),
        document(_best(players, 5, F.desc("dangerous"), F.desc("losses"), F.col("player_id")), s, "ball_loss_player_profile", c, _say("Ball loss profile: {}", _player()), profile, F.col("player_id")),
        document(hot, s, "ball_loss_heatmap_summary", c, F.lit("Ball loss heatmap summary"), _say("Cells with most losses (row,col: losses): {}.", F.col("t"))),
    )


def pressing(teams: DataFrame, chosen_players: DataFrame) -> DataFrame:
    """From pressing and the players of top_and_bottom(duelists)."""
    s, c = "pressing-intensity-service", "pressing"
    rate = lambda a, b: number_text(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 2)
    profile = _say("{} won {} of {} pressing duels.", _player(), F.col("won"), F.col("duels"))
    return _all(
        document(teams, s, "pressing_summary", c, F.lit("Pressing summary"), _say("Pressing efficiency {} over {} duels; change from the first to the second half {}.", number_text(F.col("win_rate"), 2), F.col("duels"), number_text(F.col("drop"), 2))),
        document(chosen_players, s, "pressing_player_profile", c, _say("Pressing profile: {}", _player()), profile, F.col("player_id")),
        document(teams, s, "pressing_timeline_summary", c, F.lit("Pressing timeline summary"), _say("First half efficiency {}, second half {}.", rate("won_1h", "duels_1h"), rate("won_2h", "duels_2h"))),
    )


def line_breaks(teams: DataFrame, runners: DataFrame) -> DataFrame:
    """From line_breaks and line_breaking_runs."""
    s, c = "line-breaks-service", "line_breaks"
    text = _say("{} carries and {} passes broke lines, {} into the box; {} led to a shot.", F.col("carries"), F.col("passes"), F.col("into_box"), F.col("led_to_shot"))
    return _all(
        document(teams, s, "line_breaks_summary", c, F.lit("Line breaks summary"), _say("{} line-breaking passes, {} of them through balls, completion {}.", F.col("total"), F.col("through"), number_text(F.col("completion"), 2))),
        document(_best(runners, 5, F.desc(F.col("carries") + F.col("passes")), F.col("player_id")), s, "line_break_player_profile", c, _say("Line breaks: {}", _player()), text, F.col("player_id")),
    )


def attacking_patterns(flanks: DataFrame, players: DataFrame, types: DataFrame) -> DataFrame:
    """From attacks_by_flank, attackers and attack_types."""
    s, c = "attacking-patterns-service", "attacking_patterns"
    n = lambda f: F.sum(F.when(F.col("flank") == f, F.col("attacks")).otherwise(0)).alias(f)
    total = flanks.groupBy("match_id", "team_id").agg(n("left"), n("center"), n("right"), F.sum("shots").alias("shots"), F.sum("goals").alias("goals"))
    attackers = _best(players, 5, F.desc("attacks"), F.col("player_id"))
    return _all(
        document(total, s, "attacking_patterns_summary", c, F.lit("Attacking patterns summary"), _say("Attacks on the left {}, in the center {}, on the right {}; {} with a shot and {} with a goal.", F.col("left"), F.col("center"), F.col("right"), F.col("shots"), F.col("goals"))),
        document(attackers, s, "attacking_player_profile", c, _say("Attacking profile: {}", _player()), _say("{} took part in {} attacks, mostly on the {}, worth {} xG.", _player(), F.col("attacks"), F.col("preferred_flank"), number_text(F.col("xg"), 2)), F.col("player_id")),
        document(_best(players, 1, F.desc("attacks"), F.col("player_id")), s, "top_attacker_summary", c, F.lit("Top attacker"), _say("{} leads with {} attacks.", _player(), F.col("attacks")), F.col("player_id")),
        document(types, s, "attacking_type_profile", c, _say("Attacks by {}", F.col("type")), _say("{} attacks by {}: {} with a shot, {} with a goal.", F.col("attacks"), F.col("type"), F.col("shots"), F.col("goals")), F.col("type")),
    )


def passing_network(nodes: DataFrame, edges: DataFrame, usage: DataFrame, hubs: int = 3, isolated: int = 2) -> DataFrame:
    """From pass_nodes, pass_edges and flank_usage."""
    s, c, keys = "passing-network-service", "passing_network", ["match_id", "team_id"]
    size = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("players"), F.sum("touches").alias("touches")).join(edges.groupBy(*keys).agg(F.sum("passes").alias("passes")), keys, "left").na.fill(0, ["passes"])
    listed = lambda rows, text: rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", text.alias("t")))), lambda x: x["t"]), "; ").alias("t"))
    numbered = lambda rows, *order: rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    top = lambda rows, k, *order: numbered(rows, *order).where(F.col("__k") <= k)
    touches = _say("{} ({})", _player(), F.col("touches"))
    links = _say("{} to {} ({})", F.col("passer_id"), F.col("recipient_id"), F.col("passes"))
    return _all(
        document(size, s, "passing_network_summary", c, F.lit("Passing network summary"), _say("{} players with {} touches and {} passes.", F.col("players"), F.col("touches"), F.col("passes"))),
        document(listed(top(nodes, hubs, F.desc("touches"), F.col("player_id")), touches), s, "passing_hubs_summary", c, F.lit("Passing hubs"), _say("Most touches: {}.", F.col("t"))),
        document(listed(top(nodes, isolated, F.asc("touches"), F.col("player_id")), touches), s, "isolated_players_summary", c, F.lit("Isolated players"), _say("Fewest touches: {}.", F.col("t"))),
        document(listed(top(edges, 5, F.desc("passes"), F.col("passer_id"), F.col("recipient_id")), links), s, "passing_connections_summary", c, F.lit("Passing connections"), _say("Most passes: {}.", F.col("t"))),
        document(usage, s, "flank_usage_summary", c, F.lit("Flank usage"), _say("Left {}, center {}, right {} percent of touches.", *[number_text(F.col(x), 1) for x in ("left", "center", "right")])),
    )


def player_profiles(profiles: DataFrame) -> DataFrame:
    """From player_profiles, by match."""
    s, c = "player-profile-service", "player_profile"
    zone = F.when((F.col("attacking_third") >= F.col("middle_third")) & (F.col("attacking_third") >= F.col("defensive_third")), "attacking").when(F.col("defensive_third") > F.col("middle_third"), "defensive").otherwise("middle")
    return _all(
        document(profiles, s, "player_movement_profile", c, _say("Movement: {}", _player()), _say("{} touches, {} of them received, around ({}, {}).", F.col("touches"), F.col("receptions"), number_text(F.col("mean_x"), 1), number_text(F.col("mean_y"), 1)), F.col("player_id")),
        document(profiles, s, "player_role_interpretation", c, _say("Role: {}", _player()), _say("{} plays mostly in the {} third.", _player(), zone), F.col("player_id")),
    )


def decision_quality(summary: DataFrame, by_type: DataFrame, improvable: DataFrame, players: DataFrame) -> DataFrame:
    """From match_summary, by_type with match_id, the improvable phases with match_id and player rows of lowest_by_player with match_id."""
    s, c = "decision-quality-service", "decision_quality"
    return _all(
        document(summary, s, "decision_quality_summary", c, F.lit("Decision quality summary"), _say("{} actions of mean value {}; {} low, {} with a better alternative.", F.col("actions"), number_text(F.col("value"), 3), F.col("low"), F.col("with_alternative"))),
        document(by_type, s, "decision_by_type_summary", c, _say("Decisions by type: {}", F.col("decision")), _say("{} {} decisions of mean value {}.", F.col("actions"), F.col("decision"), number_text(F.col("value"), 3)), F.col("decision")),
        document(improvable, s, "improvable_phase", c, _say("Improvable phase {}", F.col("event_id")), _say("{} would have gained {} over {}.", F.col("suggested"), number_text(F.col("gain"), 3), F.col("event_type")), F.col("event_id")),
        document(players, s, "player_decision_profile", c, _say("Decisions of {}", _player()), _say("{} scores {} over {} actions.", _player(), number_text(F.col("score"), 3), F.col("actions")), F.col("player_id")),
    )


def lowest_by_player(*lists: DataFrame, score: str = "score", key: str = "player_id") -> DataFrame:
    """Of several lists of player rows the one with the lowest score of each player; the earlier list wins ties."""
    rows = _all(*[x.withColumn("__list", F.lit(k)) for k, x in enumerate(lists)])
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(score), F.lit(0.0)), "__list")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__list")


def tactical_baseline(report: DataFrame, signals: DataFrame) -> DataFrame:
    """From final_report and weakness_signals."""
    s, c = "tactical-baseline-service", "tactical_baseline"
    return _all(
        document(report, s, "baseline_summary", c, F.lit("Baseline summary"), _say("Overall weakness {}, risk {}, {} weak metrics.", number_text(F.col("overall"), 3), F.col("risk"), F.col("weak_metrics"))),
        document(signals, s, "baseline_weakness_signal", c, _say("Weakness: {}", F.col("signal_id")), _say("{} at {} against {} in the league, severity {}.", F.col("metric"), number_text(F.col("value"), 3), number_text(F.col("mean"), 3), F.col("label")), F.col("signal_id")),
        document(report, s, "tactical_profile_document", c, F.lit("Tactical profile"), _say("The team plays as {}.", F.col("profile"))),
        document(report, s, "anomaly_document", c, F.lit("Anomaly"), _say("Anomaly score {}, {}.", number_text(F.col("anomaly_score"), 3), F.when(F.col("is_anomalous"), "out of the ordinary").otherwise("within the ordinary"))),
    )


def fusion(insights: DataFrame, focus: DataFrame, headlines: DataFrame, players: DataFrame) -> DataFrame:
    """From insights, training_focus, headline and player_priorities, with match_id in place of sample_id."""
    s = "tactical-fusion-service"
    top = insights.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.max("combined").alias("most"))
    return _all(
        document(top, s, "match_summary", "fusion", F.lit("Match summary"), _say("{} combined insights, the gravest at {}.", F.col("n"), number_text(F.col("most"), 3))),
        document(insights, s, "tactical_insight", "fusion", _say("Insight: {}", F.col("type")), _say("{} Severity {}.", F.col("message"), F.col("severity")), F.col("type")),
        document(focus, s, "training_focus", "fusion", _say("Training focus: {}", F.col("category")), _say("{}, priority {}.", F.col("objective"), F.col("priority")), F.col("category")),
        document(headlines, s, "frontend_summary", "fusion", F.lit("Headline"), F.col("headline")),
        document(players, s, "player_priority", "priority_player", _say("Priority: {}", _player()), _say("{} at {}: {}", _player(), number_text(F.col("priority"), 3), F.col("action")), F.col("player_id")),
    )


# ---- pages of a club's book


#: The keywords of each section of a club's documents.
OVERVIEW = ("filozofie", "philosophy", "identitate", "identity", "adn", "model de joc", "style of play", "principii", "principles")
PHASES = {
    "build_up": ("build up", "constructie", "progressie", "progresie", "first line"), "pressing": ("pressing", "counter-press", "gegenpress", "agresivitate"),
    "transition": ("tranzitie", "transition", "ball loss", "ball win"), "final_third": ("final third", "treimea ofensiva", "last third", "zona 14"),
    "defense": ("defense", "defensiv", "organizare defensiva", "compact"),
}
PRINCIPLES = {
    "build_up": ("superioritate", "breaking first line", "depth", "width"), "ball_loss": ("ball loss", "pierderea mingii", "safety pass", "rest defense"),
    "pressing": ("pressing", "timing", "agresivitate", "trigger"), "transition": ("tranzitie", "counter", "recuperare", "reaction"), "final_third": ("final third", "finalizare", "shot", "chance creation"),
}
ROLES = ("profil jucator", "player profile", "rol", "role", "pozitie", "position")


def club_documents(pages: DataFrame, limit: int = 4, most: int = 2000, sections: dict | None = None) -> DataFrame:
    """Documents of each club from its pages (club, page, text): an overview, the phases of the game, principles, roles.

    A page counts the distinct keywords of a section that it holds; the `limit` best, ties by page, make up the
    section's text in that order. Without such a page the overview and the phases take the first two pages, a principle
    gets no document; each role page is a document of its own. sections: by kind, names and keywords. -> doc_id, club,
    document_type, category, pages, text.
    """
    p = pages.withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).where("text <> ''")
    p = p.withColumn("text", clip_text(F.col("text"), most))
    kinds = sections or {"club_philosophy": {"overview": OVERVIEW}, "game_phase": PHASES, "tactical_principle": PRINCIPLES, "player_role_profile": {"roles": ROLES}}
    low = F.lower("text")
    scores = [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("section"), sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("score")) for kind, names in kinds.items() for name, words in names.items()]
    first = F.row_number().over(Window.partitionBy("club").orderBy("page"))
    rows = p.withColumn("__first", first).select("club", "page", "text", "__first", F.inline(F.array(*scores)))
    by = Window.partitionBy("club", "kind", "section")
    rows = rows.withColumns({"__r": F.row_number().over(by.orderBy(F.desc("score"), "page")), "__any": F.max("score").over(by)})
    fallback = (F.col("__any") == 0) & F.col("kind").isin("club_philosophy", "game_phase") & (F.col("__first") <= 2)
    taken = rows.where(((F.col("score") > 0) & (F.col("__r") <= limit)) | fallback)
    one = taken.where("kind <> 'player_role_profile'").groupBy("club", "kind", "section").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "text"))), lambda x: x["text"]), " ").alias("text"))
    roles = taken.where("kind = 'player_role_profile'").select("club", "kind", F.col("__r").cast("string").alias("section"), F.array("page").alias("pages"), "text")
    all_ = one.unionByName(roles)
    name = F.when(F.col("kind") == "club_philosophy", "club_philosophy_overview").otherwise(F.concat("kind", F.lit("_"), "section"))
    category = F.when(F.col("kind") == "club_philosophy", "club_knowledge").when(F.col("kind") == "player_role_profile", "player_profile").otherwise(F.col("section"))
    return all_.select(F.concat(slug(F.col("club").cast("string")), F.lit("_"), name).alias("doc_id"), "club", F.col("kind").alias("document_type"), category.alias("category"), "pages", "text")


# ---- answers


def context_blocks(hits: DataFrame, key: str = "query_id", clip: int = 360) -> DataFrame:
    """hits with `block`, a document as it stands in a context, and its length."""
    text = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    short = F.when(F.length(text) > clip, F.concat(F.rtrim(F.substring(text, 1, clip)), F.lit("..."))).otherwise(text)
    block = F.concat(F.lit("["), F.col("doc").cast("string"), F.lit(" | "), "scope", F.lit(" | "), "document_type", F.lit(" | "), number_text(F.col("score"), 4), F.lit("]\n"), text_or(F.col("title"), "n/a"), F.lit("\n"), short, F.lit("\n\n"))
    return hits.withColumn("block", block).withColumn("size", F.length("block"))


def extractive_answer(hits: DataFrame, key: str = "query_id", top: int = 5, quote: int = 120) -> DataFrame:
    """key, answer: the first words of the two best documents, up to two risks and up to two actions among the `top` best.

    hits: key, rank, text, document_type; ties do not occur in ranks. With a column `question` the answer begins with it.
    """
    asked = F.coalesce(F.first("question"), F.lit("")) if "question" in hits.columns else F.lit(None).cast("string")
    low = F.lower(F.coalesce("text", F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    flat = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    quoted = F.when(F.length(flat) > quote, F.concat(F.rtrim(F.substring(flat, 1, quote)), F.lit("..."))).otherwise(flat)
    # The words that make a document name a risk or an action.
    kept = [c for c in ("question",) if c in hits.columns]
    rows = hits.where(F.col("rank") <= top).select(key, "rank", "document_type", *kept, quoted.alias("quote"), has("critical", "risk", "weakness").alias("risk"), has("recommend", "training", "focus").alias("action"))
    each = F.array_sort(F.collect_list(F.struct("rank", "quote", "document_type", "risk", "action"))).alias("d")
    lines = lambda test, text: F.slice(F.transform(F.filter("d", test), text), 1, 2)
    a = rows.groupBy(key).agg(each, asked.alias("asked")).select(
        key,
        "asked",
        F.slice(F.transform("d", lambda x: F.concat(F.lit("- "), x["quote"])), 1, 2).alias("o"),
        lines(lambda x: x["risk"], lambda x: F.concat(F.lit("- Risk named in "), x["document_type"], F.lit("."))).alias("r"),
        lines(lambda x: x["action"], lambda x: F.concat(F.lit("- Follow the advice in "), x["document_type"], F.lit("."))).alias("t"),
    )
    or_none = lambda c, none: F.array_join(F.when(F.size(c) == 0, F.array(F.lit(none))).otherwise(F.col(c)), "\n")
    observed = F.array_join(F.when(F.size("o") < 2, F.concat("o", F.array(F.lit("- Not enough evidence for more.")))).otherwise(F.col("o")), "\n")
    question = F.when(F.col("asked").isNull(), "").otherwise(F.concat(F.lit("- Question: "), F.col("asked"), F.lit("\n")))
    return a.select(key, F.concat(F.lit("Observations:\n"), question, observed, F.lit("\n\nRisks:\n"), or_none("r", "- No explicit risk."), F.lit("\n\nActions:\n"), or_none("t", "- No explicit advice.")).alias("answer"))


def capped_bullets(text: Column, most: int) -> Column:
    """The text without its bullets beyond the first `most`, and without blank lines at its end."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        bullet = F.startswith(F.ltrim(x), F.lit("-"))
        return F.when(bullet & (a["n"] >= most), a).otherwise(F.struct((a["n"] + bullet.cast("int")).alias("n"), F.concat(a["kept"], F.array(x)).alias("kept")))

    return F.trim(F.regexp_replace(F.array_join(F.aggregate(lines, start, step)["kept"], "\n"), r"^\s+|\s+$", ""))
