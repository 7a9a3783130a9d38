"""Training load, form and fatigue. Input: device sessions (player_id, day, role, session_name, sums and rates).

All windows share one partitioning by player and one order by day, so one shuffle and one sort serve them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.scalar import band, clamp, normal_name, safe_div

# What is summed over a day, what is averaged by duration, and the metrics of the windows.
SUMS = ("duration", "distance", "high_acc", "high_dec", "speed_20_25", "speed_25_50", "accel_low", "accel_high")
RATES = ("per_min", "power", "sprints")
METRICS = ("distance", "duration", "per_min", "high_acc", "high_dec", "high_speed", "high_share", "power", "sprints", "load", "accel")
WINDOWS = (3, 7, 14, 21, 28)
AC_METRICS, AC_WINDOWS = ("distance", "high_acc", "load"), ((3, 21), (7, 21), (7, 28))
Z_METRICS = ("distance", "duration", "per_min", "high_acc", "high_share", "load")
SPANS = (7, 28)
#: The acute to chronic ratios that have bands: 7 to 28 rows.
AC_FIELDS = tuple(f"ac_{m}" for m in AC_METRICS)
PROFILE = ("distance", "per_min", "high_share", "high_acc", "load", "sprints", "ac_distance", "ac_high_acc", "ac_load", "monotony", "strain", "match_xg_per90", "match_assists_per90", "match_duel_win_rate")


def by_player():
    return Window.partitionBy("player_id").orderBy("day")


def daily(sessions: DataFrame) -> DataFrame:
    """One row for each player and day: sums, rates weighted by duration, the number and distinct names of sessions, and
    what follows from them: high-speed distance and share, load (distance by power), accelerations."""
    duration = F.coalesce("duration", F.lit(0.0))
    weighted = [F.sum(F.coalesce(F.col(r), F.lit(0.0)) * duration).alias(f"__{r}") for r in RATES]
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.trim("session_name") != "", F.trim("session_name")))), " || ")
    d = sessions.where("player_id is not null and day is not null").groupBy("player_id", "day").agg(
        F.max("role").alias("role"), F.count(F.lit(1)).alias("sessions"), names.alias("session_names"), *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in SUMS], *weighted
    )
    d = d.withColumns({r: safe_div(F.col(f"__{r}"), F.col("duration")) for r in RATES}).drop(*[f"__{r}" for r in RATES])
    d = d.withColumn("high_speed", F.col("speed_20_25") + F.col("speed_25_50"))
    return d.withColumns({"high_share": safe_div(100 * F.col("high_speed"), F.col("distance")), "load": F.col("distance") * F.col("power"), "accel": F.col("accel_low") + F.col("accel_high")})


#: name -> (metric, first row, last row, "sum", "mean" or "std"), rows counted from the current one.
Specs = dict[str, tuple[str, int, int, str]]


def row_windows(days: DataFrame, specs: Specs) -> DataFrame:
    """Sums, means and population deviations over windows of a player's rows (not days), all in one pass.

    Rows go by player and day through a task as a stream that keeps the last rows of the running player, as many as the
    longest window reaches back. Nulls do not count; a window without values is null, its sum too.
    """
    metrics = sorted({m for m, *_ in specs.values()})
    back = max([-first for _, first, _, _ in specs.values()] or [0])
    names, n = days.columns, len(days.columns)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema], *[f"`{c}` double" for c in specs]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_player = np.zeros((len(metrics), 0)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            players = batch.column(n).to_numpy()
            if held_player != players[0]:
                held = held[:, :0]
            x = np.concatenate([held, [batch.column(n + 1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(metrics))]], axis=1)
            kept = held.shape[1]
            new = np.flatnonzero(players[1:] != players[:-1]) + 1 + kept
            begins = np.concatenate(([0], new))
            start = np.repeat(begins, np.diff(np.append(begins, x.shape[1])))
            columns = _windowed(x, start, kept, {m: k for k, m in enumerate(metrics)}, specs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, from_pandas=True) for c in columns]], names=[*names, *specs])
            last = int(begins[-1])
            held, held_player = x[:, max(last, x.shape[1] - back) :], players[-1]

    read = [F.col("player_id").alias("__p"), *[F.col(m).cast("double").alias(f"__{k}") for k, m in enumerate(metrics)]]
    return days.select(*names, *read).repartition("__p").sortWithinPartitions("__p", "day").mapInArrow(fold, schema)


def _windowed(x: np.ndarray, start: np.ndarray, kept: int, place: dict[str, int], specs: Specs) -> list[np.ndarray]:
    """The columns of specs for the rows behind the first `kept` ones; start: the first row of each row's player."""
    total, done, out = x.shape[1], {}, []
    at = np.arange(kept, total)
    for metric, first, last, kind in specs.values():
        key = (metric, first, last)
        if key not in done:
            rows = at[:, None] + np.arange(first, last + 1)[None]
            v = x[place[metric]][np.maximum(rows, 0)]
            there = (rows >= start[at][:, None]) & ~np.isnan(v)
            v = np.where(there, v, 0.0)
            # Added from the oldest row on, so that windows over the same rows have the same sum whatever their length.
            count, sums = there.sum(1), np.cumsum(v, axis=1)[:, -1]
            mean = np.where(count > 0, sums / np.maximum(count, 1), np.nan)
            done[key] = {"sum": np.where(count > 0, sums, np.nan), "mean": mean, "v": v, "there": there, "count": count}
        d = done[key]
        if kind == "std" and "std" not in d:
            off = np.where(d["there"], d["v"] - np.where(d["count"] > 0, d["mean"], 0.0)[:, None], 0.0)
            d["std"] = np.where(d["count"] > 0, np.sqrt((off**2).sum(1) / np.maximum(d["count"], 1)), np.nan)
        out.append(d[kind])
    return out


def _rolling_specs(windows, metrics) -> Specs:
    return {f"{m}_{kind}_{n}": (m, 1 - n, 0, kind) for n in windows for m in metrics for kind in ("sum", "mean", "std")}


def _with_cv(rows: DataFrame, windows, metrics) -> DataFrame:
    return rows.withColumns({f"{m}_cv_{n}": safe_div(F.col(f"{m}_std_{n}"), F.col(f"{m}_mean_{n}")) for n in windows for m in metrics})


def rolling(days: DataFrame, windows=WINDOWS, metrics=METRICS) -> DataFrame:
    """Sum, mean, population std and cv over the last n rows (not days) of each player."""
    return _with_cv(row_windows(days, _rolling_specs(windows, metrics)), windows, metrics)


_LOAD = {f"__{kind}_{n}": ("load", 1 - n, 0, kind) for n in (7, 14) for kind in ("sum", "mean", "std")} | {"__before": ("load", -13, -7, "sum")}
_ACUTE = {f"__{m}_{n}": (m, 1 - n, 0, "mean") for m in AC_METRICS for n in sorted({n for pair in AC_WINDOWS for n in pair})}


def _ratios(rows: DataFrame) -> DataFrame:
    monotony = {n: F.when(F.col(f"__std_{n}") > 1e-9, F.col(f"__mean_{n}") / F.col(f"__std_{n}")).otherwise(0.0) for n in (7, 14)}
    week, last = F.col("__sum_7"), F.coalesce("__before", F.lit(0.0))
    out = {"monotony": monotony[7], "strain": week * monotony[7], "monotony_14": monotony[14], "strain_14": F.col("__sum_14") * monotony[14], "wow_delta": week - last, "wow_ratio": safe_div(week, last)}
    out |= {f"ac_{m}" + ("" if (a, b) == (7, 28) else f"_{a}_{b}"): safe_div(F.col(f"__{m}_{a}"), F.col(f"__{m}_{b}")) for m in AC_METRICS for a, b in AC_WINDOWS}
    gap = F.coalesce(F.col("day") - F.lag("day").over(by_player()), F.lit(0))
    return rows.withColumns(out).drop(*_LOAD, *_ACUTE).withColumn("gap", gap).withColumn("recovered", F.col("gap") >= 2)


def monotony_and_ratios(days: DataFrame) -> DataFrame:
    """Monotony and strain of 7 and 14 rows, week over week, acute to chronic ratios and days since the previous session."""
    return _ratios(row_windows(days, _LOAD | _ACUTE))


def rolling_and_ratios(days: DataFrame, windows=WINDOWS, metrics=METRICS) -> DataFrame:
    """Both of the above in one pass."""
    return _with_cv(_ratios(row_windows(days, _rolling_specs(windows, metrics) | _LOAD | _ACUTE)), windows, metrics)


def ewma(days: DataFrame, metrics=AC_METRICS, spans=SPANS) -> DataFrame:
    """Exponential means by span, begun with a player's first value, and the ratios of the first span to the last.

    Rows go by player and day through a task as a stream that keeps only the last means, whatever a player's history.
    """
    names = [f"{m}_ewma_{n}" for m in metrics for n in spans]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema], *[f"{n} double" for n in names]])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, state = None, {}
        for frame in frames:
            out = {n: [] for n in names}
            for p, mine in frame.groupby("player_id", sort=False):
                state = state if p == player else {}
                player = p
                for m in metrics:
                    x = mine[m].fillna(0.0)
                    for n in spans:
                        key = f"{m}_ewma_{n}"
                        past = [state[key]] if key in state else []
                        y = pd.Series([*past, *x]).ewm(alpha=2.0 / (n + 1.0), adjust=False).mean()[len(past) :]
                        state[key] = y.iloc[-1]
                        out[key].append(y)
            yield frame.assign(**{n: pd.concat(v).to_numpy() if v else [] for n, v in out.items()})

    folded = days.repartition("player_id").sortWithinPartitions("player_id", "day").mapInPandas(fold, schema)
    return folded.withColumns({f"ac_{m}_ewma": safe_div(F.col(f"{m}_ewma_{spans[0]}"), F.col(f"{m}_ewma_{spans[-1]}")) for m in metrics})


def personal_z(days: DataFrame, metrics=Z_METRICS, least: int = 5) -> DataFrame:
    """z and ratio against the player's earlier rows, once there are five; else 0 and 1."""
    w, out = by_player().rowsBetween(Window.unboundedPreceding, -1), {}
    for m in metrics:
        n, mean, std = F.count(m).over(w), F.avg(m).over(w), F.stddev_pop(m).over(w)
        out[f"{m}_z"] = F.when((n >= least) & (std > 1e-9), (F.col(m) - mean) / std).otherwise(0.0)
        out[f"{m}_ratio"] = F.when((n >= least) & (mean != 0), F.col(m) / mean).otherwise(1.0)
    return days.withColumns(out)


def form_proxy() -> Column:
    """The weights of the four terms."""
    return 0.5 * F.col("per_min") + 0.25 * F.col("high_share") + 2.0 * F.col("power") + 20.0 * F.col("sprints")


def targets(days: DataFrame, value: str = "form") -> DataFrame:
    """Trailing mean over 14 days (15 dates) and the means over the next 7 and 14 days."""
    w = lambda a, b: by_player().rangeBetween(a, b)
    return days.withColumns({"ma14": F.avg(value).over(w(-14, 0)), "next7": F.avg(value).over(w(1, 7)), "next14": F.avg(value).over(w(1, 14))})


def scaled_by(days: DataFrame, value: str, key: str = "role") -> DataFrame:
    """Min-max to 0-100 within a group, 50 where flat. Minima and maxima are aggregated and joined, as groups are large."""
    span = days.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    return days.join(span, key).withColumn(f"{value}_score", F.when(hi > lo, 100 * (F.col(value) - lo) / (hi - lo)).otherwise(50.0)).drop("__lo", "__hi")


def split_by_day(days: DataFrame, split_day: int) -> DataFrame:
    """From targets(): the rows with a target, those up to split_day to train, the rest to test."""
    return days.where(F.col("next7").isNotNull()).withColumn("split", F.when(F.col("day") <= split_day, "train").otherwise("test"))


def personal_bands(days: DataFrame, fields=AC_FIELDS, least: int = 8) -> DataFrame:
    """player_id and for each field its quartiles over the player's positive values if there are eight, else over
    everyone's: <field>_low, _mid, _high, _source."""
    q, at = F.array(*map(F.lit, (0.25, 0.5, 0.75))), (0.25, 0.5, 0.75)
    positive = lambda f: F.when(F.col(f) > 0, F.col(f))
    bands = days.groupBy("player_id").agg(*[x for f in fields for x in (F.count(positive(f)).alias(f"__n_{f}"), F.percentile(positive(f), q).alias(f"__own_{f}"))])
    for f in fields:
        bands = bands.join(F.broadcast(ranks.quantiles(days.where(F.col(f) > 0), f, at).withColumnRenamed("q", f"__all_{f}")), how="left")  # one row
    own = lambda f: F.col(f"__n_{f}") >= least
    use = lambda f: F.when(own(f), F.col(f"__own_{f}")).otherwise(F.col(f"__all_{f}"))
    return bands.select("player_id", *[c for f in fields for c in (*[F.get(use(f), F.lit(k)).alias(f"{f}_{name}") for k, name in enumerate(("low", "mid", "high"))], F.when(own(f), "personal").otherwise("global_fallback").alias(f"{f}_source"))])


def zones(days: DataFrame, fields=AC_FIELDS) -> DataFrame:
    """For each field whether it is below, inside or above the player's band and by how much; the combined status, where
    above beats below, and the mean excess."""
    out = days.join(personal_bands(days, fields), "player_id")
    for f in fields:
        v, lo, hi = F.col(f), F.col(f"{f}_low"), F.col(f"{f}_high")
        status = F.when(v <= 0, "insufficient_data").when(v < lo, "below").when(v > hi, "above").otherwise("optimal")
        excess = F.when(v <= 0, 0.0).when(v < lo, safe_div(lo - v, lo)).when(v > hi, safe_div(v - hi, hi)).otherwise(0.0)
        out = out.withColumns({f"{f}_status": status, f"{f}_excess": excess})
    has = lambda s: F.array_contains(F.array(*[F.col(f"{f}_status") for f in fields]), s)
    every = F.forall(F.array(*[F.col(f"{f}_status") for f in fields]), lambda s: s == "optimal")
    combined = F.when(every, "optimal").when(has("above"), "above_optimal").when(has("below"), "below_optimal").otherwise("insufficient_data")
    return out.withColumns({"status": combined, "excess": sum((F.col(f"{f}_excess") for f in fields), F.lit(0.0)) / len(fields)})


def _joined(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def static_rules(days: DataFrame) -> DataFrame:
    """From zones(): the reasons of a risk (three at most), and the score, level and reasons of the static rules."""
    gap, mono, z = F.coalesce("gap", F.lit(0)), F.col("monotony"), F.col("load_z")
    # The thresholds of the rules and their names.
    reasons = _joined((F.col("status") == "above_optimal", "ac_above_optimal_zone"), (mono >= 2.0, "high_monotony"), (z >= 1.5, "load_spike_vs_player_baseline"), (gap <= 0, "consecutive_day_load"))
    static = _joined(
        (mono >= 2.0, "monotony>=2.0"), (F.col("ac_load") >= 1.25, "ac_load_7_28>=1.25"), (F.col("ac_distance") >= 1.25, "ac_distance_7_28>=1.25"),
        (F.col("ac_high_acc") >= 1.25, "ac_high_int_7_28>=1.25"), ((gap <= 0) & (z >= 1.0), "consecutive_day_load_and_spike"),
    )
    out = days.withColumns({"__r": reasons, "__s": static})
    text = lambda c, none: F.when(F.size(c) == 0, none).otherwise(F.array_join(F.slice(c, 1, 3) if c == "__r" else F.col(c), " | "))
    score = F.size("__s")
    level = F.when(score >= 2, "high").when(score == 1, "medium").otherwise("low")
    return out.withColumns({"reasons": text("__r", "anomaly_pattern_detected"), "static_score": score, "static_level": level, "static_reasons": text("__s", "none")}).drop("__r", "__s")


def fatigue(days: DataFrame) -> DataFrame:
    """static_rules() and the risk from an anomaly column and the excess over the zones, with its level and flag."""
    risk = clamp(0.65 * F.col("anomaly") + 0.35 * F.col("excess"))
    return static_rules(days).withColumn("risk", risk).withColumns({"risk_level": band(F.col("risk"), (0.62, "high"), (0.38, "medium"), default="low"), "overload": F.col("risk") >= 0.62})


def daily_kpi(days: DataFrame) -> DataFrame:
    """From fatigue() with form_score: who is a candidate for more or for less load, and the ranks of each day."""
    under = (F.col("status") == "below_optimal") & (F.col("risk_level") == "low")
    over = F.col("overload") | (F.col("status") == "above_optimal")
    return ranked(days.withColumns({"underload_candidate": under, "overload_candidate": over}), "form_score", "risk")


def profiles(days: DataFrame, features=PROFILE) -> DataFrame:
    """The mean of every feature and the number of days of each player."""
    return days.groupBy("player_id").agg(F.count(F.lit(1)).alias("days"), *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in features])


def ranked(days: DataFrame, *values: str, key: str = "day") -> DataFrame:
    """Unique ranks within a date, the largest first, ties by player."""
    return days.withColumns({f"{v}_rank": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(v, 9)), "player_id")) for v in values})


def weekly(days: DataFrame) -> DataFrame:
    """The last day of each player and ISO week."""
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int"))
    d = days.withColumns({"iso_year": F.extract(F.lit("YEAROFWEEK"), date).cast("bigint"), "iso_week": F.weekofyear(date).cast("bigint")})
    w = Window.partitionBy("player_id", "iso_year", "iso_week").orderBy(F.desc("day"))
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def quality_report(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """One row: sessions, those of a known player and those without a day, player days, players, the span of days,
    repeated keys, and outliers above 1.5 times the 99th percentile of distance and duration."""
    s = sessions.agg(F.count(F.lit(1)).alias("session_rows"), F.count_if(F.col("player_id").isNotNull()).alias("mapped_rows"), F.count_if(F.col("day").isNull()).alias("missing_dates"))
    s = s.withColumn("coverage", safe_div(100.0 * F.col("mapped_rows"), F.col("session_rows")))
    keys = days.groupBy("player_id", "day").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("distance", "duration")])
    found = keys
    for c in ("distance", "duration"):
        found = found.join(F.broadcast(ranks.quantile(days, c, 0.99, f"q99_{c}")), how="left")
    over = [F.count_if(F.col(c) > 1.5 * F.col(f"q99_{c}")).alias(f"outliers_{c}") for c in ("distance", "duration")]
    r = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("days"), F.countDistinct("player_id").alias("players"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), *over)
    return s.join(F.broadcast(r))


def latest(days: DataFrame) -> DataFrame:
    """The last day of each player, all columns."""
    return days.groupBy("player_id").agg(F.max_by(F.struct(*[c for c in days.columns if c != "player_id"]), "day").alias("__last")).select("player_id", "__last.*")


def backtest(days: DataFrame, split_day: int) -> DataFrame:
    """From targets(): the absolute errors of today's form and of the 14-day mean against the next 7 days, from split_day on."""
    t = days.where((F.col("day") >= split_day) & F.col("next7").isNotNull())
    return t.withColumns({"err_last": F.abs(F.col("next7") - F.col("form")), "err_ma14": F.abs(F.col("next7") - F.col("ma14"))})


def fatigue_counts(rows: DataFrame, top: int = 10) -> DataFrame:
    """From fatigue(): how often each risk level and each reason occurs, where the bands come from, and the `top`
    players by days above their zone, ties by id."""
    count = lambda kind, of, name: of.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    player = F.col("player_id").cast("string")
    above = rows.where("status = 'above_optimal'").groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "player_id").limit(top)
    of_player = rows.groupBy("player_id").agg(*[F.max(f"{f}_source").alias(f) for f in AC_FIELDS])
    sources = of_player.select(F.explode(F.array(*AC_FIELDS)).alias("source"))
    return (
        count("level", rows, F.col("risk_level"))
        .unionByName(count("factor", rows.select(F.explode(F.split("reasons", r" \| ")).alias("r")), F.col("r")))
        .unionByName(count("source", sources, F.col("source")))
        .unionByName(above.select(F.lit("above").alias("kind"), player.alias("name"), "n"))
    )


def alert_overlap(rows: DataFrame) -> DataFrame:
    """How far the static rules and the model agree on who is at high risk: sizes and Jaccard index."""
    a, b = F.col("static_level") == "high", F.col("risk_level") == "high"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return rows.agg(n(a).alias("static_high"), n(b).alias("risk_high"), n(a & b).alias("both"), n(a | b).alias("either")).withColumn("jaccard", safe_div(F.col("both").cast("double"), F.col("either")))


def with_totals(days: DataFrame, totals: DataFrame, key: str = "player_id") -> DataFrame:
    """Totals of a season beside every day of its player; 0 where a player has none."""
    columns = [c for c in totals.columns if c != key]
    return days.join(totals, key, "left").na.fill(0, columns)


def without(days: DataFrame, excluded: DataFrame, key: str = "player_id") -> DataFrame:
    """The days of players who are not excluded."""
    return days.join(excluded.select(key), key, "left_anti")


def match_context(rows: DataFrame, keys=("player_id",)) -> DataFrame:
    """The season of each player from rows of player, match and minutes with counts: sums, per 90 minutes, accuracies."""
    counts = ("goals", "assists", "xg", "xg_assist", "shots", "on_target", "passes", "accurate", "key_passes", "duels", "won")
    c = rows.groupBy(*keys).agg(F.countDistinct("match_id").alias("matches"), F.sum("minutes").alias("minutes"), *[F.sum(F.coalesce(F.col(x), F.lit(0))).cast("double").alias(x) for x in counts])
    per90 = {f"{x}_per90": safe_div(90.0 * F.col(x), F.col("minutes")) for x in ("goals", "assists", "xg", "xg_assist", "shots", "key_passes")}
    return c.withColumns(per90 | {"pass_accuracy": safe_div(100.0 * F.col("accurate"), F.col("passes")), "duel_win_rate": safe_div(100.0 * F.col("won"), F.col("duels"))})


def name_mapping(devices: DataFrame, catalog: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """Device names to players: device_name, rows, status, candidates, player_id.

    devices: rows with device_name; catalog: player_id, short_name, full_name. An override by name decides first; then
    the players of exactly this short or full name, accents, case and spaces aside; then those who share its last word.
    One candidate is a match ('matched', 'surname'), several are 'ambiguous', none is 'unmatched'.
    """
    names = devices.groupBy("device_name").agg(F.count(F.lit(1)).alias("rows")).withColumn("norm", normal_name(F.col("device_name")))
    override = devices.sparkSession.createDataFrame(list((overrides or {}).items()), "name string, override bigint").select(normal_name(F.col("name")).alias("norm"), "override").dropDuplicates(["norm"])
    full, short = normal_name(F.col("full_name")), normal_name(F.col("short_name"))
    known = catalog.select("player_id", F.explode(F.array_distinct(F.array_compact(F.array(full, short)))).alias("norm")).where("norm <> ''")
    last = lambda c: F.element_at(F.split(c, " "), -1)
    exact = known.groupBy("norm").agg(F.sort_array(F.collect_set("player_id")).alias("exact"))
    surname = catalog.select("player_id", last(full).alias("word")).where("word <> ''").groupBy("word").agg(F.sort_array(F.collect_set("player_id")).alias("by_surname"))
    # Lists of players by name take little room in Parquet and much in memory, so they are not left to be broadcast.
    m = names.join(F.broadcast(override), "norm", "left").join(exact.hint("merge"), "norm", "left").withColumn("word", last(F.col("norm"))).join(surname.hint("merge"), "word", "left")
    candidates = F.when(F.col("override").isNotNull(), F.array("override")).otherwise(F.coalesce("exact", "by_surname", F.array().cast("array<bigint>")))
    m = m.withColumn("candidates", candidates)
    one = F.size("candidates") == 1
    status = F.when(F.col("override").isNotNull(), "override").when(one & F.col("exact").isNotNull(), "matched").when(one, "surname").when(F.size("candidates") > 1, "ambiguous").otherwise("unmatched")
    return m.select("device_name", "rows", status.alias("status"), "candidates", F.when(one, F.get("candidates", F.lit(0))).alias("player_id"))
