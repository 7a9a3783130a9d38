"""The rules of league comparison by hand: one small case for each kind of rule, with ties, zeros and missing values."""

from pyspark.sql import functions as F

from pitchflow.functions import ranks, scalar
from pitchflow.operators import baseline as B

COMPARED = "match_id bigint, team_id bigint, metric string, value double, above double, mean double, std double, direction string, metric_order int, z double, percentile double, status string, is_weakness boolean"


def compared(spark, **metrics):
    """metric=(value, above, mean, z, percentile, status) of one match and team."""
    rows = [(1, 2, m, v, a, mean, 1.0, B.RATIOS[m][2], list(B.RATIOS).index(m), z, p, s, s in ("weak", "very_weak")) for m, (v, a, mean, z, p, s) in metrics.items()]
    return spark.createDataFrame(rows, COMPARED)


def test_severities(spark):
    c = compared(
        spark,
        progressivePassSuccessRate=(0.0, 0.0, 0.5, -1.75, 50.0, "very_weak"),  # (1.75 - 1) / 1.5
        finalThirdPassSuccessRate=(0.0, 0.0, 0.5, -1.0, 50.0, "weak"),  # not below -1
        progressivePassShare=(0.0, 0.0, 0.5, 0.0, 5.0, "normal"),  # (25 - 5) / 25
        lossRate=(0.0, 0.0, 0.5, 0.0, 95.0, "normal"),  # (95 - 75) / 25
        ownHalfLossRate=(0.0, 0.0, 0.5, 0.0, 75.0, "warning"),  # not above 75
        dangerousLossRate=(0.3, 2.0, 0.2, 0.0, 50.0, "normal"),  # half of 0.5 and half of 2 / 3
        xgPerShot=(0.0, 0.0, 0.5, -1.3, 50.0, "weak"),  # 0.2, and 0.15 as shots miss the target
        shotOnTargetRate=(0.0, 0.0, 0.5, -0.6, 50.0, "normal"),
        boxEfficiency=(0.0, 0.0, 0.5, -9.0, 50.0, "very_weak"),  # held to 1
    )
    got = {r.metric: r for r in B.insights(c, 15).collect()}
    want = {"progressivePassSuccessRate": 0.5, "progressivePassShare": 0.8, "lossRate": 0.8, "dangerousLossRate": 0.25 + 1 / 3, "xgPerShot": 0.35, "boxEfficiency": 1.0}
    assert {m: round(r.severity, 9) for m, r in got.items()} == {m: round(s, 9) for m, s in want.items()}
    assert [m for m, r in sorted(got.items(), key=lambda x: x[1].rank)] == ["boxEfficiency", "progressivePassShare", "lossRate", "dangerousLossRate", "progressivePassSuccessRate", "xgPerShot"]
    assert got["boxEfficiency"].confidence == 1.0 and got["xgPerShot"].label == "low" and got["progressivePassSuccessRate"].label == "medium" and got["lossRate"].label == "high"
    r = B.weakness_report(c).first()
    assert [round(r[b], 6) for b in B.BUCKETS] == [0.8, 0.8, 1.0, 0.0, 0.0]
    assert round(r.overall, 6) == 0.75 and r.risk == "medium-high"  # 0.75 of the worst beats 0.24 + 0.2 + 0.2


def test_a_status_counts_where_no_rule_speaks(spark):
    c = compared(spark, passSuccessRate=(0.0, 0.0, 0.5, -1.6, 50.0, "very_weak"), offensiveDuelSuccessRate=(0.0, 0.0, 0.5, -0.8, 50.0, "weak"), highRecoveryRate=(0.0, 0.0, 0.5, -0.5, 25.0, "warning"))
    r = B.weakness_report(c).first()
    assert [r[b] for b in B.BUCKETS] == [0.40, 0.0, 0.0, 0.16, 0.22]
    assert round(r.overall, 6) == round(0.3 * 0.4 + 0.15 * 0.16 + 0.1 * 0.22, 6) and r.risk == "low"


def test_ratios_of_nothing(spark):
    totals = sorted({n for n, _, _ in B.RATIOS.values()} | {t for _, d, _ in B.RATIOS.values() for t in d})
    row = {t: 0.0 for t in totals} | {"losses": 3.0, "passes": None, "dribbles": 5.0, "receivedPass": 1.0, "shots": 2.0, "xgShot": float("nan")}
    rows = spark.createDataFrame([(1, 1, *row.values())], "match_id bigint, team_id bigint, " + ", ".join(f"{t} double" for t in row))
    r = B.ratios(rows).first()
    assert (r.lossRate, r.passSuccessRate, r.ownHalfLossRate, r.xgPerShot) == (0.5, 0.0, 0.0, 0.0)
    report = {x.metric: x for x in B.ratio_report(rows).collect()}
    assert report["passSuccessRate"].zero_denominators == 1 and report["xgPerShot"].not_finite == 1 and report["lossRate"].zero_denominators == 0


def test_names_without_accents(spark):
    names = spark.createDataFrame([(" Ștefan  ĂRDEI",), ("Éric\tÑandú",), ("A\u0308b",), ("Łódź",), (None,)], "n string")
    assert [r[0] for r in names.select(scalar.normal_name(F.col("n"))).collect()] == ["stefan ardei", "eric nandu", "ab", "łodz", None]


def test_quantiles_and_sums_over_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [*np.round(rng.normal(size=500), 1).tolist(), None]
    df = spark.createDataFrame([(str(k % 2), v) for k, v in enumerate(values)], "g string, v double")
    real = np.array(values[:-1])
    got = {r.g: r.q for r in ranks.quantiles(df, "v", (0.0, 0.1, 0.5, 0.99, 1.0), ("g",)).collect()}
    for g in "01":
        np.testing.assert_allclose(got[g], np.quantile(real[int(g) :: 2], [0, 0.1, 0.5, 0.99, 1]))
    counted = ranks.counts(df, "v")
    down = {r.v: (r.before_n, r.total_n) for r in ranks.cumulated(counted, "v", "n", descending=True).collect()}
    assert all(b == (real > v).sum() and t == 500 for v, (b, t) in down.items())
    assert ranks.quantile(df.limit(0), "v", 0.5).collect() in ([], [(None,)])


def test_shot_xg_is_added_in_the_order_of_the_files(spark, tmp_path):
    """One match over four files that are read in pieces: its sum is that of one thread, to the last bit."""
    import random

    from pitchflow.sources.adapters import team_matches

    rng, rows, want = random.Random(3), [], [0.0, 0.0]
    for k in range(240):
        odd, x = rng.randrange(2), rng.randrange(1, 11) / 100
        rows.append((7, k, 1, odd, 45.0, x, 0.01, "N", "O"))
        want[odd] += x
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    folder = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), columns).write.parquet(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.team_id: r.xgShot for r in team_matches(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {0: want[0], 1: want[1]}
