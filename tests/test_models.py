"""Models: scores of every action, selection, future form, clusters, the isolation forest against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import clusters as groups
from pitchflow.operators import decision, forest, load, models, net
from pitchflow.plans import load as load_plans
from pitchflow.plans import retrieval
from pitchflow.sources.adapters import actions

DATA = "/root/testdata/sf0.001"


def test_decision_model_scores_every_action(spark):
    want = actions(spark, DATA).where(F.col("event_type").isin(*decision.ACTIONS))
    out = retrieval._decision_model(spark, DATA, trees=10, depth=4).collect()
    assert sorted(r.event_id for r in out) == sorted(r.event_id for r in want.collect())
    assert all(0 <= p <= 1 for r in out for p in (r.p_pass, r.p_shot, r.p_carry, r.value))
    assert all(r.value == r[f"p_{r.event_type}"] and r.best_value == max(r.p_pass, r.p_shot, r.p_carry) for r in out)
    # the low quarter is that of all actions
    limit = np.quantile([r.value for r in out], 0.25)
    assert all(r.low == (r.value <= limit) for r in out if abs(r.value - limit) > 1e-12)


def matrix(spark, n=240):
    """Rows whose label is their x above 50, in four folds."""
    rng = random.Random(3)
    rows = [(i, i % 4, rng.choice("ab"), float(rng.randrange(101))) for i in range(n)]
    return spark.createDataFrame(rows, "event_id bigint, fold bigint, kind string, x double").withColumn("label", (F.col("x") > 50).cast("int"))


def test_candidates_are_judged_by_fold_and_one_is_selected(spark):
    rows = matrix(spark)
    scorers = {
        "forest": lambda r: models.forest_scores(r, ("kind",), ("x",), trees=5, depth=3),
        "blind": lambda r: models.forest_scores(r, ("kind",), ("event_id",), trees=5, depth=3),
        "net": lambda r: models.net_scores(r, ("kind",), ("x",), hidden=(8,), rate=0.02, epochs=60),
    }
    got = {r.model: r for r in models.candidates(rows, scorers).collect()}
    assert all(r.folds == 4 for r in got.values()) and got["forest"].mean_auc > 0.95 and got["net"].mean_auc > 0.9 > got["blind"].mean_auc
    assert [m for m, r in got.items() if r.selected] == [max(got, key=lambda m: (got[m].mean_auc, got[m].mean_average_precision, -got[m].mean_brier))]
    none = models.candidates(rows.where("fold = 0"), scorers).where("model = 'forest'").first()
    assert none.folds == 0 and none.mean_auc is None


def test_bootstrap_counts_and_weights_by_hand():
    rows = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    counts = forest.poisson_counts(rows, 3)
    share = [np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6]
    assert all(abs((counts == k).mean() - p) < 0.015 for k, p in enumerate(share)) and counts.max() < 12
    assert (forest.poisson_counts(rows[::-1], 3)[::-1] == counts).all() and (forest.poisson_counts(rows, 4) != counts).mean() > 0.4
    # five draws of class 0 and three of class 1: each class has half of eight
    weights = forest.balanced_weights(np.array([2, 3, 0, 1, 2]), np.array([0, 0, 1, 1, 1]))
    assert np.allclose(weights, [2 * 8 / 10, 3 * 8 / 10, 0, 8 / 6, 2 * 8 / 6])
    assert np.allclose(forest.balanced_weights(np.array([1, 1]), np.array([1, 1])), [1, 1])


def plain_tree(x, y, w, depth, min_split, min_leaf):
    """The best split of all features and thresholds, again and again; ties to the first feature and the lowest threshold."""
    total = w.sum()
    value = (w * y).sum() / total
    if depth == 0 or len(y) < min_split or value in (0, 1):
        return value
    best = (2 * total * value * (1 - value) - 1e-12, None)
    for f in range(x.shape[1]):
        for at in sorted(set(x[:, f]))[:-1]:
            low = x[:, f] <= at
            if min(low.sum(), (~low).sum()) >= min_leaf:
                cost = sum(2 * (w[s] * y[s]).sum() * (w[s] * (1 - y[s])).sum() / w[s].sum() for s in (low, ~low))
                if cost < best[0] - 1e-9:
                    best = (cost, (f, at, low))
    if best[1] is None:
        return value
    f, at, low = best[1]
    return f, at, plain_tree(x[low], y[low], w[low], depth - 1, min_split, min_leaf), plain_tree(x[~low], y[~low], w[~low], depth - 1, min_split, min_leaf)


@pytest.mark.parametrize(("min_split", "min_leaf"), [(2, 1), (12, 4), (30, 10)])
def test_a_tree_by_brute_force(min_split, min_leaf, monkeypatch):
    class InOrder:  # all features at every node, in order
        def permutation(self, n):
            return np.arange(n)

    monkeypatch.setattr(forest.np, "sqrt", lambda n: n)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 3)), 1).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (rng.random(150) < 0.2)).astype(int)
    w = rng.integers(1, 4, 150).astype(float)
    tree = {k: np.array(v) for k, v in forest.grow_tree(x, y, w, InOrder(), 5, min_split, min_leaf).items()}
    plain = plain_tree(x, y, w, 5, min_split, min_leaf)

    def plain_value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    assert np.allclose(forest.tree_scores(tree, x), [plain_value(plain, r) for r in x])


def test_forests_of_all_folds_are_those_of_each(spark):
    rows = matrix(spark, 120).withColumn("kind", F.when(F.col("event_id") % 9 != 0, F.col("kind")))
    encoding = forest.Encoding.of(rows, ("kind",), ("x",))
    assert encoding.values == {"kind": ["a", "b", "unknown"]}
    both = forest.collected(forest.fit_forests(rows.repartition(7), encoding, ("event_id",), [0, 2], trees=3, depth=4))
    again = forest.collected(forest.fit_forests(rows.coalesce(1), encoding, ("event_id",), [0, 2], trees=3, depth=4))
    assert sorted(both) == [0, 2] and all(len(t) == 3 for t in both.values())
    assert all((a[k] == b[k]).all() for m in both for a, b in zip(both[m], again[m], strict=True) for k in a)
    got = forest.scored(rows.where("fold = 2"), encoding, both, "fold", "kind", ("a", "c")).collect()
    assert all(0 <= r.p <= 1 and (r.kind != "a" or r.p == r.p_a) for r in got) and len(got) == 30
    assert forest.collected(forest.fit_forests(rows.limit(0), encoding, ("event_id",), [None], fold=None, trees=2)) == {}


def test_gradient_of_the_net_by_differences():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 5)), (rng.random(40) < 0.4).astype(int)
    w = net.first_weights([5, 6, 4, 1], 1)
    loss, grad = net.gradient(w, x, y)
    flat, found = net._flat(w), net._flat(grad)
    p = net.probabilities(w, x)
    assert abs(loss + np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))) < 1e-9
    for i in range(0, len(flat), 3):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        ends = [net.gradient(net._shaped(flat + s, w), x, y)[0] for s in (step, -step)]
        assert abs((ends[0] - ends[1]) / 2e-6 - found[i]) < 1e-4
    # the first step of Adam is the rate against the sign of the gradient
    assert np.allclose(net.Adam(0.1, 3).step(np.zeros(3), np.array([4.0, -2.0, 0.5])), [-0.1, 0.1, -0.1], atol=1e-6)


def test_the_net_learns_and_stops_early(spark):
    rows = matrix(spark, 400)
    encoding = forest.Encoding.of(rows, ("kind",), ("x",))
    fitted = net.fit(rows, encoding, ("event_id",), [0, 1], hidden=(16, 8), batch=200, epochs=80, patience=8, rate=0.02)
    for m in (0, 1):
        loss = fitted.losses[m]
        assert loss[-1] < loss[0] * 0.5 and np.mean(np.diff(loss[:10]) < 0) > 0.7 and len(loss) < 80
        assert max(fitted.accuracies[m]) > 0.95
    # a pass over blocks is the plain gradient of all rows of other folds
    path = net._blocks(rows, encoding, ("event_id",), "label", "fold", 2, 0.15)
    table = spark.read.schema("fold int, x binary, y binary, step int").parquet(path).repartition(20).drop("step")
    got = net._pass(table, {0: fitted.weights[0]}, fitted.scales, encoding.width, True)[0]
    local = rows.where("fold <> 0").orderBy("event_id").collect()
    x = np.array([[r.kind == "a", r.kind == "b", r.x] for r in local], float)
    x[:, 2] = (x[:, 2] - x[:, 2].mean()) / x[:, 2].std()
    loss, grad = net.gradient(fitted.weights[0], x, np.array([r.label for r in local]))
    assert got[0] == len(local) and abs(got[1] - loss) < 1e-4 and np.allclose(got[3], net._flat(grad), atol=1e-3)


def test_an_epoch_of_the_net_is_one_job_over_shards(spark, monkeypatch):
    rows = matrix(spark, 600)
    encoding = forest.Encoding.of(rows, ("kind",), ("x",))
    fit = lambda: net.fit(rows, encoding, ("event_id",), [0, 1], hidden=(8,), batch=20, epochs=15, patience=20, rate=0.02)
    # one shard: plain Adam over all mini-batches, as worked out here from the blocks
    path = net._blocks(rows, encoding, ("event_id",), "label", "fold", 26, 0.15)
    blocks = [r for r in spark.read.parquet(path).collect() if r.shard == 0]
    whole, w, order = fit(), net.first_weights([3, 8, 1], 42 + 2), np.random.default_rng(42)
    mine = [r for r in blocks if r.fold != 1]
    x, y, s = (np.concatenate([np.frombuffer(r[c], of) for r in mine]) for c, of in (("x", np.float32), ("y", np.int8), ("s", np.int32)))
    adam = net.Adam(0.02, len(net._flat(w)))
    x = net._scaled(x.reshape(-1, 3), whole.scales[1])
    there = np.unique(s)
    assert len(there) == 26
    total = 0.0
    for k in order.permutation(26):
        loss, grad = net.gradient(w, x[s == k], y[s == k])
        penalty = net._flat([(a, np.zeros_like(b)) for a, b in w])
        total += loss + 5e-5 * float(penalty @ penalty)
        w = net._shaped(adam.step(net._flat(w), (net._flat(grad) + 1e-4 * penalty) / (s == k).sum()), w)
    assert abs(whole.losses[1][0] - total / len(y)) < 1e-9
    # many shards: the same number of jobs, and a net that learns as well
    jobs = []
    summed = net._summed
    monkeypatch.setattr(net, "_summed", lambda *a: jobs.append(1) or summed(*a))
    monkeypatch.setattr(net, "SHARD_ROWS", 100)
    parts = fit()
    assert len(jobs) == 2 * 15 and all(parts.losses[m][-1] < 0.6 * parts.losses[m][0] and max(parts.accuracies[m]) > 0.9 for m in (0, 1))
    assert any(abs(a - b) > 1e-6 for a, b in zip(parts.losses[1], whole.losses[1], strict=True))


def test_future_form(spark):
    rng = random.Random(4)
    rows = [(p, d, float(rng.randrange(100)), 0.0) for p in range(5) for d in range(30)]
    df = spark.createDataFrame(rows, "player_id bigint, day bigint, x double, noise double").withColumn("y", 2 * F.col("x")).withColumn("ma", F.lit(1.0))
    out, importance = models.future_form(df, ("x", "noise"), "y", 20, "ma", trees=20, depth=6)
    assert out.count() == 5 * 9 and {r.feature: r.importance for r in importance.collect()}["x"] > 0.99
    by = {r.model: r for r in models.errors(out, "y", forest="prediction", constant="ma").collect()}
    assert by["forest"].mae < 8 < by["constant"].mae and by["forest"].r2 > 0.9 and by["forest"].rmse >= by["forest"].mae
    few, importance = models.future_form(df.where("player_id = 0"), ("x", "noise"), "y", 20, "ma")
    assert {r.prediction for r in few.collect()} == {1.0} and {r.importance for r in importance.collect()} == {0.0}


def test_clusters_and_their_names(spark):
    rng = random.Random(5)
    centres = {"high-volume runner": (9000, 5, 200, 0.1), "explosive short-burst": (4000, 20, 900, 0.4), "low-volume high-intensity": (4200, 4, 100, 0.1)}
    rows = [(i, name, *[c * (1 + rng.gauss(0, 0.01)) for c in centre]) for i, (name, centre) in enumerate((n, c) for n, c in centres.items() for _ in range(20))]
    df = spark.createDataFrame(rows, "player_id bigint, want string, distance double, high_share double, high_acc double, sprints double")
    features = ("distance", "high_share", "high_acc", "sprints")
    out, fit, variance = groups.player_clusters(df, features, starts=10)
    out = out.collect()
    assert all(r.profile == r.want for r in out) and len({r.cluster for r in out}) == 3
    # silhouette, components and their shares against plain ones
    x = np.array([r[2:6] for r in rows], float)
    z = (x - x.mean(0)) / x.std(0)
    names = np.array([r[1] for r in rows])
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    own = np.array([far[i, names == names[i]].sum() / ((names == names[i]).sum() - 1) for i in range(len(z))])
    other = np.array([min(far[i, names == n].mean() for n in centres if n != names[i]) for i in range(len(z))])
    assert abs(fit - np.mean((other - own) / np.maximum(own, other))) < 1e-9
    singular, vectors = np.linalg.eigh(z.T @ z)
    assert np.allclose(sorted(variance, reverse=True), singular[::-1][:2] / singular.sum())
    shown = {r.player_id: abs(r.pca_1) for r in out}
    assert np.allclose([shown[i] for i in range(len(z))], np.abs(z @ vectors[:, -1]))


def test_few_players_and_plain_k_means(spark):
    rng = random.Random(6)
    rows = [(i, rng.gauss(5 * (i % 2), 1), rng.gauss(0, 1)) for i in range(8)]
    df = spark.createDataFrame(rows, "player_id bigint, distance double, high_share double").withColumns({"high_acc": F.lit(1.0), "sprints": F.lit(None).cast("double")})
    features = ("distance", "high_share", "high_acc", "sprints")
    assert len({r.cluster for r in groups.player_clusters(df, features, 5)[0].collect()}) == 2
    few, fit, variance = groups.player_clusters(df.limit(2), features)
    assert {(r.profile, r.pca_1) for r in few.collect()} == {("insufficient_population", 0.0)} and (fit, variance) == (0.0, [0.0, 0.0])
    assert {r.cluster for r in groups.clusters(df.limit(2), ("distance",), 5).collect()} == {0}
    # the centres are the means of their rows, and no start of a plain k-means is better
    points = spark.createDataFrame([([rng.gauss(3 * (i % 4), 1), rng.gauss(0, 1)],) for i in range(200)], "x array<double>")
    centres = groups.k_means(points, "x", 4, 12)
    x = np.array([r[0] for r in points.collect()])
    at, cost = groups.nearest(x, centres[None])
    assert np.allclose(centres, [x[at[:, 0] == c].mean(0) for c in range(4)])
    for seed in range(12):
        c = groups._first_centres(x, 4, 100 + seed)
        for _ in range(100):
            near = groups.nearest(x, c[None])[0][:, 0]
            c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(4)])
        assert cost.sum() <= groups.nearest(x, c[None])[1].sum() * 1.02
    counted = groups.cluster_rows(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "cluster int, a double"), ("a",)).collect()
    assert sorted((r.cluster, r["count"], r.a) for r in counted) == [(0, 2, 2.0), (1, 1, 5.0)]
    z = groups.standardised(spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double"), ("a", "b")).collect()
    assert [(r.z_a, r.z_b) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]  # population std


def test_team_profiles(spark):
    names = ("lossRate", "progressivePassSuccessRate", "counterpressingRate", "xgPerShot", "passSuccessRate")
    clusters = {0: (0.3, 0.5, 0.3, 0.1, 0.8), 1: (0.1, 0.7, 0.3, 0.1, 0.8), 2: (0.2, 0.6, 0.5, 0.1, 0.8)}
    df = spark.createDataFrame([(k, *v) for k, v in clusters.items()], "cluster bigint, " + ", ".join(f"{n} double" for n in names))
    got = {r.cluster: (r.profile, r.explanation) for r in groups.named_team_clusters(df).collect()}
    assert got[0][0] == "high_loss_low_control" and got[1][0] == "balanced_control" and got[2][0] == "strong_pressing_compact"
    assert got[2][1] == ["stronger than average counterpressing"] and "lower than average progressive passing success" in got[0][1]


def plain_score(trees, x, scale):
    """Isolation score of one row, tree by tree."""

    def depth(tree, at=0):
        if not isinstance(tree, tuple):
            return at + float(forest.mean_path(tree))
        f, cut, left, right = tree
        return depth(left if x[f] < cut else right, at + 1)

    return 2.0 ** (-sum(map(depth, trees)) / len(trees) / scale)


def test_isolation_forest_draws_each_tree_from_the_whole_table(spark):
    df = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("__x"))
    for n, each in ((5000, 64), (300, 64)):
        rows = forest.isolation_samples(df.limit(n) if n < 5000 else df, ("id",), 20, each).collect()
        by = {}
        for r in rows:
            by.setdefault(r.tree, set()).add(r.x[0])
        assert sorted(by) == list(range(20)) and all(len(x) == each for x in by.values())
        assert len({frozenset(x) for x in by.values()}) == 20 and len(set().union(*by.values())) > min(n, 20 * each) * 0.5


def test_fatigue_by_brute_force(spark):
    out = load_plans._fatigue(spark, DATA).collect()
    scores = sorted(r.anomaly for r in out)
    assert scores[0] == 0.0 and scores[-1] == 1.0 and 0 < sum(r.is_anomaly for r in out) <= 0.14 * len(out)
    for r in out:
        risk = max(0.0, min(1.0, 0.65 * r.anomaly + 0.35 * r.excess))
        assert abs(r.risk - risk) < 1e-12 and r.risk_level == ("high" if risk >= 0.62 else "medium" if risk >= 0.38 else "low") and r.overload == (risk >= 0.62)
    counts = {(r.kind, r["name"]): r.n for r in load.fatigue_counts(load_plans._fatigue(spark, DATA)).collect()}
    assert {k: n for (kind, k), n in counts.items() if kind == "level"} == {k: sum(r.risk_level == k for r in out) for k in {r.risk_level for r in out}}
    told = [x for r in out for x in r.reasons.split(" | ")]
    assert {k: n for (kind, k), n in counts.items() if kind == "factor"} == {k: told.count(k) for k in set(told)}
    o = load.alert_overlap(load_plans._fatigue(spark, DATA)).first()
    a, b = ({(r.player_id, r.day) for r in out if r[c] == "high"} for c in ("static_level", "risk_level"))
    assert (o.static_high, o.risk_high, o.both, o.either) == (len(a), len(b), len(a & b), len(a | b))


def test_isolation_scores_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(1000 + i, 9.0 + i, -9.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    out = {r.id: r.anomaly for r in models.isolation_forest(df, ("a", "b"), ("id",), trees=30, sample=64).collect()}
    picks = {}
    for r in sorted(forest.isolation_samples(df.withColumn("__x", F.array("a", "b")), ("id",), 30, 64).collect(), key=lambda r: (r["tree"], r["r"])):
        picks.setdefault(r["tree"], []).append(r["x"])
    trees = [forest.grow_isolation(np.array(picks[t]), 6, np.random.default_rng(t)) for t in range(30)]
    raw = {i: plain_score(trees, (a, b), float(forest.mean_path(64))) for i, a, b in rows}
    low, high = min(raw.values()), max(raw.values())
    assert all(abs(out[i] - (s - low) / (high - low)) < 1e-9 for i, s in raw.items())
    assert set(sorted(out, key=out.get)[-4:]) == {1000, 1001, 1002, 1003}


def test_final_report_and_days_take_the_models(spark):
    report = retrieval._final_report_of_models(spark, DATA).collect()
    scores = [r.anomaly_score for r in report]
    assert len({(r.match_id, r.team_id) for r in report}) == len(report) and (min(scores), max(scores)) == (0.0, 1.0)
    flagged = {r.anomaly_score for r in report if r.is_anomalous}
    assert 0 < len(flagged) <= 0.12 * len(report) + 1 and min(flagged) > max(s for r, s in zip(report, scores, strict=True) if not r.is_anomalous)
    assert all(r.profile != "unknown_profile" and 0 <= r.cluster < 5 for r in report)
    days = retrieval._days_of_clustered_players(spark, DATA).collect()
    of = {}
    for r in days:
        of.setdefault(r.player_id, set()).add((r.cluster, r.profile))
    assert all(len(x) == 1 for x in of.values()) and len({(r.player_id, r.day) for r in days}) == len(days)
    few = groups.with_clusters(spark.createDataFrame([(1, 2)], "player_id bigint, day bigint"), spark.createDataFrame([], "player_id bigint, cluster int, profile string, pca_1 double, pca_2 double"))
    assert few.first().cluster is None
