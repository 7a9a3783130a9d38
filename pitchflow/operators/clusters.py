"""Clusters of teams and players: k-means of many starts at once, silhouette, principal components, names.

Each step of k-means is one pass over a written table for all starts together: tasks add up their rows by start and
cluster, and only those sums, starts x clusters x features numbers, come to the driver. The starts are drawn by
k-means++ from a sample of at most SAMPLE rows; with fewer rows it is all of them.

The silhouette is on Euclidean distances: every row against that sample. It is exact up to SAMPLE rows and an estimate
beyond, as its distances to a cluster are then means over a part of it.

Nulls, ties and edges: null features are 0. A feature that does not vary does not count. Equal distances go to the
lower cluster. Clusters that lose all rows keep their centre. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SAMPLE, ROUNDS = 2000, 300


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sample(rows: DataFrame, x: str) -> np.ndarray:
    """At most SAMPLE rows of the whole table, those of the smallest hash; ties by their values."""
    taken = rows.select(x).orderBy(F.xxhash64(x), x).limit(SAMPLE).collect()
    return np.array([r[0] for r in taken], float).reshape(len(taken), -1)


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre is drawn by its squared distance to the nearest one so far."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    while len(centres) < k:
        d = np.min([((sample - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(sample[rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))])
    return np.array(centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of centres[start, cluster] to each row, for each start, and its squared distance."""
    d = ((x[:, None, None, :] - centres[None]) ** 2).sum(3)
    return d.argmin(2), d.min(2)


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts, k, width = centres.shape
    total, cost = np.zeros((starts, k, width + 1)), np.zeros(starts)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            x = _matrix(batch.column(0).slice(at, 1000))
            found, far = nearest(x, centres)
            cost += far.sum(0)
            for s in range(starts):
                np.add.at(total[s, :, :width], found[:, s], x)
                total[s, :, width] += np.bincount(found[:, s], minlength=k)
    values = np.concatenate([total.ravel(), cost])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), pa.array(values)], names=["i", "v"])


def k_means(rows: DataFrame, x: str, k: int, starts: int = 30) -> np.ndarray:
    """The centres of the best of several starts, over a written table with features in the array column x."""
    sample = _sample(rows, x)
    centres = np.array([_first_centres(sample, k, seed) for seed in range(starts)])
    best, size = None, centres.size // centres.shape[2] * (centres.shape[2] + 1)
    for _ in range(ROUNDS):
        parts = rows.select(x).mapInArrow(lambda b, c=centres: _sums(b, c), "i bigint, v double")
        got = np.zeros(size + starts)
        for i, v in parts.groupBy("i").agg(F.sum("v")).collect():
            got[i] = v
        sums, cost = got[:size].reshape(starts, k, -1), got[size:]
        best = centres[int(cost.argmin())]
        n = sums[:, :, -1:]
        moved = np.where(n > 0, sums[:, :, :-1] / np.maximum(n, 1), centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-9):
            break
        centres = moved
    return best


def silhouette(rows: DataFrame, x: str, cluster: str = "cluster") -> float:
    """The mean over all rows of (b - a) / max(a, b), a row's mean distances to its own and the nearest other cluster; 0 with one cluster."""
    taken = rows.select(x, cluster).orderBy(F.xxhash64(x), x).limit(SAMPLE).collect()
    points, of = np.array([r[0] for r in taken], float), np.array([r[1] for r in taken])
    names = np.unique(of)
    if len(names) < 2:
        return 0.0
    exact = rows.count() <= SAMPLE

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                here, own = _matrix(part.column(0)), part.column(1).to_numpy()
                far = np.sqrt(((here[:, None, :] - points[None]) ** 2).sum(2))
                sums = np.stack([far[:, of == c].sum(1) for c in names], 1)
                n = np.broadcast_to([(of == c).sum() for c in names], sums.shape).astype(float)
                mine = own[:, None] == names[None]
                alone = (n * mine).sum(1) <= 1
                a = (sums * mine).sum(1) / np.maximum((n * mine).sum(1) - (1 if exact else 0), 1)
                b = np.where(mine, np.inf, sums / n).min(1)
                s = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
                yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    return float(rows.select(x, cluster).mapInArrow(widths, "s double").agg(F.avg("s")).first()[0] or 0.0)


def standardised(rows: DataFrame, features) -> DataFrame:
    """The features less their mean over their population std, as z_<feature>; 0 where a feature does not vary."""
    stats = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {f"z_{c}": F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in features}
    return rows.join(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def _clustered(rows: DataFrame, features, k: int, starts: int, scale: bool) -> DataFrame:
    """rows with __x, the features as they are clustered, and cluster; as a written table."""
    filled, used = rows.na.fill(0.0, list(features)), [f"z_{c}" for c in features] if scale else list(features)
    data = standardised(filled, features) if scale else filled
    data = data.withColumn("__x", F.array(*[F.col(c).cast("double") for c in used]))
    data = written(data.drop(*used) if scale else data, "cluster-rows")
    centres = k_means(data, "__x", k, starts)[None]

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(nearest(_matrix(column), centres)[0][:, 0] if len(column) else [], pa.int32())

    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return written(data.withColumn("cluster", F.arrow_udf(place, "int")("__x")), "clusters")


def clusters(rows: DataFrame, features, k: int = 5, starts: int = 10, scale: bool = True) -> DataFrame:
    """Standardised rows, or rows as they are without `scale`, with their cluster of k. Fewer rows than clusters are one cluster."""
    if rows.limit(k).count() < k:
        return rows.withColumn("cluster", F.lit(0))
    return _clustered(rows, features, k, starts, scale).drop("__x")


def cluster_rows(clustered: DataFrame, features, by=("cluster",)) -> DataFrame:
    """A row for each cluster: its number of rows and the mean of each feature, its centroid."""
    return clustered.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *[F.avg(c).alias(c) for c in features])


def named_team_clusters(rows: DataFrame) -> DataFrame:
    """profile and explanation of each row by how the means of its cluster differ from those of all rows."""
    features = ("lossRate", "progressivePassSuccessRate", "counterpressingRate", "xgPerShot", "passSuccessRate")
    everyone = rows.agg(*[F.avg(c).alias(f"__{c}") for c in features])
    c = rows.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in features]).join(F.broadcast(everyone))
    loss, progress, press, chance, passes = [F.col(c) - F.col(f"__{c}") for c in features]
    # How far a mean has to differ, and the texts and names.
    told = [
        (loss > 0.015, "higher than average ball losses"), (loss < -0.015, "lower than average ball losses"),
        (progress > 0.03, "higher than average progressive passing success"), (progress < -0.03, "lower than average progressive passing success"),
        (press > 0.04, "stronger than average counterpressing"), (press < -0.04, "weaker than average counterpressing"),
        (chance > 0.015, "higher than average chance quality per shot"), (chance < -0.015, "lower than average chance quality per shot"),
        (passes < -0.06, "lower than average overall pass success"),
    ]
    profile = (
        F.when((loss > 0.015) & (progress < -0.03), F.when(chance > 0.015, "high_loss_low_progression_with_chance_quality").otherwise("high_loss_low_control"))
        .when((press > 0.04) & (loss <= 0.015), "strong_pressing_compact")
        .when((chance < -0.015) & (progress >= -0.03), "low_chance_creation")
        .when((progress > 0.03) & (loss < 0), "balanced_control")
        .otherwise("mixed_profile")
    )
    said = F.array_compact(F.array(*[F.when(test, text) for test, text in told]))
    named = c.select("cluster", profile.alias("profile"), F.when(F.size(said) == 0, F.array(F.lit("balanced around league baseline values"))).otherwise(said).alias("explanation"))
    return rows.join(F.broadcast(named), "cluster")  # a row for each cluster


#: The players from which on there are three clusters, and below which there are none.
THREE_FROM, LEAST_PLAYERS = 9, 3


def player_clusters(profiles: DataFrame, features, starts: int = 30) -> tuple[DataFrame, float, list[float]]:
    """Players with cluster, profile, pca_1 and pca_2; the silhouette; the shares of variance of the two components.

    Clusters are those of the standardised features, three from nine players on, else two; the components are for
    display only. Fewer than three players are one cluster, 'insufficient_population', with zeros for the rest.
    """
    n = profiles.limit(THREE_FROM).count()
    if n < LEAST_PLAYERS:
        zero = F.lit(0.0)
        return profiles.withColumns({"cluster": F.lit(0), "profile": F.lit("insufficient_population"), "pca_1": zero, "pca_2": zero}), 0.0, [0.0, 0.0]
    data = _clustered(profiles, features, 3 if n >= THREE_FROM else 2, starts, True)
    fit = silhouette(data, "__x")
    vectors = data.withColumn("__v", array_to_vector("__x"))
    pca = PCA(k=min(2, len(features)), inputCol="__v", outputCol="__c").fit(vectors)
    shown = pca.transform(vectors)
    parts = {f"pca_{i + 1}": F.coalesce(F.get(vector_to_array("__c"), F.lit(i)), F.lit(0.0)) for i in range(2)}
    out = shown.withColumns(parts).drop("__v", "__c", "__x")
    return named_player_clusters(out), fit, [*map(float, pca.explainedVariance.toArray()), 0.0][:2]


def named_player_clusters(rows: DataFrame) -> DataFrame:
    """profile by cluster: the one of the longest mean distance, of the others the most explosive one, and the rest; ties to
    the smaller cluster. A row for each cluster is ranked."""
    explosive = F.avg(F.col("high_share") + F.col("high_acc") / 100.0 + F.col("sprints") * 100.0)
    c = rows.groupBy("cluster").agg(F.avg("distance").alias("__d"), explosive.alias("__e"))
    everywhere = Window.partitionBy(F.lit(0))
    c = c.withColumn("__first", F.row_number().over(everywhere.orderBy(F.desc(F.round("__d", 9)), "cluster")) == 1)
    c = c.withColumn("__second", (F.row_number().over(everywhere.orderBy("__first", F.desc(F.round("__e", 9)), "cluster")) == 1) & ~F.col("__first"))
    # The names of the profiles.
    name = F.when(F.col("__first"), "high-volume runner").when(F.col("__second"), "explosive short-burst").otherwise("low-volume high-intensity")
    return rows.join(F.broadcast(c.select("cluster", name.alias("profile"))), "cluster")


def with_clusters(days: DataFrame, clustered: DataFrame) -> DataFrame:
    """days with cluster, profile, pca_1 and pca_2 of their player; null where the player has none. A row for each player is joined."""
    return days.join(clustered.select("player_id", "cluster", "profile", "pca_1", "pca_2"), "player_id", "left")
