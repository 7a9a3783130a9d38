"""Models: decision forests and nets, future form, the isolation forest. MLlib where it has the algorithm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import forest, net
from .decision import evaluation


def fold_of(match_id, folds: int = 5):
    """All rows of a match fall into one fold."""
    return F.pmod(F.xxhash64(match_id), F.lit(folds))


def folds_of(rows: DataFrame, fold: str = "fold") -> list[int]:
    return sorted(r[0] for r in rows.select(fold).distinct().collect())


def scored_by_fold(rows: DataFrame, categorical, numeric, key=("event_id",), action: str = "event_type", actions=("pass", "shot", "carry"), fold: str = "fold", trees: int = 700, depth: int = 14) -> DataFrame:
    """All rows with each action in the place of their own (p_<action>), and value for the one taken: each fold by a forest
    of the other folds, a single fold by its own. All forests are grown at once, and all rows scored in one pass."""
    folds = folds_of(rows, fold)
    encoding = forest.Encoding.of(rows, categorical, numeric)
    single = len(folds) < 2
    grown = forest.fit_forests(rows, encoding, key, [None] if single else folds, fold=None if single else fold, trees=trees, depth=depth)
    return forest.scored(rows, encoding, forest.collected(grown), None if single else fold, action, actions).withColumnRenamed("p", "value")


def forest_scores(rows: DataFrame, categorical, numeric, key=("event_id",), fold: str = "fold", trees: int = 700, depth: int = 14) -> DataFrame:
    """label, fold, p: every row by a forest of the other folds."""
    encoding = forest.Encoding.of(rows, categorical, numeric)
    grown = forest.fit_forests(rows, encoding, key, folds_of(rows, fold), fold=fold, trees=trees, depth=depth)
    return forest.scored(rows, encoding, forest.collected(grown), fold).select("label", fold, "p")


def net_scores(rows: DataFrame, categorical, numeric, key=("event_id",), fold: str = "fold", **settings) -> DataFrame:
    """label, fold, p: every row by a net of the other folds."""
    encoding = forest.Encoding.of(rows, categorical, numeric)
    return net.scored(rows, net.fit(rows, encoding, key, folds_of(rows, fold), fold=fold, **settings), fold).select("label", fold, "p")


def candidates(rows: DataFrame, scorers: dict, fold: str = "fold") -> DataFrame:
    """model, folds, mean_auc, std_auc, mean_average_precision, mean_brier, selected: each model scores every fold without
    having seen it, and is judged fold by fold; the best by mean AUC, then average precision, then Brier score is selected.

    scorers: for each model a function from rows to label, fold and p. The scores of all models and folds are one
    table, judged in one pass. With a single fold nothing is judged.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame([(n,) for n in scorers], "model string")
    figures = spark.createDataFrame([], "model string, auc double, average_precision double, brier double")
    if len(folds_of(rows, fold)) > 1:
        parts = [scorer(rows).select(F.lit(n).alias("model"), F.col(fold).alias("fold"), F.col("label").alias("y"), "p") for n, scorer in scorers.items()]
        figures = evaluation(written(reduce(DataFrame.unionByName, parts), "candidate-scores"), by=("model", "fold"))
    out = names.join(figures, "model", "left").groupBy("model").agg(
        F.count("average_precision").alias("folds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
        F.avg("average_precision").alias("mean_average_precision"), F.avg("brier").alias("mean_brier"),
    )
    key = F.struct(F.coalesce("mean_auc", F.lit(-1.0)), F.coalesce("mean_average_precision", F.lit(-1.0)), -F.coalesce("mean_brier", F.lit(1.0)))
    return out.withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), "model")) == 1)  # a row for each model


#: Fixed value: the rows below which no forest is fitted.
LEAST_ROWS = 40


def future_form(rows: DataFrame, features, target: str, split_day: int, fallback: str, seed: int = 42, trees: int = 400, depth: int = 8):
    """Random forest fitted on the days up to split_day: the rows after it with predictions, and the importances of the
    features. With under LEAST_ROWS rows to fit, or none after the split, the predictions are the column `fallback`."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.where(F.col(target).isNotNull()).na.fill(0.0, [*features, fallback]))
    train, test = data.where(F.col("day") <= split_day), data.where(F.col("day") > split_day)
    spark, schema = rows.sparkSession, "feature string, importance double"
    if train.limit(LEAST_ROWS).count() < LEAST_ROWS or test.isEmpty():
        return test.withColumn("prediction", F.col(fallback)).drop("features"), spark.createDataFrame([(f, 0.0) for f in features], schema)
    model = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="all", seed=seed).fit(train)
    return model.transform(test).drop("features"), spark.createDataFrame([(f, float(x)) for f, x in zip(features, model.featureImportances.toArray(), strict=True)], schema)


def errors(rows: DataFrame, target: str, **predictions: str) -> DataFrame:
    """model, mae, rmse, r2 of each named column of predictions; r2 is 0 where the target does not vary."""
    out = []
    for name, column in predictions.items():
        d, y = F.col(column) - F.col(target), F.col(target)
        total = F.count(y) * F.var_pop(y)
        out.append(rows.agg(F.lit(name).alias("model"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.when(total > 0, 1 - F.sum(d * d) / total).otherwise(0.0).alias("r2")))
    return reduce(DataFrame.unionByName, out)


def isolation_forest(rows: DataFrame, features, key, trees: int = 250, sample: int = 256, contamination: float = 0.12) -> DataFrame:
    """Adds anomaly, the isolation score scaled to 0..1 over all rows (0 where they do not differ), and is_anomaly, the
    rows beyond the contamination quantile, which is found to a ten-thousandth.

    Each tree is grown from `sample` rows of its own, so the model is bounded by trees x sample rows, whatever the input,
    and does not depend on partitioning. Splits do not care for the scale of a feature, so none is standardised. Every
    row is scored, once, and written.
    """
    data = rows.withColumn("__x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))
    by_size = forest.collected(forest.fit_isolation(data, key, trees, sample))  # trees, not rows
    grown = [t for some in by_size.values() for t in some]
    scale, width = float(forest.mean_path(max([2, *by_size]))), len(features)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
            yield pa.array(2.0 ** (-np.mean([forest.tree_scores(t, x) for t in grown], axis=0) / scale) if len(x) else np.zeros(0))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = written(data.withColumn("__s", F.arrow_udf(score, "double")("__x")).drop("__x"), "isolation-scores")
    limits = scored.agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"), F.percentile_approx("__s", 1 - contamination, 10_000).alias("__at"))
    out = scored.join(F.broadcast(limits)).withColumn("anomaly", F.when(F.col("__hi") - F.col("__lo") > 1e-9, (F.col("__s") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0))
    return out.withColumn("is_anomaly", F.col("__s") > F.col("__at")).drop("__s", "__lo", "__hi", "__at")
