"""Running sums and exact quantiles over whole tables, by ranges of values: no task holds more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def cumulated(rows: DataFrame, order: str, *sums: str, by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """rows, whose `order` is unique within `by`, with before_<s>, the sum of s over the rows in front, and total_<s>.

    Rows are dealt to ranges of (by, order) and written once, so that sums of ranges and rows agree; the sums of the
    ranges, as many as shuffle partitions for each `by`, are added up and joined back, and rows within a range last.
    """
    key = F.desc(order) if descending else F.asc(order)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *by, key).withColumn("__part", F.spark_partition_id()), "ranges")
    each = ranged.groupBy("__part", *by).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    among, whole = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    each = each.select("__part", *by, *[F.coalesce(F.sum(f"__{s}").over(among), F.lit(0)).alias(f"__b_{s}") for s in sums], *[F.sum(f"__{s}").over(whole).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy("__part", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # Without `by` there is a row for each range; with it there can be as many as rows, so the join is left to Spark.
    joined = ranged.join(each if by else F.broadcast(each), ["__part", *by])
    before = [(F.col(f"__b_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums]
    return joined.select(*rows.columns, *before, *[f"total_{s}" for s in sums])


def counts(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value, n: equal values are counted before anything is sorted; null values are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(rows: DataFrame, value: str, at: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, q: the exact quantiles of a column as an array, interpolated between neighbours."""
    c = cumulated(counts(rows, value, by), value, "n", by=by)

    def standing(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col(value)))

    ends, rank = [], lambda q: (F.col("total_n") - 1) * F.lit(q)
    for k, q in enumerate(at):
        ends += [standing(F.floor(rank(q))).alias(f"lo{k}"), standing(F.ceil(rank(q))).alias(f"hi{k}"), F.max(rank(q) - F.floor(rank(q))).alias(f"f{k}")]
    found = c.groupBy(*by).agg(*ends)
    return found.select(*by, F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"f{k}") for k in range(len(at))]).alias("q"))


def quantile(rows: DataFrame, value: str, q: float, name: str = "limit") -> DataFrame:
    """One row with one quantile of all rows; null without rows."""
    return quantiles(rows, value, (q,)).select(F.get("q", F.lit(0)).alias(name))
