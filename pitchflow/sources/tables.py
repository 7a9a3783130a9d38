"""Tables in CSV and JSON: tolerant reading, ordered writing, labels beside a manifest, snapshots for a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import all_integers, to_bool, to_number


def read_csv(spark: SparkSession, path: str, numbers: tuple[str, ...] = (), booleans: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """All columns as trimmed text, empty as null; those named as numbers (decimal commas accepted), booleans or dates,
    null where a value is none. A byte order mark in front of the header is left out."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    raw = raw.toDF(*[c.removeprefix("﻿").strip() for c in raw.columns])
    text = {c: F.nullif(F.trim(c), F.lit("")) for c in raw.columns}
    of = {**{c: to_number(F.col(c)) for c in numbers}, **{c: to_bool(F.col(c)) for c in booleans}, **{c: F.col(c).try_cast("date") for c in dates}}
    return raw.select(*[(of[c] if c in of else text[c]).alias(c) for c in raw.columns])


def column_kinds(rows: DataFrame) -> DataFrame:
    """column, kind: 'integer', 'number' or 'text' by whether all values that are there are (whole) numbers; 'empty' without any."""
    def kind(c: str):
        n, text = to_number(F.col(c)), F.nullif(F.trim(c), F.lit(""))
        known, numeric = F.count(text), F.count(n)
        return F.when(known == 0, "empty").when(known > numeric, "text").when(all_integers(n), "integer").otherwise("number")

    wide = rows.agg(*[kind(c).alias(c) for c in rows.columns])
    return wide.unpivot([], rows.columns, "column", "kind")


def ordered(rows: DataFrame, first: tuple[str, ...]) -> DataFrame:
    """The columns in the preferred order, as far as they are there, and all others by name behind them."""
    return rows.select(*[c for c in first if c in rows.columns], *sorted(c for c in rows.columns if c not in first))


def write_csv(rows: DataFrame, path: str, first: tuple[str, ...] = ()) -> None:
    """One header a file; nulls are empty."""
    ordered(rows, first).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, first: tuple[str, ...] = ()) -> None:
    ordered(rows, first).write.mode("overwrite").json(path)


def labelled_samples(spark: SparkSession, labels: str, manifest: str) -> DataFrame:
    """The labels of a JSON-lines file beside the rows of a CSV manifest of the same sample_id: sample_id, split ('train'
    where it is none of train, val, test), category and true severity, one row for each labelled category."""
    l = spark.read.schema("sample_id string, true_severity map<string, double>").json(labels)  # noqa: E741
    m = read_csv(spark, manifest).select("sample_id", F.lower("split").alias("split"))
    split = F.when(F.col("split").isin("train", "val", "test"), F.col("split")).otherwise("train")
    return l.join(m, "sample_id").select("sample_id", split.alias("split"), F.explode("true_severity").alias("category", "truth"))


def topic_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, value: each row as a JSON text under its key, as a topic takes it."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def write_topic(rows: DataFrame, key: str, path: str | None = None, options: dict[str, str] | None = None) -> None:
    """Appends topic_rows to a Kafka topic by its options, or, where no connector is there, to JSON files under a path."""
    out = topic_rows(rows, key)
    if options:
        out.write.format("kafka").options(**options).save()
    else:
        out.write.mode("append").json(path)
