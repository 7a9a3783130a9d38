"""The live side: deduplicated event streams and snapshots of the matches that a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_events(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose `value` parses, and the rest for a quarantine table."""
    parsed = raw.withColumn("event", F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}))
    bad = F.col("event").isNull() | F.forall(F.array(*[F.col(f"event.{f.name}").isNull() for f in parsed.schema["event"].dataType]), lambda x: x)
    return parsed.where(~bad).select("event.*"), parsed.where(bad).select("value")


def snapshot_rows(snapshots: DataFrame, schema: str) -> DataFrame:
    """Events of cumulative snapshots, each an array or {events: [...]}; rows without an id are left out."""
    text = F.col("value").cast("string")
    whole = F.from_json(text, f"array<struct<{schema}>>")
    inner = F.from_json(text, f"struct<events:array<struct<{schema}>>>").getField("events")
    events = F.when(F.startswith(F.ltrim(text), F.lit("[")), whole).otherwise(inner)
    return snapshots.select(F.inline(events)).where("id is not null")


def snapshot_stream(spark: SparkSession, path: str, per_batch: int = 10, options: dict[str, str] | None = None) -> DataFrame:
    """value: the texts of a Kafka topic from its earliest offset, by its options, or, where no connector is there, of the
    files that land under a path, a file as a whole."""
    if options:
        return spark.readStream.format("kafka").option("startingOffsets", "earliest").options(**options).load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", per_batch).text(path)


def first_copies(events: DataFrame, key: str = "event_id", stamp: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """The first copy of each event; what the state remembers of it ends after ttl by the stamp column."""
    return events.withWatermark(stamp, ttl).dropDuplicatesWithinWatermark([key])


def last_copies(events: DataFrame, key: str | tuple[str, ...] = "event_id", order: str = "ingest") -> DataFrame:
    """The last copy of each event in a batch or table."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc(order))
    return events.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def latest(spark: SparkSession, out: str, match: str = "match_id") -> DataFrame:
    """The newest snapshot of every match."""
    s = spark.read.parquet(out)
    newest = s.groupBy(match).agg(F.max("batch").alias("batch"))
    return s.join(newest, [match, "batch"]).drop("batch")
