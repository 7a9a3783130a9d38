"""The folder for intermediate tables, and the bound of what goes to Python at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; on a cluster executors would not see each other's
    files, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pitchflow-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python by bytes, unless the session has a lower bound.

    Spark counts rows only by default: ten thousand long texts at once, held on both sides. The setting stays, as
    queries run after the function that built them has returned.
    """
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 * 2**20
    now = str(spark.conf.get(name)).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: later steps start from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pitchflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
