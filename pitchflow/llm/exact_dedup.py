"""Exact dedup by a persistent digest index.

The index is a Spark table of one row for each distinct text, bucketed and sorted by the digest. A batch is
reduced to its distinct digests (partial counts before the shuffle), those that the index lacks are found by a
sort-merge anti-join and appended, and every row of the batch then looks up which document keeps its text.

A lasting index gets its number of buckets when it is made, `buckets`; they cannot be changed later, so choose them
for the digests that are to come (`default_buckets`: two million digests, some 200 MB, in each). The index side of
both joins is read without a shuffle. Without one, a passing index is made in the shared folder and taken out of the
catalog again. A digest that was appended twice, as by a job that was run again, counts once.

Nulls, ties and edges: a null text counts as empty, and empty texts equal each other. Texts are equal when
identical after lower-casing A-Z. The largest doc_id of a batch keeps the text; a null doc_id loses against any
other. Rows that repeat the winning doc_id are all marked kept; `deduplicate` returns one of them. An empty batch
changes nothing. A very long text is hashed whole. Columns other than the two named ones are ignored here and carried through by `deduplicate`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_unique, scratch_path, written

INDEX_SCHEMA = "digest string, keep_id bigint, group_size bigint"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest: SHA-256 of the normalised text."""
    text = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(text, 256).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of the digests that have been kept so far."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64, path: str | None = None):
        """path: where the table's files are, by default in the warehouse."""
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], INDEX_SCHEMA), "errorifexists")

    def _append(self, rows: DataFrame, mode: str) -> None:
        writer = rows.write.mode(mode).bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def rows(self) -> DataFrame:
        """One row for each digest; grouped where it lies, as the buckets are by digest."""
        return self.spark.table(self.table).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Appends those digests of `batch` (doc_id, digest) that the index has not yet; all digests of the batch, with their rows counted."""
        # Written first, or the anti-join would be put before the grouping and meet all rows instead of partial counts.
        groups = written(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "batch-digests")
        fresh = groups.join(self.spark.table(self.table).select("digest").hint("merge"), "digest", "left_anti")
        # A table is not read while it is appended to, so the new rows are written first.
        self._append(written(fresh, "fresh-digests"), "append")
        return groups


def default_buckets(n_digests: int) -> int:
    """One bucket for each two million digests: about 200 MB a bucket."""
    return max(8, n_digests // 2_000_000)


def decisions(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier batches, keep_id and group_size are those of the batch that brought the text first.
    """
    spark = docs.sparkSession
    batch = written(digests(docs), "digests")
    passing = index is None
    if passing:
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", default_buckets(batch.count()), scratch_path(spark, "digest-index"))
    # How often a digest comes is counted in this batch: the index says it of the batch that brought it first.
    here = index.add(batch).select("digest", F.col("group_size").alias("here"))
    kept_of = written(here.join(index.rows().hint("merge"), "digest"), "kept-digests")
    if passing:
        spark.sql(f"DROP TABLE {index.table}")
    return join_unique(batch, kept_of, "digest", "here").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, one for each text, with all their columns."""
    kept = written(decisions(docs, index).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).count(), "kept")
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce(ascii_lower(F.col("text")), F.lit("")), 256))
    out = keyed.join(kept.select("__id", "__sha"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    # Rows that repeat doc_id and text are rare; only where there are any are the texts grouped.
    return (out if kept.where("count > 1").isEmpty() else out.dropDuplicates(["doc_id", "__digest"])).drop("__digest")
