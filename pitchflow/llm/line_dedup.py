r"""Line dedup by overlapping three-line windows.

Lines are compared without the spaces around them. At each line a window of three lines begins (all lines, in a text
of one or two). Since a repeated passage can lie in fewer lines, every run of one or two lines of 50 words or more is
a window as well, a run of two also where one of its lines alone has as many words. Windows are hashed to 128 bits;
those that occur more than once anywhere are found by a count with partial sums, and of each all but the first
occurrence, by doc_id and line, lose their lines. The lines covered by overlapping windows are merged before they are
cut. Only hashes and places are shuffled to find repeats, and a window that stands in over a thousandth of all places
is looked up where it is.

Nulls, ties and edges: a null text is empty. Windows of blank lines never count. An occurrence that overlaps the
first one in the same text loses only the lines beyond it, so something stays of every passage. Rows that repeat both
doc_id and text are one document: they are cut alike. Rows with a null doc_id come before all others. A text of any
length is one row of line hashes. All columns are carried by `cut_lines`; the columns the operator adds replace
those of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_unique, written

LINES = 3
LONG = 50


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (of the text), i (line), n (lines), h1, h2: every window of every document."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("th"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1).alias("lines"))
    lines = lines.withColumn(
        "ls", F.expr("transform(lines, l -> named_struct('a', xxhash64(trim(l)), 'b', xxhash64('line', trim(l)), 'w', size(filter(split(l, ' '), x -> x <> ''))))")
    ).drop("lines")
    size = f"least({LINES}, size(ls))"
    window = "named_struct('i', {i}, 'n', {n}, 'w', aggregate(slice(ls, {i} + 1, {n}), 0, (s, x) -> s + x.w), 'h1', xxhash64(transform(slice(ls, {i} + 1, {n}), x -> x.a)), 'h2', xxhash64('window', transform(slice(ls, {i} + 1, {n}), x -> x.b)))"
    all_lines = f"transform(sequence(0, size(ls) - {size}), i -> {window.format(i='i', n=size)})"
    one = f"filter(transform(sequence(0, size(ls) - 1), i -> {window.format(i='i', n='1')}), x -> x.w >= {LONG} and size(ls) > 1)"
    two = f"filter(transform(sequence(0, greatest(0, size(ls) - 2)), i -> {window.format(i='i', n='2')}), x -> x.w >= {LONG} and size(ls) > 2)"
    each = lines.select("doc_id", "th", F.explode(F.expr(f"filter(concat({all_lines}, {one}, {two}), x -> x.w > 0)")).alias("x"))
    return each.select("doc_id", "th", "x.i", "x.n", "x.h1", "x.h2")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th, spans: for each document with lines to lose, the spans [first, last) of lines, one for each window."""
    found = written(windows(docs), "windows")
    place = F.struct("doc_id", "th", "i")
    first = found.groupBy("h1", "h2", "n").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.count(F.lit(1)).alias("size")).where("f <> l").drop("l")
    # Windows that stand in very many places are joined where they are; their first places are few and broadcast.
    later = join_unique(found, written(first, "first-places"), ["h1", "h2", "n"], "size").where(F.struct("doc_id", "th", "i") != F.col("f"))
    begin = F.when((F.col("f.doc_id") == F.col("doc_id")) & (F.col("f.th") == F.col("th")), F.greatest("i", F.col("f.i") + F.col("n"))).otherwise(F.col("i"))
    spans = later.select("doc_id", "th", begin.alias("first"), (F.col("i") + F.col("n")).alias("last")).where("first < last")
    return spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def _cut(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in texts:
        out = []
        for text, spans in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
            if spans is None or text is None:
                out.append((None, 0))
                continue
            lines, kept, at = text.split("\n"), [], 0
            for s in spans:
                kept += lines[at : max(at, s["first"])]
                at = max(at, s["last"])
            kept += lines[at:]
            out.append(("\n".join(kept), len(lines) - len(kept)))
        yield pd.DataFrame(out, columns=["text", "removed"])


def cut_lines(docs: DataFrame) -> DataFrame:
    """docs with the text without its repeated lines, n_lines (before) and n_removed."""
    bounded_batches(docs.sparkSession)
    spans = repeats(docs).withColumnsRenamed({"doc_id": "__id", "th": "__th", "spans": "__spans"})
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))).withColumn("__hash", F.xxhash64("text"))
    joined = keyed.join(spans, (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    cut_udf = F.pandas_udf(_cut, "text string, removed long")
    cut = joined.withColumn("__cut", cut_udf(F.struct(F.when(F.col("__spans").isNotNull(), F.col("text").cast("string")), F.col("__spans"))))
    cut = cut.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint"))
    cut = cut.withColumn("n_removed", F.coalesce("__cut.removed", F.lit(0)).cast("bigint")).withColumn("text", F.coalesce("__cut.text", "text"))
    return cut.select(*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 of the text that stays."""
    out = cut_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
