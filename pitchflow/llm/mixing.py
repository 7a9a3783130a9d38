r"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put into a keyed random order and cut into blocks of `block_rows`. Weights are integer shares;
a frame has one slot for each share of its sources. In a frame a source with c of W slots releases its k-th block
(k from 0) at slot floor(k * W / c) and must send it before slot ceil((k + 1) * W / c); among the released blocks
the earliest deadline goes first, ties to the smaller source name. That keeps every source less than one block from
its exact share at every slot of the frame (Pfair). Every frame with the same counts has the same order, so only the
distinct frames are scheduled: one while all have blocks, and at most two more for each source that runs out, in
which the others go on with their shares. No row is dropped or repeated.

The plan is bounded whatever the number of sources: the `ALONE` sources of the largest weights are scheduled one by
one, and all others by size class, those with 2**i to 2**(i + 1) - 1 rows together as one, whose share is the sum of
theirs and in which they follow the keyed random order. So at most ALONE + 64 names share at most SHARES + ALONE + 64
slots of a frame, and (2 * names + 1) frames are worked out and broadcast. Rows get their number in their source from
counts by (source, bucket) and a window within a bucket, so a source with any share of all rows is spread over all
tasks. DataFrame functions only.

Nulls, ties and edges: a null source is a source of its own, named ''. Sources without a weight get `other` shares.
Rows with equal doc_id and text are interchangeable and each gets its own position. A last block may be short. An
empty table stays empty. A text of any length is hashed whole. All columns are carried; columns named block, slot or
position are replaced. A frame that a table does not fill is mixed by the blocks that are left.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_table, written

SHARES = 100
BLOCK_ROWS = 16
BUCKET_ROWS = 20_000
ALONE = 64
#: The most slots of all distinct frames together, which are worked out on the driver and broadcast.
ENTRIES = 2_000_000


def frame_order(counts: dict[str, int]) -> list[str]:
    """The sources of a frame's slots, earliest deadline first among the released blocks."""
    total = sum(counts.values())
    waiting = [(0, s, 0) for s, c in counts.items() if c]  # release, source, k
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // counts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < counts[s]:
            heapq.heappush(waiting, ((k + 1) * total // counts[s], s, k + 1))
    return out


def plan(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int, int]]]:
    """The distinct frames (first frame, first slot, slots of a frame) and their entries (frame kind, source, k, slot)."""
    starts = sorted({0} | {f for s, n in blocks.items() for f in (n // weights[s], n // weights[s] + 1)})
    kinds, entries, slot = [], [], 0
    for kind, f in enumerate(starts):
        counts = {s: min(weights[s], max(0, n - f * weights[s])) for s, n in blocks.items()}
        size = sum(counts.values())
        kinds.append((f, slot, size))
        if not size:
            break
        seen = dict.fromkeys(counts, 0)
        for at, s in enumerate(frame_order(counts)):
            entries.append((kind, s, seen[s], at))
            seen[s] += 1
        slot += size * ((starts[kind + 1] if kind + 1 < len(starts) else f + 1) - f)
    return kinds, entries


def square_root_weights(rows: dict[str, float], shares: int = SHARES) -> dict[str, int]:
    """Shares by the square root of the number of rows: large sources give way to small ones."""
    return _shares({s: n**0.5 for s, n in rows.items()}, shares)


def _shares(weights: dict[str, float], shares: int) -> dict[str, int]:
    total = sum(weights.values()) or 1.0
    return {s: max(1, round(shares * w / total)) for s, w in weights.items()}


def _whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole weights by their greatest common divisor, so a frame is as long as they need; only weights whose frames would
    have over ENTRIES slots altogether are rounded to that length."""
    whole = {s: int(w) for s, w in weights.items()}
    divisor = math.gcd(*whole.values())
    whole = {s: w // divisor for s, w in whole.items()}
    longest = ENTRIES // (2 * len(whole) + 1)
    return whole if sum(whole.values()) <= longest else _shares(weights, longest)


def _named(rows: DataFrame, weight: Column, alone: int) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """rows with __source, the source or its size class, and of each such name the number of rows and the weight."""
    counts = written(rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).withColumn("w", weight), "source-counts")
    head = {r["__source"]: (r["n"], r["w"]) for r in counts.orderBy(F.desc("w"), "__source").limit(alone).collect()}
    rest = counts.where(~F.col("__source").isin(list(head))) if head else counts
    rest = rest.withColumn("__class", F.concat(F.lit("\0size-"), F.floor(F.log2("n")).cast("string")))
    classes = {r["__class"]: (r["n"], r["w"]) for r in rest.groupBy("__class").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}
    if classes:
        other = ~F.col("__source").isin(list(head))
        classed = rows.where(other).join(rest.select("__source", "__class"), "__source").withColumn("__source", F.col("__class")).drop("__class")
        rows = rows.where(~other).unionByName(classed)
    return rows, head | classes


def mix(docs: DataFrame, weights: dict[str, int] | None = None, other: int = 1, block_rows: int = BLOCK_ROWS, key: int = 17, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", only_ids: bool = False, shares: int = SHARES, alone: int = ALONE) -> DataFrame:
    """docs with block (in its source or size class), slot (of the block in the mix) and position (of the row in the mix).

    weights: integer shares by source; by default `shares` of them by the square roots of the numbers of rows.
    only_ids: just the id and source. alone: how many sources are scheduled one by one.
    """
    spark = docs.sparkSession
    order = [F.xxhash64(F.lit(key), F.col(id_col).cast("string"), F.col(text_col)), F.col(id_col)]
    kept = [F.col(id_col), F.col(source_col)] if only_ids else [F.col(c) for c in docs.columns if c not in ("block", "slot", "position")]
    rows = docs.select(*kept, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), order[0].alias("__h"))
    if weights is None:
        weight = F.sqrt("n")
    else:
        given = {s: max(1, int(w)) for s, w in weights.items()} or {"": max(1, other)}
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]), F.col("__source")), F.lit(max(1, other))).cast("double")
    rows, names = _named(rows, weight, alone)
    if not names:
        return rows.drop("__source", "__h").withColumns({c: F.lit(0).cast("bigint") for c in ("block", "slot", "position")})
    by_source = {s: n for s, (n, _) in names.items()}
    of = {s: w for s, (_, w) in names.items()}
    weights = _whole_shares(of) if weights is not None else _shares(of, shares)
    blocks = {s: -(-n // block_rows) for s, n in by_source.items()}
    kinds, entries = plan(blocks, weights)

    buckets = max(8, sum(by_source.values()) // BUCKET_ROWS)
    rows = rows.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    counts = written(rows.groupBy("__source", "__bucket").count(), "bucket-counts")
    before = counts.select("__source", "__bucket", (F.sum("count").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("count")).alias("__before"))
    in_bucket = Window.partitionBy("__source", "__bucket").orderBy("__h", id_col)
    numbered = rows.join(before.hint("shuffle_hash"), ["__source", "__bucket"]).withColumn("__n", F.col("__before") + F.row_number().over(in_bucket) - 1)

    weight = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, w)])[F.col("__source")]
    firsts = F.array(*[F.lit(f).cast("bigint") for f, _, _ in kinds])
    numbered = (
        numbered.withColumn("block", F.expr(f"__n div {block_rows}"))
        .withColumn("__w", weight)
        .withColumn("__frame", F.expr("block div __w"))
        .withColumn("__k", (F.col("block") % F.col("__w")).cast("int"))
        .withColumn("__kind", F.size(F.filter(firsts, lambda f: f <= F.col("__frame"))) - 1)
    )
    order_of = arrow_table(spark, entries, pa.schema({"__kind": pa.int32(), "__source": pa.string(), "__k": pa.int32(), "__at": pa.int64()}))
    placed = numbered.join(F.broadcast(order_of), ["__kind", "__source", "__k"])
    frames = F.array(*[F.struct(F.lit(f).cast("bigint").alias("frame"), F.lit(s).cast("bigint").alias("slot"), F.lit(n).cast("bigint").alias("size")) for f, s, n in kinds])
    kind = F.get(frames, F.col("__kind"))
    placed = placed.withColumn("slot", kind["slot"] + (F.col("__frame") - kind["frame"]) * kind["size"] + F.col("__at"))

    # Rows that short last blocks lack come off the positions behind them: one entry for each source.
    at = {(k, s, i): a for k, s, i, a in entries}
    short = []
    for s, n in blocks.items():
        f, i = divmod(n - 1, weights[s])
        k = max(k for k, (first, _, _) in enumerate(kinds) if first <= f)
        short.append((kinds[k][1] + (f - kinds[k][0]) * kinds[k][2] + at[k, s, i], n * block_rows - by_source[s]))
    lack = F.array(*[F.struct(F.lit(x).cast("bigint").alias("slot"), F.lit(m).cast("bigint").alias("rows")) for x, m in sorted(short)])
    gone = F.aggregate(F.filter(lack, lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("bigint"), lambda a, x: a + x["rows"])
    placed = placed.withColumn("position", F.col("slot") * block_rows + F.col("__n") % block_rows - gone)
    return placed.select(*[c for c in numbered.columns if not c.startswith("__") and c != "block"], "block", "slot", "position")


def in_mixed_order(docs: DataFrame, rows_per_part: int = 20_000, **options) -> DataFrame:
    """The documents, all their columns, in the order of the mix: range partitions of positions, each sorted."""
    mixed = mix(docs, **options)
    parts = -(-docs.count() // rows_per_part) or 1
    part = (F.col("position") / rows_per_part).cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions("position").select(*docs.columns)
