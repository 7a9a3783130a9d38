r"""The trie of all conversations' prefixes, by van Emde Boas recursion.

A node is a distinct sequence of first turns (role, text). Sequences are cut at half their depth again and again:
each cut gives upper parts and lower parts of half the height, and the lower parts are named by the prefix above
their cut. Below `base` levels nothing is cut any more; such a part (a block) is one row with an array of at most
`base` turns, whatever the length of its conversation.

* Naming. Digests of segments of 1, 2, 4, ... blocks are joined upwards in pairs. Downwards, the name of a cut is the
  digest of its upper cut's name and of the segment between the two, for the cuts of all segments of a height and all
  conversations at once. Inside a block the names of prefixes are chained turn by turn.
* Nodes. Equal names are counted, all tries in parallel, with partial sums before the shuffle.
* Totals. Each block adds up its own subtrees. Then, height by height, the totals of the roots of all lower tries are
  grafted on the path above their cut: log2(blocks) rounds, each over at most half as many rows as there are blocks.

A table of conversations of up to `base` turns takes no round at all. One conversation with a third of all turns, one
first turn under a third of all conversations and one conversation copied that often are split: turns are numbered by
ranges, blocks are keyed by (conversation, block), members are counted before the shuffle, parents of many children
are looked up in place, and the ids of a node's ends go to their SHA-256 in sorted chunks of 4,096. That digest is one
stream by its nature, over chunks only.

Names are the first 16 bytes of SHA-256, of lengths and texts. Texts themselves are never shuffled.

Nulls, ties and edges: a null role or text is empty; null turns come first; rows of the same turn are ordered by
their digest; repeated rows are further turns. Rows without a conv_id belong to no conversation and are left out. An
empty table has no node, not even a root. A conversation without turns is a member of the root alone. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_unique, written

BASE = 16
#: Of rebuilt(): every conversation shares up to HEAD - 1 first turns with the first of its FAMILY.
FAMILY, HEAD = 100, 6
CHUNK = 4096
ROOT = "X'00'"
_NAME = "substring(unhex(sha2({0}, 256)), 1, 16)"
Q = F.col


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each conversation from 0 in a sorted partition; conv_id is the first column."""
    last, n = None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += n
        last, n = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), token, size (code points of the text): a row for each turn, as a written table.

    Rows are sorted by ranges, so a conversation may span several; a range's first conversation goes on counting
    where the ranges before it ended. Those offsets are one row for each range.
    """
    role, text = (F.coalesce(Q(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.expr(_NAME.format("concat(length(r), ':', r, t)"))
    rows = (
        conversations.where("conv_id is not null")
        .select(Q("conv_id").cast("bigint").alias("conv_id"), Q("turn").cast("bigint").alias("turn"), role.alias("r"), text.alias("t"))
        .select("conv_id", "turn", token.alias("token"), F.length("t").cast("bigint").alias("size"))
    )
    order = ("conv_id", F.asc_nulls_first("turn"), "token")
    ranged = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    types = "conv_id bigint, turn bigint, token binary, size bigint, part int, place bigint"
    local = written(ranged.mapInArrow(_local_places, types), "turns")
    each = local.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), (F.max(F.struct("conv_id", "place"))["place"] + 1).alias("n")
    )
    among, all_parts = Window.partitionBy("last").orderBy("part"), Window.orderBy("part")
    each = each.withColumn("upto", F.sum("n").over(among))
    before = F.when(F.lag("last").over(all_parts) == Q("first"), F.lag("upto").over(all_parts)).otherwise(0)
    offsets = F.broadcast(each.select("part", "first", before.alias("before")))
    pos = Q("place") + F.when(Q("conv_id") == Q("first"), Q("before")).otherwise(0)
    return local.join(offsets, "part").select("conv_id", pos.alias("pos"), "token", "size")


def _members(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: (conv_id, total) and their turns (conv_id, total, pos, token, size).

    Conversation c begins with the first h turns of c - c % 100, or all it has if they are fewer, h being crc32 of the
    decimal c modulo 6; its own turns after its first h follow.
    """
    h = F.crc32(Q("conv_id").cast("string")) % HEAD
    turn = F.struct("pos", "token", "size")
    heads = turns.where((Q("pos") < HEAD - 1) & (Q("conv_id") % FAMILY == 0)).groupBy(Q("conv_id").alias("family")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = _members(turns).withColumns({"family": Q("conv_id") - Q("conv_id") % FAMILY, "h": h}).join(heads, "family", "left")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", 1, Q("h").cast("int")), F.expr("array()")))
    total = F.size("head") + F.greatest(Q("n") - Q("h"), F.lit(0))
    convs = written(convs.select("conv_id", "n", "h", "head", total.cast("bigint").alias("total")), "heads")
    own = join_unique(turns.where(Q("pos") >= h), convs.select("conv_id", "n", "h", "total", F.size("head").alias("k")), "conv_id", "n")
    own = own.select("conv_id", "total", (Q("pos") - Q("h") + Q("k")).alias("pos"), "token", "size")
    shared = convs.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", "total", "t.pos", "t.token", "t.size")
    return convs.select("conv_id", "total"), own.unionByName(shared)


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    convs = written(_members(turns).withColumn("total", Q("n")), "conversations")
    return convs.select("conv_id", "total"), join_unique(turns, convs, "conv_id", "n").select("conv_id", "total", "pos", "token", "size")


def _cut_names(blocks: DataFrame, most: int, base: int) -> DataFrame | None:
    """conv_id, cut (in blocks, from 1), name: the names of all prefixes of whole blocks. most: whole blocks of the longest."""
    if not most:
        return None
    tokens = "aggregate(turns, X'', (s, x) -> concat(s, x.token))"
    whole = blocks.where(F.size("turns") == base)
    digests = [written(whole.select("conv_id", Q("block").alias("seg"), F.expr(_NAME.format(tokens)).alias("digest")), "digests")]
    while 2 ** len(digests) <= most:
        pairs = digests[-1].groupBy("conv_id", F.floor(Q("seg") / 2).alias("seg")).agg(
            F.max(F.when(Q("seg") % 2 == 0, Q("digest"))).alias("a"), F.max(F.when(Q("seg") % 2 == 1, Q("digest"))).alias("b")
        )
        joined = pairs.where("a is not null and b is not null").select("conv_id", "seg", F.expr(_NAME.format("concat(a, b)")).alias("digest"))
        digests.append(written(joined, "digests"))
    names = None
    for k in reversed(range(len(digests))):
        cuts = digests[k].where(Q("seg") % 2 == 0).select("conv_id", (Q("seg") * 2**k).alias("upper"), ((Q("seg") + 1) * 2**k).alias("cut"), "digest")
        if names is None:
            cuts = cuts.withColumn("above", F.expr(ROOT))
        else:
            upper = names.select("conv_id", Q("cut").alias("upper"), Q("name").alias("above"))
            cuts = cuts.join(upper, ["conv_id", "upper"], "left").withColumn("above", F.coalesce("above", F.expr(ROOT)))
        new = written(cuts.select("conv_id", "cut", F.expr(_NAME.format("concat(above, digest)")).alias("name")), "names")
        names = new if names is None else names.unionByName(new)
    return names


def _named(blocks: DataFrame, cuts: DataFrame | None, base: int) -> DataFrame:
    """The blocks with keys: the name of the prefix above, then of the prefix at each turn."""
    keys = f"aggregate(turns, array(above), (s, x) -> concat(s, array({_NAME.format('concat(element_at(s, -1), x.token)')})))"
    sizes = F.transform("turns", lambda t: t["size"])
    plain = blocks.withColumns({"above": F.expr(ROOT), "below": F.lit(None).cast("binary")})
    if cuts is not None:
        alone = (Q("block") == 0) & (F.size("turns") < base)
        above = cuts.select("conv_id", Q("cut").alias("block"), Q("name").alias("above"))
        below = cuts.select("conv_id", (Q("cut") - 1).alias("block"), Q("name").alias("below"))
        deep = blocks.where(~alone).join(above, ["conv_id", "block"], "left").join(below, ["conv_id", "block"], "left")
        plain = plain.where(alone).unionByName(deep.withColumn("above", F.coalesce("above", F.expr(ROOT))))
    plain = plain.withColumn("keys", F.expr(keys))
    ended = F.when(Q("below").isNull(), Q("keys")).otherwise(F.concat(F.slice("keys", 1, base), F.array("below")))
    return plain.select("conv_id", "block", "total", sizes.alias("sizes"), ended.alias("keys"))


def _nodes(named: DataFrame, convs: DataFrame, base: int) -> DataFrame:
    """key, parent, depth, top (the name above the block), path (names from the block's first turn), size, conv_id, n_convs, n_ends."""
    j = Q("j")
    steps = named.select("*", F.posexplode("sizes").alias("j", "size")).select(
        F.get("keys", j + 1).alias("key"), F.get("keys", j).alias("parent"), F.get("keys", F.lit(0)).alias("top"),
        (Q("block") * base + j + 1).alias("depth"), F.slice("keys", 2, j + 1).alias("path"), "size", "conv_id", "total",
    )
    # All but the members follow from the key, so they can stand in the grouping and sums stay hash aggregates.
    counted = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(Q("depth") == Q("total")).alias("n_ends")]
    nodes = steps.groupBy("key", "parent", "top", "depth", "path", "size").agg(*counted)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(Q("total") == 0).alias("n_ends")).where("n_convs > 0")
    none = F.lit(None).cast("binary")
    root = root.withColumns({"key": F.expr(ROOT), "parent": none, "top": none, "depth": F.lit(0).cast("bigint"), "path": F.array(F.expr(ROOT)), "size": F.lit(0).cast("bigint")})
    leaf, saved = F.when(Q("n_ends") == Q("n_convs"), 1).otherwise(0).cast("bigint"), (Q("n_convs") - 1) * Q("size")
    return nodes.unionByName(root).withColumns({"leaves": leaf, "saved": saved})


def _sums() -> list[Column]:
    return [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]


def _grafted(nodes: DataFrame, cuts: DataFrame | None, most: int, base: int) -> DataFrame:
    """key, leaves, saved: for the root and each cut, the totals of all that stands below it."""
    below = nodes.where("top is not null").groupBy(Q("top").alias("key")).agg(*_sums())
    if cuts is None:
        return below
    at = nodes.where(Q("depth") % base == 0).select("key", F.floor(Q("depth") / base).alias("cut"), "conv_id")
    tops = at.select("key", "cut", "conv_id")
    totals = written(below, "tops")
    paths = cuts.select("conv_id", "cut", Q("name").alias("key"))
    k = 1
    while k <= most:
        # The lower tries of this height begin at cuts that are odd multiples of k; the path above has k cuts.
        lower = tops.where((Q("cut") % (2 * k)) == k).join(totals, "key").select("conv_id", F.explode(F.sequence(Q("cut") - k, Q("cut") - 1)).alias("cut"), "leaves", "saved")
        added = lower.join(paths, ["conv_id", "cut"], "left").select(F.coalesce("key", F.expr(ROOT)).alias("key"), "leaves", "saved")
        totals = written(totals.unionByName(added).groupBy("key").agg(*_sums()), "tops")
        k *= 2
    return totals


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, first id, the ids of up to CHUNK consecutive rows of a key, comma-joined; from sorted key, conv_id."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or keys[k] != keys[at] or k - at == CHUNK:
                out.append((keys[at], ids[at], ",".join(map(str, ids[at:k]))))
                at = k
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each key over its chunks, which come sorted; only the running state is kept."""
    now, state = None, None

    def row(key: bytes, digest: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest])], names=["key", "ends_sha256"])

    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == now:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                keys.append(now)
                digests.append(state.hexdigest())
            now, state = key, hashlib.sha256(ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])
    if state is not None:
        yield row(now, state.hexdigest())


def _ends(named: DataFrame, convs: DataFrame, base: int) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end."""
    last = named.where(Q("block") * base + F.size("sizes") == Q("total")).select(F.element_at("keys", -1).alias("key"), "conv_id")
    ends = last.unionByName(convs.where("total = 0").select(F.expr(ROOT).alias("key"), "conv_id"))
    parts = _parts(ends)
    chunks = ends.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first bigint, ids string")
    return chunks.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, base: int = BASE) -> DataFrame:
    """A row for each node, from conversations (conv_id, total) and their turns (conv_id, total, pos, token, size)."""
    turn = F.struct("pos", "token", "size")
    at = F.floor(Q("pos") / base)
    blocks = written(turns.groupBy("conv_id", at.alias("block"), "total").agg(F.sort_array(F.collect_list(turn)).alias("turns")), "blocks")
    most = (convs.agg(F.max("total")).first()[0] or 0) // base
    cuts = _cut_names(blocks, most, base)
    named = written(_named(blocks, cuts, base), "named")
    nodes = written(_nodes(named, convs, base), "nodes")
    zero = F.lit(0).cast("bigint")
    tops = _grafted(nodes, cuts, most, base).join(nodes.select("key", "path"), "key")
    added = (
        nodes.select(F.explode("path").alias("key"), "leaves", "saved", zero.alias("children"))
        .unionByName(tops.select(F.explode("path").alias("key"), "leaves", "saved", zero.alias("children")))
        .unionByName(nodes.where("parent is not null").select(Q("parent").alias("key"), zero.alias("leaves"), zero.alias("saved"), F.lit(1).cast("bigint").alias("children")))
    )
    totals = added.groupBy("key").agg(*_sums(), F.sum("children").alias("children"))
    whole = nodes.select("key", "parent", "depth", "conv_id", "n_convs").join(totals, "key").join(_ends(named, convs, base), "key", "left")
    whole = written(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "trie")
    parents = whole.where("children > 0").select(Q("key").alias("parent"), Q("conv_id").alias("parent_conv_id"), "children")
    below = whole.where("parent is not null").withColumnRenamed("children", "n_children")
    top = whole.where("parent is null").withColumnRenamed("children", "n_children").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", Q("leaves").alias("n_leaves"), Q("saved").alias("saved_tokens"), "ends_sha256"]
    return join_unique(below, parents, "parent", "children").select(*columns).unionByName(top.select(*columns))


def prefix_trie(conversations: DataFrame, shared_heads: bool = False, base: int = BASE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    conv_id is the smallest member; with the depth it names the node. saved_tokens: over the node's subtree, the code
    points of last texts that the trie stores once instead of once for each member. shared_heads: of rebuilt()
    conversations.
    """
    turns = numbered(conversations)
    return trie(*(rebuilt if shared_heads else as_they_are)(turns), base)
