r"""SimHash near-dedup by anchor-point covering.

Fingerprint: lower-case A-Z, words between ASCII white space, 4-word shingles with repeats (fewer words: the whole
sequence), XXH64 with seed 42 of each; a bit is set when it is in over half of the hashes. No words: fingerprint zero.

Linking. Distinct fingerprints link at `THRESHOLD` = 4 or fewer differing bits. Of the two 32-bit halves of such a
pair, one differs in at most two bits. Each half is covered by a code: the perfect [23,12] Golay code on 23 bits
(covering radius 3) and all words on the other 9, so that every half lies within 3 of an anchor. Let two halves
differ in at most 2 bits and m be a half between them, at most 1 from each; m lies within 3 of an anchor, so both
lie within 3 + 1. Each half is therefore copied to every anchor within the covering radius plus its part of the
threshold, 4 (20 anchors on average, whatever the number of documents), and no linked pair is missed. Fingerprints
are compared whole, per anchor. From an anchor come only the links of a spanning forest of its linked fingerprints,
never all its pairs: a fingerprint is compared with those that are not yet reached.

An anchor with over `crowded` fingerprints is dealt out again by the other half: its 32 bits are cut into five
blocks, of which one is equal in a linked pair, and the pieces are compared alike. That is exact as well.

Components of the links are found by alternating large-star and small-star steps over written tables, in a number
of rounds that grows with the logarithm of the size; nothing about documents passes through the driver.

`keep_one`, the stage of a pipeline, takes five-word shingles and a similarity (Jaccard) of 0.8 or more. A fingerprint of
shingles differs in some ten bits at that similarity, so the covering would need a thousand copies; one of single
words, with their counts, differs in five or fewer in 98 of 100 such pairs, which the same anchors cover (of five bits,
too, one half has at most two). Anchors are therefore those of the word fingerprints, within an anchor the pair's
shingle fingerprints must be within `SHINGLE_BITS`, which leaves out texts that only share their words, and of what is left
the similarity is estimated from the SKETCH smallest shingle hashes of both, with a standard error of 0.035. Pairs with
an estimate within MARGIN of 0.8, three such errors, are decided by all shingles of their texts. Per anchor the links of spanning forests from two centers are tried, never all pairs of a group.

What that leaves out is found by an exact join by prefixes. All shingles have one order, rare ones first: two sets alike to 0.8
share a shingle among the first n - ceil(0.8 n) + 1 of each, and at the first one they share what is left of both sets must
suffice for the overlap. Texts meet at these shingles, and those that are in different components by then are decided by all
their shingles. Any order gives the same pairs; which shingles are frequent is counted on some ORDER_TEXTS texts, and
those over `crowded` texts are dealt out in blocks, each pair of blocks by itself.

Nulls, ties and edges: a null text is empty; texts without words all have fingerprint zero and link to each other.
A component's id is its smallest doc_id. Rows that repeat a doc_id belong to the component of that fingerprint.
Rows with a null doc_id get a fingerprint and component, but never give a component its name, unless all are null.
`keep_one` leaves one row of every component, also of those without a doc_id, and where rows of one doc_id differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_unique, trimmed, written
from .tokens import small_slices

SHINGLE = 4
SEED = 42
THRESHOLD = 4
RADIUS = 3
HALF_SHARE = 1
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
CROWDED = 20_000
#: Of keep_one: words in a shingle, the least similarity, bits in which a pair's word and shingle fingerprints may
#: differ (the first is what the anchors cover, see above; the second is 32 on average for texts that share no shingle),
#: and shingle hashes in a sketch.
SIMILAR_SHINGLE, SIMILAR = 5, 0.8
WORD_BITS, SHINGLE_BITS = 5, 16
SKETCH = 128
#: Three standard errors of a sketch's estimate near SIMILAR; pairs below SIMILAR by more are left to the join by prefixes.
MARGIN = 0.105
#: Texts on which the frequent shingles are counted, in how many of them one is frequent, and how many are told to the
#: workers. They give the order of shingles only, and no result depends on it.
ORDER_TEXTS, FREQUENT, FREQUENT_MOST = 10_000, 3, 200_000
#: An estimate further below SIMILAR is over eight errors off, which leaves fewer than one pair in 10^12 out.
FAR = 0.3
#: So many ids of texts to verify are broadcast at most.
FEW = 100_000
_SPACE = bytes(c if not 65 <= c <= 90 else c + 32 for c in range(256))
_BLANKS = b" \t\n\x0b\x0c\r"


# ---- fingerprints


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE).split()  # bytes split at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # one past the space after each word
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] - 1 if len(words) >= SHINGLE else ends[-1:] - 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        set_bits += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text, which tells rows of one doc_id apart), fp: the fingerprint as a bigint of the same bits."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, th bigint, fp bigint")


def _text_hash() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


# ---- anchors


@cache
def _cover() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Error patterns by syndrome: where those of a syndrome begin, the patterns of weight up to RADIUS + HALF_SHARE,
    and tables that give the syndrome of a half byte by byte. The 9 upper bits of a half are not coded."""
    column = []
    for bit in range(23):  # x^bit modulo the generator
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        column.append(r)
    column += [0] * 9
    patterns, syndromes = [], []
    for weight in range(RADIUS + HALF_SHARE + 1):
        for bits in combinations(range(32), weight):
            e = s = 0
            for b in bits:
                e |= 1 << b
                s ^= column[b]
            patterns.append(e)
            syndromes.append(s)
    s, e = np.array(syndromes), np.array(patterns, np.uint32)
    order = np.argsort(s, kind="stable")
    begin = np.searchsorted(s[order], np.arange(2**11 + 1))
    tables = []
    for byte in range(4):
        t = np.zeros(256, np.int64)
        for v in range(256):
            for b in range(8):
                if v >> b & 1:
                    t[v] ^= column[8 * byte + b]
        tables.append(t)
    return begin, e[order], tables


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For uint64 fingerprints: (index, anchor) for both halves of each; the half's number is bit 32 of the anchor."""
    begin, patterns, tables = _cover()
    index, anchor = [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)).astype(np.uint32)
        syndrome = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]
        count = begin[syndrome + 1] - begin[syndrome]
        i = np.repeat(np.arange(len(x)), count)
        within = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        e = patterns[begin[syndrome][i] + within]
        index.append(i)
        anchor.append((x[i] ^ e).astype(np.int64) | (half << 32))
    return np.concatenate(index), np.concatenate(anchor)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            fps = batch.column(0).slice(k, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            index, anchor = anchors_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[index].view(np.int64))], names=["anchor", "fp"])


def _forest(fps: np.ndarray, out: list[np.ndarray]) -> None:
    """Links of a spanning forest of the fingerprints within THRESHOLD of each other; compares with those not yet reached."""
    rest = np.unique(fps)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            at, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ at) <= THRESHOLD
            if near.any():
                new = rest[near]
                out.append(np.stack([np.full(len(new), at), new]))
                front = np.concatenate([front, new])
                rest = rest[~near]


def _compare(keys: list[np.ndarray], fps: np.ndarray) -> np.ndarray:
    """Links among rows that are sorted by their keys. Small groups row against row k places on, larger ones by forest."""
    n = len(fps)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    out: list[np.ndarray] = []
    small = size <= 32
    group = np.repeat(np.arange(len(begin)), size)
    row = np.repeat(small & (size > 1), size)
    at = np.flatnonzero(row)
    for lag in range(1, 32):
        at = at[at + lag < n]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        x = fps[at] ^ fps[at + lag]
        hit = at[(np.bitwise_count(x) <= THRESHOLD) & (x != 0)]
        out.append(np.stack([fps[hit], fps[hit + lag]]))
    for g in np.flatnonzero(~small):
        _forest(fps[begin[g] : begin[g] + size[g]], out)
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by all columns but the last, fp; a group that a batch cuts waits for the rest of it."""
    kept: list[np.ndarray] | None = None

    def links(columns):
        a, b = _compare(columns[:-1], columns[-1].view(np.uint64))
        low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        pairs = np.unique(np.stack([low, high]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate([k, c]) for k, c in zip(kept, columns, strict=True)]
        differs = np.zeros(len(columns[-1]), bool)
        for c in columns[:-1]:
            differs |= c != c[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield links([c[:cut] for c in columns])
        kept = [c[cut:] for c in columns]
    if kept is not None and len(kept[-1]):
        yield links(kept)


def near_pairs(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp, distinct) that connect all those within THRESHOLD."""
    dealt = fps.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint")
    # Counting the anchors first costs a pass over integers only; those that are crowded are fewer than rows / crowded.
    full = written(dealt.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor"), "crowded")
    if full.isEmpty():
        return dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a bigint, b bigint").distinct()
    rest = dealt.join(full, "anchor", "left_anti")
    common = rest.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a bigint, b bigint")
    other = F.expr("if(shiftright(anchor, 32) = 0, shiftrightunsigned(fp, 32), fp & 4294967295L)")
    block = F.expr("transform(sequence(0, 4), k -> named_struct('k', k, 'v', shiftright(o, k * 7) & if(k < 4, 127L, 15L)))")
    pieces = dealt.join(full, "anchor", "left_semi").withColumn("o", other).select("anchor", F.explode(block).alias("x"), "fp").select("anchor", F.col("x.k").cast("bigint").alias("k"), F.col("x.v").alias("v"), "fp")
    dense = pieces.repartition("anchor", "k", "v").sortWithinPartitions("anchor", "k", "v").mapInArrow(_links, "a bigint, b bigint")
    return common.unionByName(dense).distinct()


# ---- components


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root for every node of the links (a, b): root is the smallest node reachable.

    Alternating stars: large-star links each node's larger neighbours to the smallest one, small-star the smaller
    ones, until no link changes. Each round is a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        # The center of a large star is a hot key: its links are looked up where they are.
        joined = join_unique(both, low, "u", "n", total).drop("n")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(max_rounds):
        edges = written(star(star(edges, True, 2 * before[0]), False, before[0]), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _named(prints: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """prints with root (a node that stands for the component) and component_id, for every row."""
    distinct = written(prints.groupBy(node).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-nodes")
    roots = written(components(links), "roots")
    by_root = roots.join(distinct.select(F.col(node).alias("node"), "first_id"), "node")
    names = by_root.groupBy("root").agg(F.min("first_id").alias("name"))
    named = by_root.join(names, "root").select(F.col("node").alias(node), "root", "name")
    classes = distinct.join(named, node, "left").select(node, "n", F.coalesce("root", node).alias("root"), F.coalesce("name", "first_id").alias("component_id"))
    return join_unique(prints, written(classes, "classes"), node, "n")


def classified(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, th, fp, root (a fingerprint that stands for the component), component_id, for every row of docs."""
    prints = written(fingerprints(docs), "fingerprints")
    return _named(prints, near_pairs(prints.select("fp").distinct(), crowded), "fp")


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for every row of docs."""
    return classified(docs, crowded).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similar texts, for a pipeline


def _shingle_hashes(words: list[bytes], line: bytes) -> np.ndarray:
    """A hash of each five-word shingle, repeats included, of words that line joins."""
    from xxhash import xxh64_intdigest

    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - SIMILAR_SHINGLE + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    last = (ends[SIMILAR_SHINGLE - 1 :] if len(words) >= SIMILAR_SHINGLE else ends[-1:]) - 1
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), np.uint64, n)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE).split()
    return np.unique(_shingle_hashes(words, b" ".join(words))) if words else np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["node", "shingles"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 0):
            sets = [shingle_set(t.as_py()) for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequent shingles, sorted, in how many texts of a sample each is, and how many texts stand for one of it. rows: th, text."""
    share = max(1, rows.count() // ORDER_TEXTS)
    some = rows.where(F.pmod("th", F.lit(share)) == 0).dropDuplicates(["th"]).select("text")
    counts = some.mapInArrow(lambda b: trimmed(_each_shingle(b)), "shingle bigint").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT_MOST).toArrow()
    shingle, count = found.column("shingle").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], count[order], float(share)


def _counts_of(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """In how many texts of the sample each shingle is, 0 for those that are not frequent."""
    known, count, _ = frequent
    if not len(known):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, count[at], 0)


def prefix_of(shingles: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which every set that is alike to `least` has one among its own first."""
    n = len(shingles)
    most = n - int(np.ceil(least * n - 1e-6)) + 1 if n else 0
    return shingles[np.lexsort((shingles, _counts_of(shingles, frequent)))[:most]]


def similar_prints(text: str | None) -> tuple[int, int, int, bytes, np.ndarray]:
    """Of a text: a hash of its words in order, the fingerprints of its words and of its shingles, the sketch, and its distinct shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE).split()
    line = b" ".join(words)
    if not words:
        return xxh64_intdigest(line, SEED), 0, 0, b"", np.zeros(0, np.uint64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    shingles, n = _shingle_hashes(words, line), max(1, len(words) - SIMILAR_SHINGLE + 1)
    of_words = np.fromiter((xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    distinct = np.unique(shingles)
    sketch = np.unique((distinct >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return xxh64_intdigest(line, SEED), _majority(of_words, np.fromiter(counts.values(), np.int64, len(counts))), _majority(shingles, np.ones(n, np.int64)), sketch.tobytes(), distinct


def _majority(hashes: np.ndarray, weights: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, by weight."""
    on = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        on += weights[k : k + 65536] @ np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(on * 2 > weights.sum()).tobytes(), "big")


def _all_prints(batches: Iterator[pa.RecordBatch], least: float, frequent) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "node", "u", "s", "sketch", "n", "prefix"]
    for batch in batches:
        for part in small_slices(batch, 2):
            found = []
            for t in part.column(2):
                *prints, shingles = similar_prints(t.as_py())
                found.append((*prints, len(shingles), prefix_of(shingles, least, frequent.value).tobytes()))
            numbers = [pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64)) for i in range(3)]
            rest = [pa.array([f[3] for f in found], pa.binary()), pa.array([f[4] for f in found], pa.int64()), pa.array([f[5] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, *rest], names=names)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            u, s, node = (batch.column(i).slice(k, 20_000).to_numpy(zero_copy_only=False) for i in range(3))
            index, anchor = anchors_of(u.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(u[index]), pa.array(s[index]), pa.array(node[index])], names=["anchor", "u", "s", "node"])


def _stars(u: np.ndarray, s: np.ndarray, node: np.ndarray, out: list) -> None:
    """Links of two spanning forests of one group, begun at the text nearest to what most have and at the smallest node."""
    node, at = np.unique(node, return_index=True)
    u, s = u[at], s[at]
    bits = np.unpackbits(s.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    middle = np.uint64(int.from_bytes(np.packbits(bits * 2 > len(s)).tobytes(), "big"))
    for order in (np.argsort(np.bitwise_count(s ^ middle), kind="stable"), np.arange(len(node))):
        rest = order
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                c = front.pop(0)
                near = (np.bitwise_count(u[rest] ^ u[c]) <= WORD_BITS) & (np.bitwise_count(s[rest] ^ s[c]) <= SHINGLE_BITS)
                if near.any():
                    new = rest[near]
                    out.append(np.stack([np.full(len(new), node[c]), node[new]]))
                    front += new.tolist()
                    rest = rest[~near]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by all columns but the last three (u, s, node); a group that a batch cuts waits for the rest of it."""
    kept: list[np.ndarray] | None = None

    def links(c):
        new = np.ones(len(c[-1]), bool)
        new[1:] = False
        for key in c[:-3]:
            new[1:] |= key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size, out = np.diff(np.append(begin, len(new))), []
        u, s, node = c[-3].view(np.uint64), c[-2].view(np.uint64), c[-1]
        # Small groups row against row k places on.
        at, group = np.flatnonzero(np.repeat((size > 1) & (size <= 32), size)), np.repeat(np.arange(len(begin)), size)
        for lag in range(1, 32):
            at = at[at + lag < len(node)]
            at = at[group[at] == group[at + lag]]
            if not len(at):
                break
            hit = at[(np.bitwise_count(u[at] ^ u[at + lag]) <= WORD_BITS) & (np.bitwise_count(s[at] ^ s[at + lag]) <= SHINGLE_BITS) & (node[at] != node[at + lag])]
            out.append(np.stack([node[hit], node[hit + lag]]))
        for g in np.flatnonzero(size > 32):
            of = slice(begin[g], begin[g] + size[g])
            _stars(u[of], s[of], node[of], out)
        pairs = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate([k, c]) for k, c in zip(kept, columns, strict=True)]
        differs = np.zeros(len(columns[-1]), bool)
        for c in columns[:-3]:
            differs |= c != c[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield links([c[:cut] for c in columns])
        kept = [c[cut:] for c in columns]
    if kept is not None and len(kept[-1]):
        yield links(kept)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard of the shingles behind two sketches; two texts without words are alike."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.union1d(x, y)[:SKETCH] if max(len(x), len(y)) == SKETCH else np.union1d(x, y)
    return float((np.isin(both, x) & np.isin(both, y)).mean()) if len(both) else 1.0


def exact_similarity(a: bytes, b: bytes) -> float:
    """Jaccard of two whole shingle sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have this similarity by their whole shingle sets. prints: doc_id, th, node; rows: doc_id, th, text."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One row stands for a node, whatever the number of its copies.
    one = prints.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x")).join(nodes, "node").select("node", F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"))
    one = written(one, "to-verify")
    if one.count() <= FEW:
        one = F.broadcast(one)  # the texts stay where they are
    texts = rows.join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("node", "text")
    sets = written(texts.mapInArrow(lambda b: trimmed(_sets(b)), "node bigint, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    @F.arrow_udf("double")
    def of_sets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return trimmed(pa.array([exact_similarity(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)], pa.float64()) for x, y in batches)

    return with_both.where(of_sets("x", "y") >= least).select("a", "b")


def _prefix_rows(batches: Iterator[pa.RecordBatch], crowded: int, frequent) -> Iterator[pa.RecordBatch]:
    """From (node, class, n, prefix) a row for each shingle of a prefix: shingle, part (of a crowded one: a pair of blocks), n, at, class, node."""
    names = ["shingle", "part", "n", "at", "class", "node"]
    for batch in batches:
        for part in small_slices(batch, 3):
            prefixes = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
            size = np.array([len(x) for x in prefixes])
            shingle = np.concatenate(prefixes)
            row, at = np.repeat(np.arange(len(size)), size), np.arange(len(shingle)) - np.repeat(np.cumsum(size) - size, size)
            node, own, n = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            blocks = np.ceil(_counts_of(shingle, frequent.value) * frequent.value[2] / crowded).astype(np.int64)
            many = np.flatnonzero(blocks > 1)
            key = np.zeros(len(shingle), np.int64)
            found = [(np.flatnonzero(blocks <= 1), key[blocks <= 1])]
            for k in many.tolist():
                mine = int(node[row[k]].view(np.uint64) % np.uint64(blocks[k]))
                others = np.arange(blocks[k])
                found.append((np.full(len(others), k), np.minimum(mine, others) * blocks[k] + np.maximum(mine, others)))
            pick, key = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            r = row[pick]
            for k in range(0, len(pick), 50_000):
                some = slice(k, k + 50_000)
                arrays = [shingle[pick[some]].view(np.int64), key[some], n[r[some]], at[pick[some]], own[r[some]], node[r[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)


def _met(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle, part and n: pairs of different classes that can have the overlap, by their sizes and what is left of both sets."""
    kept: list[np.ndarray] | None = None

    def possible(i, j, n, at, own):
        need = least / (1 + least) * (n[i] + n[j]) - 1e-6
        return (own[i] != own[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need) & (n[i] >= least * n[j] - 1e-6)

    def batch_of(out):
        pairs = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def pairs_of(shingle, part, n, at, own, node):
        new = np.ones(len(node), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(node)))
        group, out = np.repeat(np.arange(len(begin)), size), []
        row = np.flatnonzero(np.repeat((size > 1) & (size <= 32), size))
        for lag in range(1, 32):
            row = row[row + lag < len(node)]
            row = row[group[row] == group[row + lag]]
            if not len(row):
                break
            hit = row[possible(row, row + lag, n, at, own)]
            out.append(np.stack([node[hit], node[hit + lag]]))
        for g in np.flatnonzero(size > 32):
            end, waiting = begin[g] + size[g], 0
            for i in range(begin[g], end - 1):
                j = np.arange(i + 1, begin[g] + np.searchsorted(n[begin[g] : end], n[i] / least + 1e-6, side="right"))
                j = j[possible(i, j, n, at, own)]
                if len(j):
                    out.append(np.stack([np.full(len(j), node[i]), node[j]]))
                    waiting += len(j)
                if waiting > 500_000:
                    yield batch_of(out)
                    out, waiting = [], 0
        if out:
            yield batch_of(out)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate([k, c]) for k, c in zip(kept, columns, strict=True)]
        differs = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield from pairs_of(*(c[:cut] for c in columns))
        kept = [c[cut:] for c in columns]
    if kept is not None and len(kept[-1]):
        yield from pairs_of(*kept)


def _left_out(prints: DataFrame, links: DataFrame, least: float, crowded: int, frequent) -> DataFrame:
    """a, b: all pairs of texts of different components of the links that can be alike, by shared shingles of their prefixes."""
    roots = components(links).withColumnRenamed("root", "class")
    placed = prints.select("node", "n", "prefix").dropDuplicates(["node"]).join(roots, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "n", "prefix")
    met = placed.mapInArrow(lambda b: trimmed(_prefix_rows(b, crowded, frequent)), "shingle bigint, part bigint, n bigint, at bigint, class bigint, node bigint")
    keys = ("shingle", "part")
    return met.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(lambda b: trimmed(_met(b, least)), "a bigint, b bigint").distinct()


def similar_pairs(prints: DataFrame, rows: DataFrame, frequent, least: float = SIMILAR, crowded: int = CROWDED) -> DataFrame:
    """a, b: links between distinct nodes whose texts have at least this similarity, which connect all such nodes.

    prints: doc_id, th, node, u, s, sketch, n, prefix; rows: doc_id, th, text; frequent: a broadcast of `_frequent`.
    """
    texts = written(prints.select("node", "u", "s", "sketch").dropDuplicates(["node"]), "texts-of-nodes")
    dealt = texts.select("u", "s", "node").mapInArrow(lambda b: trimmed(_dealt(b)), "anchor bigint, u bigint, s bigint, node bigint")
    full = written(dealt.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor"), "crowded")
    pair = "a bigint, b bigint"
    apart = lambda rows, *keys: rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "u", "s", "node").mapInArrow(lambda b: trimmed(_candidates(b)), pair)
    if full.isEmpty():
        found = apart(dealt, "anchor")
    else:
        # Of six blocks of the other half one is equal in a pair of WORD_BITS = 5 or fewer differing bits.
        other = F.expr("if(shiftright(anchor, 32) = 0, shiftrightunsigned(u, 32), u & 4294967295L)")
        block = F.expr("transform(sequence(0, 5), k -> named_struct('k', k, 'v', shiftright(o, k * 5) & if(k < 5, 31L, 127L)))")
        pieces = dealt.join(full, "anchor", "left_semi").withColumn("o", other).select("anchor", F.explode(block).alias("x"), "u", "s", "node")
        pieces = pieces.select("anchor", F.col("x.k").cast("bigint").alias("k"), F.col("x.v").alias("v"), "u", "s", "node")
        found = apart(dealt.join(full, "anchor", "left_anti"), "anchor").unionByName(apart(pieces, "anchor", "k", "v"))
    found = written(found.distinct(), "candidates")

    @F.arrow_udf("double")
    def of_sketches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return trimmed(pa.array([similarity(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64()) for x, y in batches)

    def estimated(pairs: DataFrame, lowest: float) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
        with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").withColumn("e", of_sketches("x", "y"))
        full = (F.octet_length("x") == 4 * SKETCH) | (F.octet_length("y") == 4 * SKETCH)
        return written(with_both.where(F.col("e") >= lowest).select("a", "b", (full & (F.col("e") < least + MARGIN)).alias("open"), "e"), "estimates")

    scored = estimated(found, least - MARGIN)
    sure = scored.where(~F.col("open") & (F.col("e") >= least)).select("a", "b")
    links = written(sure.unionByName(_verified(scored.where("open").select("a", "b"), prints, rows, least)), "similar")
    left_out = _left_out(prints, links, least, crowded, frequent).join(scored.select("a", "b"), ["a", "b"], "left_anti")
    return links.unionByName(_verified(estimated(written(left_out, "left-out"), least - FAR).select("a", "b"), prints, rows, least))


def similar_classes(docs: DataFrame, least: float = SIMILAR, crowded: int = CROWDED) -> DataFrame:
    """doc_id, th, node, root, component_id for every row of docs, by similarity of five-word shingles."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(rows))
    found = rows.mapInArrow(lambda b: trimmed(_all_prints(b, least, frequent)), "doc_id bigint, th bigint, node bigint, u bigint, s bigint, sketch binary, n bigint, prefix binary")
    prints = written(found, "prints")
    return _named(prints.select("doc_id", "th", "node"), similar_pairs(prints, rows, frequent, least, crowded), "node")


def keep_one(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """One row of each component of similar texts, with all its columns: the one whose doc_id names it.

    Of several rows of that doc_id the one with the smallest hash of its text stays, and of a component without any
    doc_id likewise, so that no component is lost.
    """
    named = similar_classes(docs, crowded=crowded).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = written(named.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min("th").alias("__th"), F.count(F.lit(1)).alias("n")), "kept")
    kept = docs.join(keep.select("__id", "__th"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__th")), "left_semi")
    # Rows that repeat doc_id and text are rare; only where there can be any are the texts grouped.
    return kept if keep.where("n > 1").isEmpty() else kept.withColumn("__th", _text_hash()).dropDuplicates(["doc_id", "__th"]).drop("__th")
