r"""Token-id output in training order, as fixed-stride binary shards.

The rows of one input split, a byte range of one file, form a token stream, each document ended by the end token; the
stream is cut into sequences of `length` ids. A byte-level token has one byte at least, so the bytes of a split,
which a first pass sums up without encoding anything, bound its number of sequences, and every split gets its own
range of ordinals. A keyed Feistel permutation over the next power of four, walked along its cycle until it falls
below the number of ordinals, gives every sequence its place in the training order. Ranges of places are shards:
each is sorted and written as a file of records of `length` two-byte ids and one closing byte. Record k of a shard
begins at k * (2 * length + 1). With a `window`, the permutation goes on inside each window of so many ordinals alone:
the order of the rows then holds from window to window, so a table in the order of a mix keeps the mix's shares in
every stretch of slots. Ordinals that no sequence took leave no gap in the files: the global slot of a record
is the number of records of the shards before it plus k, and slots run from 0 without a gap in the permuted order. So
a reader can begin at any slot, knowing the sizes of the files alone.

Splits have at most SPLIT_BYTES, or the session's maxPartitionBytes where that is lower, whatever the number of cores,
so the same files and key give the same training order on every cluster. Rows that a filter leaves out do not divide
a split. Texts are read, encoded and sent once, as ids; they are never shuffled. The driver and every worker hold two
integers for each split (50 MB at 100 TB). Shards are written by Spark's own writer, so tasks can fail and run again.

Nulls, ties and edges: a null or empty text gives its end token alone; a very long one is encoded in stretches that
begin at proven boundaries. Special strings inside texts are ordinary text. Repeated rows are encoded each. An empty
table writes no shard. The last sequence of a split is filled up with end tokens. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, trimmed, written
from .tokens import cut_at, small_slices

TOKENIZER = "byte_bpe_50k.tiktoken"
LENGTH = 512
#: Ordinals of a shard. A token takes two to four bytes of prose, so a quarter to a half of them become records; with
#: windows, those of one shard can all be taken and those of another none.
PER_SHARD = 16_384
#: Ordinals of a window of a table in the order of a mix: some 100 blocks of the mix, a frame, where a document has 2.5 sequences.
MIX_WINDOW = 4096
#: Fixed value: the end-of-text id of the byte-level vocabularies.
END = 50_256
ROUNDS = 4
SPLIT_BYTES = 32 * 2**20


_ENCODERS: dict[str, object] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str):
    """The worker's own, kept for its next task."""
    import public_tokenizers
    import tiktoken

    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 2**16:
            raise ValueError("ids of two bytes are asked for, and the vocabulary is larger")
        _ENCODERS.clear()
        _ENCODERS[path] = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


# ---- the permutation


def feistel(x: np.ndarray, n: int, key: int | str) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to x."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            m = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            m ^= m >> np.uint64(29)
            m *= np.uint64(0xBF58476D1CE4E5B9)
            m ^= m >> np.uint64(32)
            left, right = right, (left ^ m) & mask
        return left << np.uint64(half) | right

    out = once(np.asarray(x, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def places(first: int, n: int, total: int, window: int | None, key: int) -> np.ndarray:
    """The places of n ordinals from `first` on: permuted over all `total`, or inside each window by a key of its own."""
    if window is None:
        return feistel(np.arange(first, first + n), total, key)
    out = [np.empty(0, np.int64)]
    for w in range(first // window, -(-(first + n) // window)):
        at = w * window
        inside = np.arange(max(first, at) - at, min(first + n, at + window) - at)
        out.append(at + feistel(inside, min(window, total - at), f"{key}/{w}"))
    return np.concatenate(out)


# ---- the stream


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.Array]]:
    """Slices of the texts of (split, text), with the split that begins there, or None where the last one goes on."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        split = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), len(split)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            new = int(split[a])
            for part in small_slices(batch.slice(a, b - a), 1, 250_000):
                yield (None if new == last else new), part.column(1)
                last = new


def _sequences(batches: Iterator[pa.RecordBatch], path: str, offsets, total: int, length: int, per_shard: int, key: int, end: int, window: int | None) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    splits, firsts = offsets.value
    stop = np.array([end], "<u2").tobytes()
    size = 2 * length
    left, ordinal = b"", 0

    def rows(data: bytes) -> pa.RecordBatch:
        n = len(data) // size
        place = places(ordinal, n, total, window, key)
        return pa.RecordBatch.from_arrays([pa.array(place // per_shard), pa.array(place), pa.array([data[k * size : (k + 1) * size] for k in range(n)], pa.binary())], names=["shard", "place", "record"])

    for split, texts in _pieces(batches):
        if split is not None:
            if left:
                yield rows(left + stop * ((size - len(left)) // 2))
            left, ordinal = b"", int(firsts[np.searchsorted(splits, split)])
        data = [left]
        for text in texts.to_pylist():
            data += [np.array(e.encode_ordinary(t), "<u2").tobytes() for t in cut_at(text or "")]
            data.append(stop)
        data = b"".join(data)
        whole = len(data) // size * size
        if whole:
            yield rows(data[:whole])
            ordinal += whole // size
        left = data[whole:]
    if left:
        yield rows(left + stop * ((size - len(left)) // 2))


def _located(docs: DataFrame) -> DataFrame:
    """file, start (of the split), text: rows by their place in the table's files; what is no such table is written first."""
    place = lambda d: d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("text").cast("string").alias("text"))
    try:
        return place(docs)
    except AnalysisException:
        return place(written(docs.select("text"), "texts"))


@contextmanager
def _fixed_splits(spark: SparkSession, most: int):
    """Splits by file and bytes alone while this lasts: the number of cores has no say in them."""
    parts, size = "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"
    before = {name: spark.conf.get(name, None) for name in (parts, size)}
    spark.conf.set(parts, "1")
    if _bytes_of_setting(spark.conf.get(size)) > most:
        spark.conf.set(size, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _bytes_of_setting(text: str) -> int:
    number = text.lower().removesuffix("b")
    return int(number[:-1]) << 10 * (1 + "kmgtp".index(number[-1])) if number[-1:] in "kmgtp" else int(number)


def write_shards(docs: DataFrame, out: str, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 17, end: int = END, window: int | None = None, split_bytes: int = SPLIT_BYTES) -> int:
    """Writes the shards under `out` and returns the number of ordinals that were dealt out, 0 without documents.

    window: ordinals are permuted inside windows of so many, which follow the rows by file and row; None: all over.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or default_path()
    with _fixed_splits(spark, split_bytes):
        rows = _located(docs)
        split = F.xxhash64("file", "start").alias("split")
        bound = F.expr(f"cast(ceil(sum(coalesce(octet_length(text), 0) + 1) / {length}) as bigint)").alias("n")
        # part-100000 comes after part-99999
        sizes = rows.groupBy("file", "start").agg(bound).orderBy(F.length("file"), "file", "start").select(split, "n").toArrow()
        splits, n = (sizes.column(k).to_numpy() for k in (0, 1))
        total = int(n.sum())
        if not total:
            return 0
        order = np.argsort(splits)
        if (np.diff(splits[order]) == 0).any():
            raise RuntimeError("two splits have one hash: write with another split_bytes")
        offsets = spark.sparkContext.broadcast((splits[order], (np.cumsum(n) - n)[order]))
        shards = -(-total // per_shard)
        sequences = rows.select(split, "text").mapInArrow(lambda b: trimmed(_sequences(b, path, offsets, total, length, per_shard, key, end, window)), "shard bigint, place bigint, record binary")
        ranged = sequences.repartitionById(min(shards, 20_000), (F.col("shard") % 20_000).cast("int")).sortWithinPartitions("shard", "place")
        # Spark writes the bytes of a string as they are, and here they are no text; a shard is one file, or its slots would repeat.
        ranged.select("shard", F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).partitionBy("shard").text(out)
        return total


def manifest(spark: SparkSession, out: str, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(shard, its first slot, its records), from the sizes of the files alone; one row for each shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out).groupBy("shard").agg(F.sum("length").alias("bytes"))
    at, rows = 0, []
    for shard, size in sorted((int(r["shard"]), r["bytes"]) for r in files.collect()):
        rows.append((shard, at, size // (2 * length + 1)))
        at += rows[-1][2]
    return rows


def _read(batches: Iterator[pa.RecordBatch], length: int, firsts: dict[int, int], first_slot: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """slot, shard, offset and the record, or of it n_tokens, n_ends and its SHA-256. Encoding is over: the worker's encoder goes."""
    _ENCODERS.clear()
    stride = 2 * length + 1
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at = memoryview(content.as_buffer()), firsts[shard]
            n = len(data) // stride
            for k in range(max(0, first_slot - at), n, 1000):
                some = range(k, min(k + 1000, n))
                places = [pa.array([at + i for i in some], pa.int64()), pa.array([shard] * len(some), pa.int64()), pa.array([i * stride for i in some], pa.int64())]
                records = [data[i * stride : (i + 1) * stride - 1] for i in some]
                if digest:
                    ends = [int((np.frombuffer(r, "<u2") == END).sum()) for r in records]
                    found = [pa.array([length] * len(some), pa.int64()), pa.array(ends, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in records])]
                    yield pa.RecordBatch.from_arrays([*places, *found], names=["slot", "shard", "offset", "n_tokens", "n_ends", "record_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*places, pa.array(map(bytes, records), pa.binary())], names=["slot", "shard", "offset", "record"])


def _opened(spark: SparkSession, out: str, length: int, first_slot: int, digest: bool, schema: str) -> DataFrame:
    rows = manifest(spark, out, length)
    firsts = {shard: at for shard, at, _ in rows}
    begin = min((shard for shard, at, n in rows if at + n > first_slot), default=0)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out).where(F.col("shard") >= begin)
    return files.select(F.col("shard").cast("bigint").alias("shard"), "content").mapInArrow(lambda b: trimmed(_read(b, length, firsts, first_slot, digest)), schema)


def read_shards(spark: SparkSession, out: str, length: int = LENGTH, first_slot: int = 0) -> DataFrame:
    """slot, shard, offset, record, from `first_slot` on; earlier shards are not opened."""
    return _opened(spark, out, length, first_slot, False, "slot bigint, shard bigint, offset bigint, record binary")


def shard_report(docs: DataFrame, out: str | None = None, path: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 17, window: int | None = None) -> DataFrame:
    """Writes the shards and returns of every record, read back: slot, shard, offset, n_tokens, n_ends, record_sha256."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "shards")
    schema = "slot bigint, shard bigint, offset bigint, n_tokens bigint, n_ends bigint, record_sha256 string"
    if not write_shards(docs, out, path, length, per_shard, key, window=window):
        return spark.createDataFrame([], schema)
    return _opened(spark, out, length, 0, True, schema)
