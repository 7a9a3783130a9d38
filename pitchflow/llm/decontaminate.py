r"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, words as in WORD, joined by single spaces. A window is ten
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The automaton holds all
windows and scans every document's text once, whatever their number; a match is mapped from the normalised text to
words, and from words to character offsets of the original.

Size of the benchmark: an automaton of at most `max_patterns` windows is built in each worker, from benchmark texts
that are broadcast once under their digest. A larger benchmark is cut into slices of that size; the texts are then scanned once for
each slice and the hits are united, so its size is never a limit.

Nulls, ties and edges: null and empty texts and items have no words and never hit. Items with equal texts or an
equal item_id (as strings) all count, an item_id once. The windows of an item without an item_id are searched for
like others, so its documents are hit, contaminated and dropped; as it has no id to be named by, it counts neither in
n_items nor in items_sha256. A very long text is scanned in one go, in memory of a few times its size. Repeated
documents give repeated rows. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed, written

WINDOW = 10
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_AUTOMATA: dict[str, object] = {}
#: A digest and the broadcast items (item_id or None, text).
Slice = tuple[str, Broadcast]

SPANS = "doc_id bigint, n_words bigint, words array<struct<first:bigint,last:bigint>>, chars array<struct<first:bigint,last:bigint>>, items array<string>"


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z lower-cased and all other ASCII but digits and letters as spaces; no byte moves."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def windows(text: str | None, n: int = WINDOW) -> list[bytes]:
    words = normalised(text).split()
    if not words:
        return []
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def _automaton(slice_: Slice):
    """Windows, each between spaces, to (its number of words, the items that have it). Kept for the worker's next task."""
    import ahocorasick

    key, items = slice_
    if key not in _AUTOMATA:
        owners: dict[bytes, set[str]] = {}
        for item, text in items.value:
            for w in windows(text):
                owners.setdefault(w, set()).update([] if item is None else [item])
        a = ahocorasick.Automaton()
        for w, who in owners.items():
            a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(who)))
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = a if owners else None
    return _AUTOMATA[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(text: str | None, automaton) -> tuple[int, list, list, list]:
    raw = normalised(text)
    words = raw.split()
    if not words or automaton is None:
        return len(words), [], [], []
    line = b" " + b" ".join(words) + b" "
    matches = list(automaton.iter(line.decode("latin-1")))
    if not matches:
        return len(words), [], [], []
    before = np.cumsum(np.frombuffer(line, np.uint8) == 32)  # spaces up to a place
    spans, items = set(), set()
    for end, (n, who) in matches:
        last = int(before[end]) - 2  # the match ends with the space after its last word
        spans.add((last - n + 1, last))
        items.update(who)
    hit = _merged(list(spans))
    solid = np.concatenate(([0], (np.frombuffer(raw, np.uint8) != 32).astype(np.int8), [0]))
    edge = np.diff(solid)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Bytes to characters: those that do not continue a character.
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)))
    return len(words), hit, [(int(chars[first[a]]), int(chars[last[b]])) for a, b in hit], sorted(items)


def _spans_of(batches: Iterator[pa.RecordBatch], items: Slice) -> Iterator[pa.RecordBatch]:
    """From doc_id, text and further columns; those are passed on."""
    automaton = _automaton(items)
    pair = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            rows = [_scan(t.as_py(), automaton) for t in part.column(1)]
            pairs = [pa.array([[{"first": a, "last": b} for a, b in r[i]] for r in rows], pair) for i in (1, 2)]
            found = [pa.array([r[0] for r in rows], pa.int64()), *pairs, pa.array([r[3] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *found, *part.columns[2:]], names=["doc_id", "n_words", "words", "chars", "items", *part.schema.names[2:]])


def benchmark_slices(benchmark: DataFrame, max_patterns: int) -> list[Slice]:
    """The benchmark's items, each slice of at most about max_patterns words broadcast under its digest.

    Items come one partition at a time, and the driver holds no more than one slice.
    """
    context, slices, items, size, digest = benchmark.sparkSession.sparkContext, [], [], 0, hashlib.sha256()

    def close() -> None:
        slices.append((digest.hexdigest(), context.broadcast(items)))

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        n = len(text) // 5 + 1  # no more words than that, near enough
        if size + n > max_patterns and items:
            close()
            items, size, digest = [], 0, hashlib.sha256()
        items.append((item, text))
        digest.update(repr((item, text)).encode("utf-8", "surrogatepass"))
        size += n
    close()
    return slices


def hits(docs: DataFrame, benchmark: DataFrame, max_patterns: int = 2_000_000) -> DataFrame:
    """For each document: its number of words, the merged word spans and character spans hit, and the items found."""
    bounded_batches(docs.sparkSession)
    slices = benchmark_slices(benchmark, max_patterns)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(slices) == 1:
        return texts.mapInArrow(lambda batches, items=slices[0]: _spans_of(batches, items), SPANS)
    # More than one slice: rows need an identity to be united by. Equal rows are equal in all results.
    keyed = texts.withColumn("h", F.xxhash64("text"))
    parts = []
    for items in slices:
        parts.append(written(keyed.select("doc_id", "text", "h").mapInArrow(lambda batches, items=items: _spans_of(batches, items), SPANS + ", h bigint"), "hits"))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    united = all_parts.where("size(words) > 0").groupBy("doc_id", "h").agg(
        F.flatten(F.collect_set("words")).alias("w"), F.flatten(F.collect_set("chars")).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i")
    )
    merge = (
        "aggregate(array_sort({0}), cast(array() as array<struct<first:bigint,last:bigint>>), (s, x) -> if(size(s) > 0 and x.first <= element_at(s, -1).last + {1}, "
        "concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'last', greatest(element_at(s, -1).last, x.last)))), concat(s, array(x))))"
    )
    base = parts[0].select(F.col("doc_id").alias("d"), "n_words", F.col("h").alias("g"))
    return base.join(united, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h")), "left").select(
        F.col("d").alias("doc_id"), "n_words", F.coalesce(F.expr(merge.format("w", 1)), F.expr("array()")).alias("words"), F.coalesce(F.expr(merge.format("c", 1)), F.expr("array()")).alias("chars"), F.coalesce("i", F.expr("array()")).alias("items")
    )


def report(docs: DataFrame, benchmark: DataFrame, max_patterns: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, char_spans."""
    return hits(docs, benchmark, max_patterns).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(words, 0L, (s, x) -> s + x.last - x.first + 1)").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
        F.col("chars").alias("char_spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, max_patterns: int = 2_000_000) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with all their columns; only texts go to Python."""
    bounded_batches(docs.sparkSession)
    for items in benchmark_slices(benchmark, max_patterns):
        docs = docs.where(~_is_hit(items)(F.col("text")))
    return docs


def _is_hit(items: Slice):
    @F.arrow_udf("boolean")
    def is_hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(found(texts))

    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(items)
        for some in texts:
            yield pa.array([bool(_scan(t.as_py(), automaton)[1]) for t in some], pa.bool_())

    return is_hit
