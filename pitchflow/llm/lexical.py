r"""Ranked lexical search over a length-stratified index.

Documents of equal length normaliser m form a stratum. A stratum is cut into pieces of at most PIECE documents and
POSTINGS postings, each one row: its terms, for each term its frequencies (tf) in ascending order, and for each of
these the documents. Within a piece a term's impact depends on its tf only, so it is worked out once for each tf and
added to all documents that have it.

For an item the bound of a piece is the sum of its terms' impacts at their highest tf there. Pieces are visited in
the order of bounds: first the FIRST pieces of the highest bounds, which give each item a floor (the score of the
k-th document seen), then all pieces whose bound reaches the floor. Nothing that could rank is passed over, so the
results are exact; a bound that equals the floor is visited too, and equal scores are settled by doc_id.

Terms are the maximal runs of TERM in the whole text, with A-Z lower-cased. The weight of a term is
floor(1000 ln((2N + 2) / (2 df + 1))) with N documents that have a term and df that have this one; the rest is
integers of 64 bits: m = 50 + (50 n N) div L for a document of n terms among L in all, and a term's impact is
(1000000000 tf) div (1000 tf + 20 m). A score is the sum of weight times impact over an item's distinct terms.

Scale: texts are read once and cut into terms in stretches; the index is dealt out by ranges of (m, a hash), so a
stratum of a third of all documents goes to many tasks. Items come in slices of about ITEM_BYTES of text and ITEMS items, one slice
on the driver at a time; a slice's terms and weights go to the tasks. An index may be kept and searched again; one
built for given items holds their terms only, and is built for each slice.

Nulls, ties and edges: a null text has no term and is in no result, and an item without terms has no result. A null
doc_id is a document like others and comes first among equal scores. Repeated doc_ids and equal texts are documents
of their own. Items of the same item_id are one item with the terms of both; a null item_id is an id. Without
documents or terms there is no result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .tokens import small_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP, FIRST = 50, 4
PIECE, POSTINGS = 8192, 400_000
ITEM_BYTES, ITEMS = 16 * 2**20, 1000
_TERM, _BREAK = re.compile(TERM), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(65, 91)}
STRETCH = 1 << 20

VECTORS = "doc_id bigint, n bigint, terms array<string>, tfs array<int>"
INDEX = "m bigint, piece bigint, doc_ids array<bigint>, terms array<string>, term_ends array<int>, tfs array<int>, tf_ends array<int>, docs array<int>"
HITS = "item int, doc_id bigint, score bigint"


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about STRETCH characters that no term reaches across."""
    at = 0
    while len(text) - at > STRETCH and (m := _BREAK.search(text, at + STRETCH)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def term_counts(text: str | None, among: frozenset[str] | None = None) -> tuple[int, Counter]:
    """The number of terms of a text, repeats included, and how often each of `among` (all, if None) occurs."""
    n, counts = 0, Counter()
    for part in stretches(text or ""):
        terms = _TERM.findall(part.lower() if part.isascii() else part.translate(_LOWER))
        n += len(terms)
        counts.update(terms if among is None else filter(among.__contains__, terms))
    return n, counts


def _vectors(batches: Iterator[pa.RecordBatch], among: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 1):
            rows = [term_counts(t.as_py(), among) for t in part.column(1)]
            ends = np.cumsum([0] + [len(c) for _, c in rows]).astype(np.int32)
            terms = pa.array([t for _, c in rows for t in c], pa.string())
            tfs = pa.array([k for _, c in rows for k in c.values()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)],
                names=["doc_id", "n", "terms", "tfs"],
            )


def _piece(m: int, number: int, docs: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of the index from documents of one m: postings sorted by term, tf and document."""
    table = pa.Table.from_batches(docs).combine_chunks()
    terms, tfs = table.column("terms").chunk(0), table.column("tfs").chunk(0)
    doc = np.repeat(np.arange(len(table), dtype=np.int32), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(pc.list_flatten(terms))
    code, tf = coded.indices.to_numpy(), pc.list_flatten(tfs).to_numpy()
    order = np.lexsort((doc, tf, code))
    code, tf, doc = code[order], tf[order], doc[order]
    new_term = np.append(code[1:] != code[:-1], True) if len(code) else np.zeros(0, bool)
    new_tf = new_term | np.append(tf[1:] != tf[:-1], True) if len(code) else new_term
    tf_ends = np.flatnonzero(new_tf) + 1
    term_ends = np.searchsorted(tf_ends, np.flatnonzero(new_term) + 1) + 1

    def one(values, kind) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    ids = table.column("doc_id").chunk(0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([m], pa.int64()), pa.array([number], pa.int64()), one(ids, pa.int64()), one(coded.dictionary, pa.string()),
            one(term_ends.astype(np.int32), pa.int32()), one(tf[tf_ends - 1] if len(tf_ends) else tf, pa.int32()), one(tf_ends.astype(np.int32), pa.int32()), one(doc, pa.int32()),
        ],
        names=[f.split()[0] for f in INDEX.split(", ")],
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by m (doc_id, m, terms, tfs, part); pieces are numbered within their part."""
    held, held_m, n_docs, n_postings, number = [], None, 0, 0, 0
    for batch in batches:
        m = batch.column(1).to_numpy()
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            if held and (m[at] != held_m or n_docs >= PIECE or n_postings >= POSTINGS):
                yield _piece(held_m, part << 33 | number, held)
                held, n_docs, n_postings, number = [], 0, 0, number + 1
            held_m, part = int(m[at]), batch.column(4)[at].as_py()
            done = int(sizes[at - 1]) if at else 0
            end = min(int(np.searchsorted(m, held_m, side="right")), at + PIECE - n_docs, int(np.searchsorted(sizes, done + POSTINGS - n_postings, side="left")) + 1)
            some = batch.slice(at, end - at)
            held.append(pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3)], names=["doc_id", "terms", "tfs"]))
            n_docs, n_postings, at = n_docs + end - at, n_postings + int(sizes[end - 1]) - done, end
    if held:
        yield _piece(held_m, part << 33 | number, held)


class Index:
    """pieces: the index table; n_docs and n_terms: N and L of all documents."""

    def __init__(self, pieces: DataFrame, n_docs: int, n_terms: int):
        self.pieces, self.n_docs, self.n_terms = pieces, n_docs, n_terms


def build_index(docs: DataFrame, among: frozenset[str] | None = None) -> Index:
    """The index of all documents, as a written table. among: hold these terms only; counts are of all terms."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = written(texts.mapInArrow(lambda b: _vectors(b, among), VECTORS), "vectors")
    n_docs, n_terms = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # In decimals: 50 n N may leave 64 bits.
    m = F.expr(f"50 + cast((cast(50 as decimal(38,0)) * n * {n_docs}) div {max(n_terms, 1)} as bigint)")
    rows = vectors.where("n > 0 and size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "m", F.xxhash64("doc_id")).sortWithinPartitions("m").withColumn("part", F.spark_partition_id().cast("bigint"))
    return Index(written(dealt.mapInArrow(_pieces, INDEX), "lexical"), n_docs, n_terms)


class _Query:
    """A slice of items: for each of their terms the items that have it, and its weight."""

    def __init__(self, items: list[frozenset[str]]):
        self.n = len(items)
        self.terms = sorted(set().union(*items))
        self.number = {t: k for k, t in enumerate(self.terms)}
        having: list[list[int]] = [[] for _ in self.terms]
        for i, terms in enumerate(items):
            for t in terms:
                having[self.number[t]].append(i)
        self.items = [np.array(h, np.int64) for h in having]
        self.weights = np.zeros(len(self.terms), np.int64)

    def found(self, terms: pa.Array) -> list[tuple[int, int]]:
        """(place among a piece's terms, number here) of those that items have."""
        number = self.number
        return [(k, number[t]) for k, t in enumerate(terms.to_pylist()) if t in number]


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n))[row].values for n in names]


def _frequencies(batches: Iterator[pa.RecordBatch], query: _Query) -> Iterator[pa.RecordBatch]:
    df = np.zeros(len(query.terms), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            terms, term_ends, tf_ends = _lists(batch, row, "terms", "term_ends", "tf_ends")
            ends = np.concatenate(([0], tf_ends.to_numpy()[term_ends.to_numpy() - 1])) if len(terms) else np.zeros(1, int)
            for k, t in query.found(terms):
                df[t] += ends[k + 1] - ends[k]
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32), pa.int32()), pa.array(df[at], pa.int64())], names=["term", "df"])


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _piece_bounds(query: _Query, found: list, m: int, term_ends: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    out = np.zeros(query.n, np.int64)
    for k, t in found:
        out[query.items[t]] += query.weights[t] * impact(int(tfs[term_ends[k] - 1]), m)
    return out


def _bounds(batches: Iterator[pa.RecordBatch], query: _Query) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            terms, term_ends, tfs = _lists(batch, row, "terms", "term_ends", "tfs")
            m, piece = (batch.column(batch.schema.get_field_index(n))[row].as_py() for n in ("m", "piece"))
            bounds = _piece_bounds(query, query.found(terms), m, term_ends.to_numpy(), tfs.to_numpy())
            at = np.flatnonzero(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32), pa.int32()), pa.array(np.full(len(at), piece), pa.int64()), pa.array(bounds[at])], names=["item", "piece", "bound"])


def _visits(batches: Iterator[pa.RecordBatch], query: _Query, top: int, floor: np.ndarray, only: dict[int, np.ndarray] | None, done: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The best `top` documents of each item in each piece visited: those of `only`, or all but `done` whose bound reaches the floor."""
    for batch in batches:
        for row in range(batch.num_rows):
            m, piece = (batch.column(batch.schema.get_field_index(n))[row].as_py() for n in ("m", "piece"))
            if only is not None and piece not in only:
                continue
            terms, term_ends, tfs, tf_ends, docs, ids = _lists(batch, row, "terms", "term_ends", "tfs", "tf_ends", "docs", "doc_ids")
            term_ends, tfs, tf_ends, docs = (x.to_numpy() for x in (term_ends, tfs, tf_ends, docs))
            found = query.found(terms)
            if only is not None:
                wanted = only[piece]
            else:
                wanted = _piece_bounds(query, found, m, term_ends, tfs) >= np.maximum(floor, 1)
                wanted[done.get(piece, np.zeros(0, np.int64))] = False
                wanted = np.flatnonzero(wanted)
            if not len(wanted):
                continue
            place = np.full(query.n, -1)
            place[wanted] = np.arange(len(wanted))
            scores = np.zeros((len(ids), len(wanted)), np.int64)
            for k, t in found:
                at = place[query.items[t]]
                at = at[at >= 0]
                if not len(at) or not query.weights[t]:
                    continue
                first = term_ends[k - 1] if k else 0
                for g in range(first, term_ends[k]):
                    some = docs[tf_ends[g - 1] if g else 0 : tf_ends[g]]
                    gain = query.weights[t] * impact(int(tfs[g]), m)
                    if 4 * len(at) > len(wanted):
                        row_gain = np.zeros(len(wanted), np.int64)
                        row_gain[at] = gain
                        scores[some] += row_gain
                    else:
                        scores[some[:, None], at] += gain
            order = pc.fill_null(ids, -(2**63)).to_numpy()
            for j, i in enumerate(wanted):
                got = scores[:, j]
                low = max(1, int(floor[i]))
                if len(got) > top:
                    low = max(low, int(np.partition(got, len(got) - top)[len(got) - top]))
                at = np.flatnonzero(got >= low)
                if len(at) > top:  # ties at the end
                    at = at[np.lexsort((order[at], -got[at]))[:top]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), ids.take(pa.array(at)), pa.array(got[at])], names=["item", "doc_id", "score"])


def _best(hits: DataFrame, top: int) -> DataFrame:
    """The best of each item; Spark cuts to `top` rows before the shuffle as well."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_slice(index: Index, items: list[frozenset[str]], top: int) -> DataFrame:
    """item (place in the slice), rank, doc_id, score."""
    query = _Query(items)
    read = index.pieces
    df = read.select("terms", "term_ends", "tf_ends").mapInArrow(lambda b: _frequencies(b, query), "term int, df bigint").groupBy("term").agg(F.sum("df"))
    for t, n in df.collect():
        query.weights[t] = int(np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * n + 1))))
    bounds = read.select("m", "piece", "terms", "term_ends", "tfs").mapInArrow(lambda b: _bounds(b, query), "item int, piece bigint, bound bigint")
    first = bounds.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "piece"))).where(F.col("k") <= FIRST)
    chosen: dict[int, list[int]] = {}
    for item, piece in first.select("item", "piece").collect():
        chosen.setdefault(piece, []).append(item)
    visits = {p: np.array(sorted(i), np.int64) for p, i in chosen.items()}
    none = np.zeros(query.n, np.int64)
    seen = written(_best(read.where(F.col("piece").isin(list(visits))).mapInArrow(lambda b: _visits(b, query, top, none, visits, {}), HITS), top), "seen")
    floor = none.copy()
    for item, score in seen.where(F.col("rank") == top).select("item", "score").collect():
        floor[item] = score
    rest = read.mapInArrow(lambda b: _visits(b, query, top, floor, None, visits), HITS)
    return _best(seen.drop("rank").unionByName(rest), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, index: Index | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents of each item. index: of all terms of docs, if there is one."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    results, held, size, last = [], {}, 0, None

    def close() -> None:
        nonlocal held, size
        ids, terms = list(held), [frozenset(t) for t in held.values()]
        held, size = {}, 0
        if any(terms):
            found = _search_slice(index or build_index(docs, frozenset().union(*terms)), terms, top)
            names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
            results.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))

    # One partition of items at a time; rows of one item follow each other and stay in one slice.
    rows = items.where("text is not null").select("item_id", F.col("text").cast("string")).orderBy("item_id")
    for item, text in rows.toLocalIterator():
        if item != last and (size > ITEM_BYTES or len(held) >= ITEMS):
            close()
        held.setdefault(item, set()).update(term_counts(text)[1])
        size, last = size + len(text), item
    close()
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, results)
