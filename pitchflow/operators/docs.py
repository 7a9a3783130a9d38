"""Documents and retrieval: topic pages, exact cosine search, blending, context budgets, chat history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.scalar import clip_text
from ..sources.shared import bounded_batches

#: Vectors in a block: a pair of blocks takes some 512 x 512 scores and its places, 10 MB, in a task.
BLOCK = 512


def topic_pages(pages: DataFrame, topics: dict[str, tuple[str, ...]], k: int = 4, first: int = 0) -> DataFrame:
    """Pages by how many distinct keywords of a topic they hold; the k best of each topic, ties by page. A topic without
    any gets the `first` pages, with score 0."""
    text = F.lower(F.coalesce("text", F.lit("")))
    scores = [F.struct(F.lit(t).alias("topic"), sum((F.contains(text, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("score")) for t, words in topics.items()]
    s = pages.select("page_id", F.inline(F.array(*scores)))
    # The k best of each score and hash first, so that no window meets all pages of a topic.
    some = Window.partitionBy("topic", F.pmod(F.xxhash64("page_id"), F.lit(1024))).orderBy(F.desc("score"), "page_id")
    found = s.where("score > 0").withColumn("__r", F.row_number().over(some)).where(F.col("__r") <= k).drop("__r")
    if first:
        ids = pages.select("page_id").orderBy("page_id").limit(first)
        names = pages.sparkSession.createDataFrame([(t, 0) for t in topics], "topic string, score int")
        found = found.unionByName(ids.join(F.broadcast(names.join(found.select("topic").distinct(), "topic", "left_anti"))))
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "page_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = np.array(part.column(1).to_pylist(), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["ids", "v"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            ids, v, qids, q = (np.frombuffer(batch.column(i)[at].as_buffer(), t) for i, t in enumerate((np.int64, np.float64, np.int64, np.float64)))
            v, q = v.reshape(len(ids), -1), q.reshape(len(qids), -1)
            s = np.round(q @ v.T, 9)
            s[qids[:, None] == ids[None, :]] = -np.inf
            # What is below a query's k-th score is left out before anything is sorted; equal scores go by id.
            least = np.partition(s, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(qids), -np.inf)
            row, at_id = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            order = np.lexsort((ids[at_id], -s[row, at_id], row))
            row, at_id = row[order], at_id[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at_id = row[first], at_id[first]
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[at_id]), pa.array(s[row, at_id])], names=["query_id", "vec_id", "score"])


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine search of (vec_id, embedding) for a stated query set: blocks against blocks, the k best of each pair
    of blocks, then the k best of all. A vector does not find itself."""
    # Blocks are large values: counted in rows alone, a batch would hold thousands of pairs of them.
    bounded_batches(vectors.sparkSession)
    schema = "ids binary, v binary"
    b = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(_blocks, schema)
    q = queries.where("embedding is not null").select("vec_id", "embedding").mapInArrow(_blocks, schema).toDF("qids", "q")
    near = b.join(q).mapInArrow(lambda x: _search(x, k), "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blend(a: DataFrame, b: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Half of k from each scope, the rest from what is left by score; a document counts once, with its best score."""
    both = a.withColumn("scope", F.lit(0)).unionByName(b.withColumn("scope", F.lit(1)))
    w = Window.partitionBy(key, "scope").orderBy(F.desc("score"), "vec_id")
    both = both.withColumn("first", F.row_number().over(w) <= (k + 1) // 2)
    one = both.withColumn("r", F.row_number().over(Window.partitionBy(key, "vec_id").orderBy(F.desc("first"), F.desc("score"), "scope"))).where("r = 1")
    last = Window.partitionBy(key).orderBy(F.desc("first"), F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("r", "first")


def recent_messages(turns: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)


def within_budget(docs: DataFrame, key: str, size: str, score: str, doc: str, budget: int) -> DataFrame:
    """Documents of a key in score order as far as the budget goes; one that does not fit is skipped, later ones may fit.
    If none fits, the first is taken all the same.

    Rows go by key and score through a task as a stream that keeps the taken documents of one key only.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(score).cast("double").alias("s"), F.col(doc).cast("string").alias("d"), F.col(size).cast("bigint").alias("n"))
    ordered = rows.repartition("k").sortWithinPartitions("k", F.desc("s"), "d")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None  # key, used, taken, first
        for frame in frames:
            done = []
            for k, d, n in zip(frame["k"], frame["d"], frame["n"], strict=True):
                n = 0 if n != n or n is None else int(n)
                if now is None or k != now[0]:
                    done += [now] if now else []
                    now = [k, 0, [], (d, n)]
                if now[1] + n <= budget:
                    now[1] += n
                    now[2].append(d)
            yield _taken(done)
        yield _taken([now] if now else [])

    kind = docs.schema[key].dataType.simpleString()
    return ordered.mapInPandas(fold, f"`{key}` {kind}, used bigint, docs string")


def _taken(done: list) -> pd.DataFrame:
    rows = [(k, used, ",".join(taken)) if taken else (k, first[1], first[0]) for k, used, taken, first in done]
    return pd.DataFrame(rows, columns=["k", "used", "docs"]).set_axis(range(3), axis=1)


def unique_ids(docs: DataFrame, id_col: str, order: str) -> DataFrame:
    """Repeated ids get the number of their occurrence behind them, from the second on. `order` is unique within an id."""
    n = ranks.cumulated(docs.withColumn("__one", F.lit(1)), order, "__one", by=(id_col,))
    return n.withColumn("unique_id", F.when(F.col("before___one") > 0, F.concat_ws("_", id_col, (F.col("before___one") + 1).cast("string"))).otherwise(F.col(id_col))).select(*docs.columns, "unique_id")


def collection_listing(docs: DataFrame, preview: int = 40) -> DataFrame:
    """Documents by collection with a preview of the one with the smallest id."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("lang").alias("types"), clip_text(F.min_by("text", "doc_id"), preview).alias("preview"))


def team_documents(stats: DataFrame) -> DataFrame:
    """A text document for each row of chain statistics by match and team."""
    doc_id = F.concat_ws(":", F.lit("chains"), F.col("match_id").cast("string"), F.col("team_id").cast("string"))
    text = F.format_string("Team %d played %d possession chains in match %d, %d of them ended in a shot and %d in a goal.", "team_id", "chains", "match_id", "shots", "goals")
    return stats.select(doc_id.alias("doc_id"), "match_id", "team_id", F.lit("possession_chains").alias("document_type"), text.alias("text"))


def document_problem(doc_id, text, least_id: int = 3, least_text: int = 10) -> F.Column:
    """Why a document is not taken: 'id_short', 'text_short' or 'text_blank'; null when it is."""
    blank = F.coalesce(F.regexp_replace(text, r"[ \t\n\r\f]+", ""), F.lit("")) == ""
    short = lambda c, n: F.coalesce(F.length(c), F.lit(0)) < n
    return F.when(short(doc_id, least_id), "id_short").when(short(text, least_text), "text_short").when(blank, "text_blank")


def embedding_input(title, kind, category, players, text) -> F.Column:
    """The text that is embedded: title, type, category, the first six players and the document's text."""
    or_none = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("n/a"))
    names = or_none(F.array_join(F.slice(players, 1, 6), ", "))
    return F.concat(F.lit("Title: "), or_none(title), F.lit("\nType: "), kind, F.lit("\nCategory: "), or_none(category), F.lit("\nPlayers: "), names, F.lit("\nText: "), F.coalesce(text, F.lit("")))


def embedded(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], dimension: int, text: str = "text", batch: int = 256) -> DataFrame:
    """docs with `embedding`, the unit vectors that the caller's encoder gives for their texts, some at a time; the encoder
    runs in the workers. Vectors of another dimension are an error."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                v = np.asarray(encode(part[text].fillna("").tolist()), np.float32)
                if v.shape != (len(part), dimension):
                    raise ValueError(f"the encoder gave {v.shape[1:]} and not {dimension} numbers a text")
                yield part.assign(embedding=list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def passes(team: int | None, types: tuple[str, ...], min_score: float) -> F.Column:
    """The filter of results by metadata: a result of no team passes every team, no types ask for none."""
    keep = F.col("score") >= min_score
    keep = keep if team is None else keep & (F.col("team_id").isNull() | (F.col("team_id") == team))
    return keep & F.lower("document_type").isin(*types) if types else keep


def filtered_or_relaxed(hits: DataFrame, keep: F.Column, floor: float, key: str = "query_id") -> DataFrame:
    """Results that pass; a query that is left without any gets all its results from the floor on, marked `relaxed`."""
    kept = F.coalesce(keep, F.lit(False))
    out = hits.withColumn("relaxed", ~F.max(kept).over(Window.partitionBy(key)))
    return out.where(kept | (F.col("relaxed") & (F.col("score") >= floor)))


def citations(hits: DataFrame, most: int = 4, key: str = "query_id") -> DataFrame:
    """For each query one line of its first distinct documents: id (title or type, page if any, scope)."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("document_type"))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", p."), F.col("page").cast("string"))).otherwise("")
    one = hits.groupBy(key, "doc").agg(F.min_by(F.struct("rank", F.concat("doc", F.lit(" ("), title, page, F.lit(", "), "scope", F.lit(")")).alias("line")), "rank").alias("x"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("x.rank", "doc"))).where(F.col("r") <= most)
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "; ").alias("citations"))
