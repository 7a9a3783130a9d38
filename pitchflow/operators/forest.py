"""Forests whose trees are grown in tasks: bagged decision trees with weights of each bootstrap sample, and isolation trees.

Decision forests. All trees of all folds are grown at once from all rows of the table: up to POOL rows each tree in a task
of its own, beyond that level by level, by counts of rows that tasks of a stretch of rows each add up (_fit_large). A
tree's bootstrap sample is a Poisson count for each row, drawn from the row's hash and the tree's number, so trees do not
depend on partitioning; its classes are weighted to
the same total within that sample. Splits are by weighted Gini impurity over a random choice of features (the root of
their number; more only where none of these can part the node), and respect min_split and min_leaf, which count rows.

Isolation trees (Liu, Ting, Zhou 2008) are grown from small samples of their own, which are dealt to tasks by tree.

A forest is a table of a row for each tree; scoring tasks get it whole, as its size is bounded by the number of trees
and nodes, not by the data.

Nulls, ties and edges: null numbers are 0, null categories a category of their own ('unknown'). Categories that the
rows to fit do not have, or beyond the CATEGORIES most frequent of a column, have no feature. Equal gains go to the feature
drawn first and to the lower threshold. A sample of one class is one leaf. Without rows to fit there is no tree, and
scores are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..sources.shared import written

#: Rows up to which tasks get the table whole, categories of a column, places of a number, cells of a job, rows walked at once.
POOL, CATEGORIES, BINS, CELLS, PIECE = 100_000, 1000, 65_000, 1_000_000, 2**17
TREE = "model int, tree int, feature array<int>, threshold array<double>, below array<int>, above array<int>, value array<double>"


# ---- features


class Encoding:
    """One feature for each frequent value of a category and one for each number."""

    def __init__(self, categorical, numeric, values: dict[str, list[str]]):
        self.categorical, self.numeric, self.values = list(categorical), list(numeric), values
        self.width = sum(map(len, values.values())) + len(self.numeric)

    @classmethod
    def of(cls, rows: DataFrame, categorical, numeric) -> Encoding:
        """The categories of a table; at most CATEGORIES for each column come to the driver."""
        values = {}
        for c in categorical:
            counted = rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("v")).count()
            values[c] = sorted(r["v"] for r in counted.orderBy(F.desc("count"), "v").limit(CATEGORIES).collect())
        return cls(categorical, numeric, values)

    def columns(self) -> list:
        text = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(f"__c{i}") for i, c in enumerate(self.categorical)]
        return [*text, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__n{i}") for i, c in enumerate(self.numeric)]]

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """The features of a batch that begins with columns()."""
        out, at = np.zeros((batch.num_rows, self.width), np.float32), 0
        for i, c in enumerate(self.categorical):
            place = {v: at + k for k, v in enumerate(self.values[c])}
            coded = batch.column(i).dictionary_encode()
            to = np.array([place.get(v, -1) for v in coded.dictionary.to_pylist()], int)
            where = to[coded.indices.to_numpy()] if len(to) else np.zeros(0, int)
            known = np.flatnonzero(where >= 0)
            out[known, where[known]] = 1
            at += len(self.values[c])
        for i in range(len(self.numeric)):
            out[:, at + i] = batch.column(len(self.categorical) + i).to_numpy(zero_copy_only=False)
        return out

    def place(self, column: str, value: str) -> int | None:
        """The feature of a category's value."""
        at = 0
        for c in self.categorical:
            if c == column:
                return at + self.values[c].index(value) if value in self.values[c] else None
            at += len(self.values[c])
        return None

    def span(self, column: str) -> tuple[int, int]:
        """The features of a category: from, to."""
        at = 0
        for c in self.categorical:
            if c == column:
                return at, at + len(self.values[c])
            at += len(self.values[c])
        raise KeyError(column)


# ---- decision trees


def poisson_counts(rows: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson of mean 1 from the row's hash (unsigned 64 bits) and the tree's number."""
    with np.errstate(over="ignore"):
        z = rows + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = (z ^ (z >> np.uint64(31))) / 2.0**64
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1, 12)))))
    return np.searchsorted(steps, u, side="right")


def balanced_weights(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The counts times weights that give the classes of this sample the same total."""
    total = counts.sum()
    of = np.array([counts[y == c].sum() for c in (0, 1)], float)
    return counts * np.where(of > 0, total / ((of > 0).sum() * np.maximum(of, 1)), 0.0)[y]


def _best_split(x: np.ndarray, w0: np.ndarray, w1: np.ndarray, min_leaf: int) -> tuple[float, float] | None:
    """The least weighted impurity of a split of one feature, and its threshold."""
    order = np.argsort(x, kind="stable")
    v, a, b = x[order], np.cumsum(w0[order]), np.cumsum(w1[order])
    at = np.flatnonzero(v[1:] > v[:-1])
    at = at[(at + 1 >= min_leaf) & (len(v) - at - 1 >= min_leaf)]
    if not len(at):
        return None
    a1, b1, a2, b2 = a[at], b[at], a[-1] - a[at], b[-1] - b[at]
    impurity = 2 * a1 * b1 / np.maximum(a1 + b1, 1e-300) + 2 * a2 * b2 / np.maximum(a2 + b2, 1e-300)
    k = int(impurity.argmin())
    return float(impurity[k]), float((np.float64(v[at[k]]) + v[at[k] + 1]) / 2)


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng, depth: int = 14, min_split: int = 12, min_leaf: int = 4) -> dict[str, list]:
    """Nodes of a tree: feature (-1: leaf), threshold, the nodes for values up to it (below) and above, and the weighted share of class 1."""
    out = {k: [] for k in ("feature", "threshold", "below", "above", "value")}
    w0, w1 = w * (y == 0), w * (y == 1)
    some = max(1, int(np.sqrt(x.shape[1])))

    def node(rows: np.ndarray) -> int:
        a, b = w0[rows].sum(), w1[rows].sum()
        for k, v in (("feature", -1), ("threshold", 0.0), ("below", -1), ("above", -1), ("value", float(b / (a + b)) if a + b > 0 else 0.0)):
            out[k].append(v)
        return len(out["value"]) - 1

    stack = [(node(np.arange(len(y))), np.arange(len(y)), 0)]
    while stack:
        at, rows, level = stack.pop()
        a, b = w0[rows].sum(), w1[rows].sum()
        if level == depth or len(rows) < max(min_split, 2 * min_leaf) or not a or not b:
            continue
        best, feature = None, -1
        for k, f in enumerate(rng.permutation(x.shape[1])):
            if k >= some and best is not None:
                break
            found = _best_split(x[rows, f], w0[rows], w1[rows], min_leaf)
            if found and (best is None or found[0] < best[0]):
                best, feature = found, int(f)
        if best is None or best[0] >= 2 * a * b / (a + b) - 1e-12:
            continue
        low = x[rows, feature] <= best[1]
        out["feature"][at], out["threshold"][at] = feature, best[1]
        for side, part in (("below", rows[low]), ("above", rows[~low])):
            child = node(part)
            out[side][at] = child
            stack.append((child, part, level + 1))
    return out


def tree_scores(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row comes to; rows that are at one stay there until all are."""
    feature, threshold, value = tree["feature"], tree["threshold"], tree["value"]
    if feature[0] < 0:
        return np.full(len(x), value[0])
    leaf, here = feature < 0, np.arange(len(feature))
    child = np.stack([np.where(leaf, here, tree["above"]), np.where(leaf, here, tree["below"])], axis=1).ravel()
    column = np.maximum(feature, 0)
    values, row, at = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), int)
    while True:
        low = values.take(row + column.take(at)) <= threshold.take(at)
        to = child.take(2 * at + low)
        if np.array_equal(to, at):
            return value.take(at)
        at = to


class Pool:
    """The encoded rows of a table of at most POOL rows: features, label, fold and the hash that draws them."""

    def __init__(self, rows: DataFrame, encoding: Encoding, key, label: str, fold: str | None):
        fold_of = F.col(fold).cast("int") if fold else F.lit(-1)
        columns = [*encoding.columns(), F.col(label).cast("int").alias("__y"), fold_of.alias("__f"), F.xxhash64(*key).alias("__h")]
        table = rows.select(*columns).orderBy("__h", "__y").toArrow()
        batches = table.combine_chunks().to_batches()
        self.x = encoding.matrix(batches[0]) if batches else np.zeros((0, encoding.width), np.float32)
        self.y, self.fold, h = (np.array(table.column(c)) for c in ("__y", "__f", "__h"))
        self.h = h.astype(np.int64).view(np.uint64)


def fit_forests(rows: DataFrame, encoding: Encoding, key, models, label: str = "label", fold: str | None = "fold", trees: int = 700, depth: int = 14, min_split: int = 12, min_leaf: int = 4) -> DataFrame:
    """A row for each tree of each model. models: the folds that a model is fitted without; None fits on all rows, as model -1."""
    spark = rows.sparkSession
    if rows.count() > POOL:
        return _fit_large(rows, encoding, key, [-1 if m is None else int(m) for m in models], label, fold, trees, depth, min_split, min_leaf)
    pool = spark.sparkContext.broadcast(Pool(rows, encoding, key, label, fold))
    named = [-1 if m is None else int(m) for m in models]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pool.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                model, tree = named[number // trees], number % trees
                counts = poisson_counts(p.h, number) * (p.fold != model)
                used = np.flatnonzero(counts)
                if not len(used):
                    continue
                y = p.y[used]
                got = grow_tree(p.x[used], y, balanced_weights(counts[used], y), np.random.default_rng(number), depth, min_split, min_leaf)
                yield pa.RecordBatch.from_pylist([{"model": model, "tree": tree} | got], schema=_TREE)

    numbers = spark.range(0, len(named) * trees, 1, min(len(named) * trees, 4 * spark.sparkContext.defaultParallelism))
    return numbers.mapInArrow(grow, TREE)


_LISTS = {"feature": pa.int32(), "threshold": pa.float64(), "below": pa.int32(), "above": pa.int32(), "value": pa.float64()}
_TREE = pa.schema([("model", pa.int32()), ("tree", pa.int32()), *[(k, pa.list_(t)) for k, t in _LISTS.items()]])


def collected(forests: DataFrame) -> dict[int, list[dict[str, np.ndarray]]]:
    """The trees of each model, as many as were asked for, on the driver."""
    out: dict[int, list] = {}
    table = forests.orderBy("model", "tree").toArrow()
    for r in table.to_pylist():
        out.setdefault(r["model"], []).append({k: np.array(r[k], int if k in ("feature", "below", "above") else float) for k in _LISTS})
    return out


def scored(rows: DataFrame, encoding: Encoding, forests: dict, fold: str | None = None, action: str | None = None, actions=()) -> DataFrame:
    """rows with p, the score of class 1 by the forest of the row's fold (or the one of all); with an action column also
    p_<action> with each of the actions in its place."""
    columns = rows.columns
    fold_of = F.col(fold).cast("int") if fold else F.lit(-1)
    names = ["p", *[f"p_{a}" for a in actions]]
    places = [encoding.place(action, a) for a in actions] if action else []
    first, last = encoding.span(action) if action else (0, 0)
    shared = rows.sparkSession.sparkContext.broadcast(forests)
    n_features = len(encoding.categorical) + len(encoding.numeric)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                x, folds = encoding.matrix(part), part.column(n_features).to_numpy()
                variants = [x]
                for place in places:
                    other = x.copy()
                    other[:, first:last] = 0
                    if place is not None:
                        other[:, place] = 1
                    variants.append(other)
                values = np.full((len(variants), len(x)), np.nan)
                for model, trees in shared.value.items():
                    mine = np.flatnonzero(folds == model)
                    for v, other in enumerate(variants) if len(mine) else ():
                        values[v, mine] = np.mean([tree_scores(t, other[mine]) for t in trees], axis=0)
                extra = [pa.array(v, pa.float64(), from_pandas=True) for v in values]
                yield pa.RecordBatch.from_arrays([*part.columns[n_features + 1 :], *extra], names=[*columns, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], *[f"{n} double" for n in names]])
    return rows.select(*encoding.columns(), fold_of.alias("__f"), *columns).mapInArrow(score, schema)


# ---- decision trees over tables beyond POOL rows


class _Codes:
    """Numbers as places among the distinct values of all rows, categories as places in their lists: what a split looks at.

    Beyond BINS distinct values a number's places are BINS ranges of as many rows of the whole table each.
    """

    def __init__(self, rows: DataFrame, encoding: Encoding):
        self.encoding, names = encoding, encoding.numeric
        numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).cast("float") for c in names]) if names else F.array().cast("array<float>")
        values = written(rows.select(F.posexplode(numbers).alias("i", "v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")), "forest-values")
        many = [r["i"] for r in values.groupBy("i").count().where(F.col("count") > BINS).collect()]
        found = values.where(~F.col("i").isin(many)).select("i", F.col("v").alias("lo"), F.col("v").alias("hi"))
        if many:
            c = ranks.cumulated(values.where(F.col("i").isin(many)), "v", "n", by=("i",))
            ranged = c.groupBy("i", F.floor(F.col("before_n") * BINS / F.col("total_n")).alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
            found = found.unionByName(ranged.select("i", "lo", "hi"))
        table = found.orderBy("i", "lo").toArrow()  # at most BINS rows for each number
        i, lo, hi = (table.column(c).to_numpy() for c in ("i", "lo", "hi"))
        self.lo, self.hi = ([x[i == k] for k in range(len(names))] for x in (lo, hi))
        # For each feature its column, the category's place (-1: a number) and how many places there are.
        hot = [(c, k, 2) for c, name in enumerate(encoding.categorical) for k in range(len(encoding.values[name]))]
        self.column, self.hot, self.width = np.array(hot + [(len(encoding.categorical) + k, -1, max(1, len(x))) for k, x in enumerate(self.lo)], int).reshape(-1, 3).T

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """The codes of a batch that begins with Encoding.columns(); 65535 is a category without a feature."""
        e = self.encoding
        out = np.empty((batch.num_rows, len(e.categorical) + len(e.numeric)), np.uint16)
        for c, name in enumerate(e.categorical):
            place, coded = {v: k for k, v in enumerate(e.values[name])}, batch.column(c).dictionary_encode()
            to = np.array([place.get(v, 65_535) for v in coded.dictionary.to_pylist()], np.uint16)
            out[:, c] = to[coded.indices.to_numpy()] if len(to) else 65_535
        for k, lo in enumerate(self.lo):
            x = batch.column(len(e.categorical) + k).to_numpy(zero_copy_only=False).astype(np.float32)
            out[:, len(e.categorical) + k] = np.maximum(np.searchsorted(lo, x, side="right") - 1, 0)
        return out

    def threshold(self, feature: int, at: int, after: int) -> float:
        """Between the places `at` and `after` of a feature."""
        if self.hot[feature] >= 0:
            return 0.5
        k = self.column[feature] - len(self.encoding.categorical)
        low, high = np.float64(self.hi[k][at]), np.float64(self.lo[k][after])
        middle = (low + high) / 2
        return float(middle if np.isfinite(middle) else low)


class _Growing:
    """A tree that is not yet done: its nodes, and those to be split with the features drawn for them."""

    def __init__(self, number: int, model: int, width: int):
        self.model, self.rng, self.some, self.features = model, np.random.default_rng(number), max(1, int(np.sqrt(width))), width
        self.nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "below", "above", "value", "cut")}
        self.weights, self.levels = None, 0
        self.open: dict[int, tuple[int, np.ndarray, bool]] = {}  # node: level, all features as drawn, whether the first ones have failed
        self.node(0)

    def node(self, level: int) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("below", -1), ("above", -1), ("value", 0.0), ("cut", 0)):
            self.nodes[k].append(v)
        at = len(self.nodes["value"]) - 1
        self.open[at] = (level, self.rng.permutation(self.features), False)
        self.levels = max(self.levels, level)
        return at

    def settle(self, at: int, counts: np.ndarray, level: int, depth: int, least: int) -> None:
        """Sets a node's value from the rows drawn of each class and the different rows; closes it where it can't be split."""
        a, b = counts[:2] * self.weights
        self.nodes["value"][at] = float(b / (a + b)) if a + b > 0 else 0.0
        if level >= depth or counts[2] < least or not a or not b:
            self.open.pop(at, None)

    def apply(self, r: dict, depth: int, least: int) -> None:
        at, total, left = r["node"], np.array(r["total"], float), np.array(r["left"], float)
        level, drawn, failed = self.open[at]
        if self.weights is None:
            self.weights = _class_weights(total)
            self.settle(at, total, level, depth, least)
            if at not in self.open:
                return
        if r["feature"] is None and not failed and len(drawn) > self.some:
            self.open[at] = (level, drawn, True)
            return
        del self.open[at]
        if r["feature"] is None or not r["gains"]:
            return
        for k in ("feature", "threshold", "cut"):
            self.nodes[k][at] = r[k]
        for side, counts in (("below", left), ("above", total - left)):
            child = self.node(level + 1)
            self.nodes[side][at] = child
            self.settle(child, counts, level + 1, depth, least)

    def plan(self, codes: _Codes) -> dict:
        """What tasks need: how to walk to a node, and jobs of open nodes whose counts together take at most CELLS cells, or one node."""
        feature, below, above, cut = (np.array(self.nodes[k], int) for k in ("feature", "below", "above", "cut"))
        leaf, here = feature < 0, np.arange(len(feature))
        child = np.stack([np.where(leaf, here, above), np.where(leaf, here, below)], axis=1).ravel()
        f, jobs = np.maximum(feature, 0), []
        for failed in (False, True):
            mine = [(at, drawn[self.some :] if failed else drawn[: self.some]) for at, (_, drawn, x) in sorted(self.open.items()) if x == failed]
            while mine:
                cells = np.cumsum([codes.width[drawn].sum() for _, drawn in mine])
                n = max(1, int(np.searchsorted(cells, CELLS, side="right")))
                drawn = np.array([d for _, d in mine[:n]])
                ends = np.cumsum(codes.width[drawn].ravel())
                jobs.append({"nodes": np.array([at for at, _ in mine[:n]]), "drawn": drawn, "starts": np.concatenate([[0], ends[:-1]]).reshape(drawn.shape), "cells": int(ends[-1]), "failed": failed})
                mine = mine[n:]
        return {"model": self.model, "weights": self.weights, "child": child, "column": codes.column[f], "hot": codes.hot[f], "cut": cut, "levels": self.levels, "jobs": jobs}


def _class_weights(total: np.ndarray) -> np.ndarray:
    """As in balanced_weights(), from the rows drawn of each class."""
    of = total[:2]
    return np.where(of > 0, of.sum() / (max(1, (of > 0).sum()) * np.maximum(of, 1)), 0.0)


def _reached(plan: dict, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node that each row has come to."""
    at, first, flat = np.zeros(len(rows), int), rows * x.shape[1], x.ravel()
    for _ in range(plan["levels"]):
        code, hot = flat.take(first + plan["column"].take(at)), plan["hot"].take(at)
        low = np.where(hot >= 0, code != hot, code <= plan["cut"].take(at))
        at = plan["child"].take(2 * at + low)
    return at


def _count(plan: dict, number: int, codes: _Codes, pieces) -> Iterator[dict]:
    """The rows of some blocks by job, cell (node, drawn feature, place) and class: different rows, and rows drawn."""
    walked = []
    for x, y, fold, h in pieces:
        drawn = poisson_counts(h, number) * (fold != plan["model"])
        rows = np.flatnonzero(drawn)
        walked.append((x, rows, drawn[rows], y[rows] == 1, _reached(plan, x, rows)))
    for k, job in enumerate(plan["jobs"]):
        n, c0, c1 = sums = [np.zeros(job["cells"], np.int64) for _ in range(3)]
        slot_of = np.full(len(plan["cut"]), -1)
        slot_of[job["nodes"]] = np.arange(len(job["nodes"]))
        for x, rows, drawn, one, reached in walked:
            slot = slot_of[reached]
            inside = np.flatnonzero(slot >= 0)
            slot, first, drawn, one = slot[inside], rows[inside] * x.shape[1], drawn[inside], one[inside]
            for j in range(job["drawn"].shape[1]):
                feature = job["drawn"][:, j]
                code, hot = x.ravel().take(first + codes.column[feature].take(slot)).astype(int), codes.hot[feature].take(slot)
                cell = job["starts"][:, j].take(slot) + np.where(hot >= 0, code == hot, code)
                n += np.bincount(cell, minlength=len(n))
                c0 += np.bincount(cell[~one], drawn[~one], len(n)).astype(np.int64)
                c1 += np.bincount(cell[one], drawn[one], len(n)).astype(np.int64)
        at = np.flatnonzero(n)
        if len(at):
            yield {"tree": number, "job": k, "at": at.astype(np.int32).tobytes(), "counts": np.concatenate([s[at] for s in sums]).tobytes()}


def _splits(plan: dict, k: int, parts, codes: _Codes, min_leaf: int) -> Iterator[dict]:
    """The best split of each node of a job, from the counts of all tasks; by the rule of grow_tree()."""
    job = plan["jobs"][k]
    sums = np.zeros((3, job["cells"]))
    for at, counts in parts:
        where = np.frombuffer(at, np.int32)
        sums[:, where] += np.frombuffer(counts, np.int64).reshape(3, -1)
    for node, drawn, starts in zip(job["nodes"], job["drawn"], job["starts"], strict=True):
        of = [sums[:, s : s + codes.width[f]] for f, s in zip(drawn, starts, strict=True)]
        total = of[0].sum(axis=1)  # n, c0, c1
        if not total[0]:
            continue
        weights = plan["weights"] if plan["weights"] is not None else _class_weights(total[1:])
        out = {"node": int(node), "total": [total[1], total[2], total[0]], "left": [0.0, 0.0, 0.0], "feature": None, "threshold": None, "cut": None, "gains": False}
        best = None
        for f, part in zip(drawn, of, strict=True):
            if job["failed"] and best is not None:
                break
            here = np.flatnonzero(part[0])
            left = np.cumsum(part[:, here], axis=1)[:, :-1]
            fits = np.flatnonzero((left[0] >= min_leaf) & (total[0] - left[0] >= min_leaf))
            if not len(fits):
                continue
            a1, b1 = left[1, fits] * weights[0], left[2, fits] * weights[1]
            a2, b2 = total[1] * weights[0] - a1, total[2] * weights[1] - b1
            impurity = 2 * a1 * b1 / np.maximum(a1 + b1, 1e-300) + 2 * a2 * b2 / np.maximum(a2 + b2, 1e-300)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best:
                best, at = float(impurity[i]), fits[i]
                cut = int(here[at]) if codes.hot[f] < 0 else int(codes.hot[f])
                out |= {"left": [left[1, at], left[2, at], left[0, at]], "feature": int(f), "threshold": codes.threshold(f, here[at], here[at + 1]), "cut": cut}
        a, b = total[1] * weights[0], total[2] * weights[1]
        yield out | {"gains": best is not None and a + b > 0 and best < 2 * a * b / (a + b) - 1e-12}


_BLOCK = pa.schema([("x", pa.binary()), ("y", pa.binary()), ("fold", pa.binary()), ("h", pa.binary())])
_COUNTS = pa.schema([("tree", pa.int32()), ("job", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
_SPLITS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("total", pa.list_(pa.float64())), ("left", pa.list_(pa.float64())), ("feature", pa.int32()), ("threshold", pa.float64()), ("cut", pa.int32()), ("gains", pa.bool_())])


def _round(blocks: DataFrame, plans, codes: _Codes, width: int, min_leaf: int) -> DataFrame:
    """The best splits of all open nodes: counts by task, added up by tree and job."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[np.frombuffer(r[c], of) for c, of in (("x", np.uint16), ("y", np.int8), ("fold", np.int32), ("h", np.uint64))] for batch in batches for r in batch.to_pylist()]
        if not found:
            return
        joined = [np.concatenate([b[k] for b in found]) for k in range(4)]
        del found
        x, y, f, h = joined[0].reshape(-1, width), *joined[1:]
        pieces = [(x[at : at + PIECE], y[at : at + PIECE], f[at : at + PIECE], h[at : at + PIECE]) for at in range(0, len(y), PIECE)]
        for number, plan in plans.value.items():
            if some := list(_count(plan, number, codes, pieces)):
                yield pa.RecordBatch.from_pylist(some, schema=_COUNTS)

    def split(table: pa.Table) -> pa.Table:
        number, k = table.column("tree")[0].as_py(), table.column("job")[0].as_py()
        parts = zip((b.as_py() for b in table.column("at")), (b.as_py() for b in table.column("counts")), strict=True)
        return pa.Table.from_pylist([{"tree": number} | r for r in _splits(plans.value[number], k, parts, codes, min_leaf)], schema=_SPLITS)

    counted = blocks.mapInArrow(count, "tree int, job int, at binary, counts binary").repartition(2 * blocks.sparkSession.sparkContext.defaultParallelism, "tree", "job")
    return counted.groupBy("tree", "job").applyInArrow(split, "tree int, node int, total array<double>, left array<double>, feature int, threshold double, cut int, gains boolean")


def _fit_large(rows: DataFrame, encoding: Encoding, key, named: list[int], label: str, fold: str | None, trees: int, depth: int, min_split: int, min_leaf: int) -> DataFrame:
    """fit_forests() over all rows of any table: a round counts the rows at all open nodes of all trees by place and class,
    in tasks that hold a stretch of rows each, and splits these nodes by the counts that are added up; so a round goes a
    level down. Counts are whole numbers, so trees do not depend on partitioning. The driver holds trees, never rows."""
    spark = rows.sparkSession
    codes = _Codes(rows, encoding)
    fold_of = F.col(fold).cast("int") if fold else F.lit(-1)
    columns = [*encoding.columns(), F.col(label).cast("int").alias("__y"), fold_of.alias("__f"), F.xxhash64(*key).alias("__h")]
    width = len(encoding.categorical) + len(encoding.numeric)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, f, h = (batch.column(width + k).to_numpy() for k in range(3))
            block = {"x": codes.matrix(batch).tobytes(), "y": y.astype(np.int8).tobytes(), "fold": f.astype(np.int32).tobytes(), "h": h.astype(np.int64).tobytes()}
            yield pa.RecordBatch.from_pylist([block], schema=_BLOCK)

    blocks = written(rows.select(*columns).mapInArrow(pack, "x binary, y binary, fold binary, h binary"), "forest-codes")
    growing = {k: _Growing(k, named[k // trees], encoding.width) for k in range(len(named) * trees)}
    while any(t.open for t in growing.values()):
        plans = spark.sparkContext.broadcast({k: t.plan(codes) for k, t in growing.items() if t.open})

        rounds: dict[int, list] = {}
        for r in _round(blocks, plans, codes, width, min_leaf).toArrow().to_pylist():
            rounds.setdefault(r["tree"], []).append(r)
        for number, t in list(growing.items()):
            for r in sorted(rounds.get(number, []), key=lambda r: r["node"]):
                t.apply(r, depth, max(min_split, 2 * min_leaf))
            if t.weights is None:  # no rows were drawn
                del growing[number]
        plans.unpersist()
    done = [{"model": t.model, "tree": k % trees} | {c: t.nodes[c] for c in _LISTS} for k, t in growing.items()]
    return spark.createDataFrame(pa.Table.from_pylist(done, schema=_TREE)) if done else spark.createDataFrame([], TREE)


# ---- isolation trees


def grow_isolation(x: np.ndarray, depth: int, rng) -> tuple | int:
    span = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(0)
    if depth == 0 or len(x) <= 1 or not (span > 0).any():
        return len(x)
    f = int(rng.choice(np.flatnonzero(span > 0)))
    at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < at
    return f, at, grow_isolation(x[left], depth - 1, rng), grow_isolation(x[~left], depth - 1, rng)


def mean_path(n):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _flat(tree: tuple | int) -> dict[str, list]:
    """The nodes of an isolation tree as those of a decision tree; a leaf's value is its depth and the mean path of its rows."""
    out: dict[str, list] = {k: [] for k in _LISTS}

    def add(node, depth: int) -> int:
        at = len(out["value"])
        leaf = not isinstance(node, tuple)
        for k, v in (("feature", -1 if leaf else node[0]), ("threshold", 0.0 if leaf else node[1]), ("below", -1), ("above", -1), ("value", depth + float(mean_path(node)) if leaf else 0.0)):
            out[k].append(v)
        if not leaf:
            out["below"][at], out["above"][at] = add(node[2], depth + 1), add(node[3], depth + 1)
        return at

    add(tree, 0)
    return out


def isolation_samples(data: DataFrame, key, trees: int, sample: int) -> DataFrame:
    """tree, r, x: for each tree `sample` rows, those of the smallest hash under its number among rows from the whole table.

    Each row is a candidate of so many trees that every tree has at least four times as many candidates as it takes
    where the table has them (of all trees, in a small table); in a large one rows are thinned by hash first.
    """
    n = max(1, data.count())
    each = min(trees, -(-4 * sample * trees // n))
    share = min(1.0, 4 * sample * trees / (n * each))
    some = data.select(F.xxhash64(*key).alias("h"), "__x").where(F.pmod(F.xxhash64(F.lit("thin"), "h"), F.lit(2**30)) < F.lit(int(share * 2**30)))
    some = some.select("h", "__x", F.explode(F.expr(f"transform(sequence(0, {each - 1}), j -> cast(pmod(xxhash64('tree', h) + j, {trees}) as int))")).alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "h"), "h")
    return some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).select("tree", "r", F.col("__x").alias("x"))


def fit_isolation(data: DataFrame, key, trees: int, sample: int) -> DataFrame:
    """The isolation trees, each grown in a task from its own sample, whose number of rows is its `model`."""

    def grow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["r"])
        x, tree = np.array([r["x"] for r in rows], float).reshape(len(rows), -1), rows[0]["tree"]
        grown = grow_isolation(x, int(np.ceil(np.log2(max(2, len(x))))), np.random.default_rng(tree))
        return pa.Table.from_pylist([{"model": len(rows), "tree": tree} | _flat(grown)], schema=_TREE)

    return isolation_samples(data, key, trees, sample).groupBy("tree").applyInArrow(grow, TREE)
