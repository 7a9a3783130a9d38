"""A neural net fitted by data-parallel mini-batch Adam, for all folds at once.

Rows are encoded once and dealt to shards of whole mini-batches, each of at most SHARD_ROWS rows and SHARD_BYTES. An
epoch is one job: from common weights and moments each shard takes its mini-batches one by one, for every model without
the rows of its own fold, and the driver goes on from the means over all shards, weighted by rows (Zinkevich, Weimer,
Smola, Li 2010). So a table of one shard is fitted by plain mini-batch Adam, and a job grows with the rows while the
number of jobs does not. Sums of many tasks are added up in a second stage. The driver holds weights and moments only,
never rows. A model stops when its accuracy on rows set apart for validation has not risen for `patience` epochs, and
keeps the weights of its best one.

Hidden units are rectified, the output is logistic, the loss is log loss with `alpha` of the squared weights. Numbers
are standardised by the rows that a model is fitted on. Which rows make up a mini-batch and the validation set follows
from their hashes, so it does not depend on partitioning; mini-batches are taken in another order in every epoch.

Nulls, ties and edges: as in forest.Encoding. A number that does not vary is 0. Without rows to fit a model keeps its
first weights; without rows for validation it runs all epochs and keeps its last weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, shared_dir, written
from .forest import Encoding

BLOCK, MANY_TASKS, SHARD_ROWS, SHARD_BYTES = 512, 16, 65_536, 2**25
PARTS = "model int, n bigint, loss double, right bigint, grad binary"
_PARTS = pa.schema([("model", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("right", pa.int64()), ("grad", pa.binary())])
_PACKED = pa.schema([("shard", pa.int32()), ("fold", pa.int32()), ("s", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
Weights = list[tuple[np.ndarray, np.ndarray]]


def first_weights(sizes: list[int], seed: int) -> Weights:
    """Uniform within the bounds of Glorot and Bengio (2010)."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = np.sqrt((6.0 if b > 1 else 2.0) / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def _layers(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The inputs of each layer, and last the logits."""
    out = [x]
    for k, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        out.append(z if k == len(weights) - 1 else np.maximum(z, 0))
    return out


def probabilities(weights: Weights, x: np.ndarray) -> np.ndarray:
    z = _layers(weights, x)[-1][:, 0]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gradient(weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """The summed log loss of rows and its gradient, without the penalty."""
    layers = _layers(weights, x)
    z = layers[-1][:, 0]
    loss = float(np.sum(np.logaddexp(0, z) - y * z))
    back = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)[:, None]
    out: Weights = []
    for k in range(len(weights) - 1, -1, -1):
        out.append((layers[k].T @ back, back.sum(0)))
        if k:
            back = (back @ weights[k][0].T) * (layers[k] > 0)
    return loss, out[::-1]


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([p.ravel() for w in weights for p in w])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


class Adam:
    """Kingma and Ba (2015)."""

    def __init__(self, rate: float, size: int):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def copy(self) -> Adam:
        out = Adam(self.rate, 0)
        out.m, out.v, out.t = self.m, self.v, self.t
        return out

    def step(self, at: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        return at - self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v) + 1e-8)


class Fitted:
    """What fit() has found: weights, scales and the loss of each epoch, by model."""

    def __init__(self, encoding: Encoding, weights: dict, scales: dict, losses: dict, accuracies: dict):
        self.encoding, self.weights, self.scales, self.losses, self.accuracies = encoding, weights, scales, losses, accuracies


def _blocks(rows: DataFrame, encoding: Encoding, key, label: str, fold: str | None, steps: int, valid: float, shards: int = 1) -> str:
    """Writes shard, fold, and steps, features and labels of many rows together; validation rows are shard -1."""
    h = lambda word: F.xxhash64(F.lit(word), *key)
    step = F.when(F.pmod(h("valid"), F.lit(10_000)) < int(valid * 10_000), -1).otherwise(F.pmod(h("step"), F.lit(steps)).cast("int"))
    columns = [*encoding.columns(), F.col(label).cast("int").alias("__y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("__f"), step.alias("__s")]
    n = len(encoding.categorical) + len(encoding.numeric)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = encoding.matrix(batch)
            y, f, s = (batch.column(n + k).to_numpy() for k in range(3))
            of, out = np.where(s < 0, -1, s % shards), []
            for one in {*zip(of.tolist(), f.tolist(), strict=True)}:
                rows_of = np.flatnonzero((of == one[0]) & (f == one[1]))
                for at in range(0, len(rows_of), BLOCK):
                    some = rows_of[at : at + BLOCK]
                    out.append({"shard": one[0], "fold": one[1], "s": s[some].astype(np.int32).tobytes(), "x": x[some].tobytes(), "y": y[some].astype(np.int8).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PACKED)

    path = f"{shared_dir(rows.sparkSession)}/pitchflow/net-{np.random.default_rng().integers(2**62):x}"
    rows.select(*columns).mapInArrow(pack, "shard int, fold int, s binary, x binary, y binary").write.parquet(path)
    return path


def _scales(rows: DataFrame, encoding: Encoding, fold: str | None, models) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of the numbers over the rows that each model is fitted on, from sums by fold."""
    of = (F.col(fold).cast("int") if fold else F.lit(-1)).alias("f")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in encoding.numeric]
    sums = rows.select(of, *[c.alias(f"n{i}") for i, c in enumerate(numbers)]).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"n{i}").alias(f"m{i}") for i in range(len(numbers))], *[F.var_pop(f"n{i}").alias(f"v{i}") for i in range(len(numbers))]
    )
    found, out, width = sums.collect(), {}, len(numbers)
    for model in models:
        part = [r for r in found if r["f"] != model] or found
        n = np.array([r["n"] for r in part], float)[:, None]
        m, v = (np.array([[r[f"{c}{i}"] for i in range(width)] for r in part], float).reshape(len(part), width) for c in "mv")
        mean = (n * m).sum(0) / n.sum() if len(part) else np.zeros(width)
        var = (n * (v + (m - mean) ** 2)).sum(0) / n.sum() if len(part) else np.zeros(width)
        out[model] = mean, np.where(var > 1e-24, np.sqrt(var), np.inf)
    return out


def _scaled(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out, k = x.astype(float), len(scale[0])
    if k:
        out[:, -k:] = (out[:, -k:] - scale[0]) / scale[1]
    return out


def _pass(blocks: DataFrame, weights: dict[int, Weights], scales: dict, width: int, with_gradient: bool) -> dict[int, tuple[int, float, int, np.ndarray]]:
    """For each model: rows, summed loss, rows judged rightly, summed gradient, over blocks that are not of its fold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["x"], np.float32).reshape(-1, width), np.frombuffer(r["y"], np.int8)
                for model, w in weights.items():
                    if r["fold"] == model:
                        continue
                    s, at = sums.setdefault(model, [0, 0.0, 0, 0.0]), _scaled(x, scales[model])
                    s[0] += len(y)
                    if with_gradient:
                        loss, grad = gradient(w, at, y)
                        s[1], s[3] = s[1] + loss, s[3] + _flat(grad)
                    else:
                        s[2] += int(((probabilities(w, at) >= 0.5) == (y == 1)).sum())
        yield _sum_rows(sums)

    return _summed(blocks, work)


def _epoch(shards: DataFrame, state: dict[int, tuple[np.ndarray, Adam]], like: Weights, turn: np.ndarray, scales: dict, width: int, alpha: float) -> dict[int, tuple]:
    """Adam over the mini-batches of each shard, in the order of `turn`, from the same state. For each model: rows, summed loss,
    rows times steps, and rows times weights and both moments, to be divided by the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for blocks in batch.column(0):
                blocks = sorted(blocks.as_py(), key=lambda r: (r["fold"], r["s"], r["x"], r["y"]))
                for model, (flat, adam) in state.items():
                    mine = [r for r in blocks if r["fold"] != model]
                    if not mine:
                        continue
                    x, y, s = (np.concatenate([np.frombuffer(r[c], of) for r in mine]) for c, of in (("x", np.float32), ("y", np.int8), ("s", np.int32)))
                    x, at, own, total = x.reshape(-1, width), flat, adam.copy(), 0.0
                    order = np.argsort(turn[s], kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(turn[s][order])) + 1):
                        w = _shaped(at, like)
                        penalty = _flat([(a, np.zeros_like(b)) for a, b in w])
                        loss, grad = gradient(w, _scaled(x[rows], scales[model]), y[rows])
                        total += loss + alpha / 2 * float(penalty @ penalty)
                        at = own.step(at, (_flat(grad) + alpha * penalty) / len(rows))
                    found = sums.setdefault(model, [0, 0.0, 0, 0.0])
                    found[0], found[1], found[2] = found[0] + len(y), found[1] + total, found[2] + len(y) * (own.t - adam.t)
                    found[3] = found[3] + len(y) * np.concatenate([at, own.m, own.v])
        yield _sum_rows(sums)

    return _summed(shards, work)


def _summed(rows: DataFrame, work) -> dict[int, tuple]:
    """What `work` yields by task, added up by model."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _sum_rows(_added(r for batch in batches for r in batch.to_pylist()))

    parts = rows.mapInArrow(work, PARTS)
    tasks = rows.rdd.getNumPartitions()
    if tasks > MANY_TASKS:
        parts = parts.repartition(int(np.sqrt(tasks))).mapInArrow(add, PARTS)
    return {m: tuple(s) for m, s in _added(r.asDict() for r in parts.collect()).items()}


def _added(rows) -> dict[int, list]:
    sums: dict[int, list] = {}
    for r in rows:
        s = sums.setdefault(r["model"], [0, 0.0, 0, 0.0])
        s[0], s[1], s[2], s[3] = s[0] + r["n"], s[1] + r["loss"], s[2] + r["right"], s[3] + np.frombuffer(r["grad"], float)
    return sums


def _sum_rows(sums: dict[int, list]) -> pa.RecordBatch:
    rows = [{"model": m, "n": n, "loss": loss, "right": right, "grad": np.asarray(grad, float).tobytes()} for m, (n, loss, right, grad) in sums.items()]
    return pa.RecordBatch.from_pylist(rows, schema=_PARTS)


def fit(
    rows: DataFrame, encoding: Encoding, key, models, label: str = "label", fold: str | None = "fold", hidden=(256, 128, 64), rate: float = 3e-4, alpha: float = 1e-4,
    batch: int = 128, epochs: int = 350, patience: int = 20, valid: float = 0.15, seed: int = 42,
) -> Fitted:
    """A net for each of the models, the folds that it is fitted without (None: on all rows, as model -1)."""
    spark, named = rows.sparkSession, [-1 if m is None else int(m) for m in models]
    steps = max(1, round(rows.count() * (1 - valid) / batch))
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * max(1, encoding.width))) // batch)
    shards = -(-steps // most)
    path = _blocks(rows, encoding, key, label, fold, steps, valid, shards)
    table = spark.read.schema("shard int, fold int, s binary, x binary, y binary").parquet(path)
    held = written(table.where("shard < 0").select("fold", "x", "y"), "net-validation")
    # A shard is a row, so that it is read by one task; a batch of rows for Python is bounded by bytes.
    bounded_batches(spark)
    dealt = table.where("shard >= 0").repartitionByRange(shards, "shard").groupBy("shard").agg(F.collect_list(F.struct("fold", "s", "x", "y")).alias("blocks"))
    train = written(dealt.select("blocks"), "net-shards")
    any_train, any_held = not train.isEmpty(), not held.isEmpty()
    scales = _scales(rows, encoding, fold, named)
    weights = {m: first_weights([encoding.width, *hidden, 1], seed + m + 1) for m in named}
    adam = {m: Adam(rate, len(_flat(weights[m]))) for m in named}
    losses, accuracies, best, waited = ({m: [] for m in named}, {m: [] for m in named}, {m: (-1.0, weights[m]) for m in named}, dict.fromkeys(named, 0))
    running, order = list(named), np.random.default_rng(seed)
    for _ in range(epochs if any_train else 0):
        seen = {m: [0.0, 0] for m in running}
        state = {m: (_flat(weights[m]), adam[m]) for m in running}
        turn = np.argsort(order.permutation(steps))
        for m, (n, loss, taken, sums) in _epoch(train, state, weights[running[0]], turn, scales, encoding.width, alpha).items():
            flat, adam[m].m, adam[m].v = np.split(sums / n, 3)
            weights[m], adam[m].t = _shaped(flat, weights[m]), adam[m].t + round(taken / n)
            seen[m][0] += loss
            seen[m][1] += n
        for m in running:
            losses[m].append(seen[m][0] / max(seen[m][1], 1))
        judged = _pass(held, {m: weights[m] for m in running}, scales, encoding.width, False) if any_held else {}
        for m, (n, _, right, _) in judged.items():
            accuracies[m].append(right / n)
            waited[m] = 0 if right / n > best[m][0] + 1e-4 else waited[m] + 1
            if right / n > best[m][0]:
                best[m] = (right / n, weights[m])
        running = [m for m in running if waited[m] < patience]
        if not running:
            break
    return Fitted(encoding, {m: best[m][1] if accuracies[m] else weights[m] for m in named}, scales, losses, accuracies)


def scored(rows: DataFrame, fitted: Fitted, fold: str | None = None) -> DataFrame:
    """rows with p, the score of class 1 by the net of the row's fold (or the one of all)."""
    e, columns = fitted.encoding, rows.columns
    n = len(e.categorical) + len(e.numeric)
    shared = rows.sparkSession.sparkContext.broadcast((fitted.weights, fitted.scales))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scales = shared.value
        for batch in batches:
            x, folds, p = e.matrix(batch), batch.column(n).to_numpy(), np.full(batch.num_rows, np.nan)
            for m, w in weights.items():
                mine = np.flatnonzero(folds == m)
                p[mine] = probabilities(w, _scaled(x[mine], scales[m]))
            yield pa.RecordBatch.from_arrays([*batch.columns[n + 1 :], pa.array(p, from_pandas=True)], names=[*columns, "p"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "p double"])
    return written(rows.select(*e.columns(), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("__f"), *columns).mapInArrow(score, schema), "net-scores")
