r"""Quality classifier by attention over a document's passages (multiple-instance learning).

A document is a bag of passages of 1,024 bytes, all of them, however many. Each passage is encoded by what its bytes
and words look like: shares of character classes and of pairs of them, word length, repeated and distinct words. A
small network encodes passages further, a gated attention (Ilse, Tomczak, Welling 2018) learns from document labels
alone which passages matter, and the weighted passage is scored.

Fitted on a bounded sample: the `max_train` labelled documents with the smallest keyed hash of their doc_id, among
those whose crc32(doc_id) mod 3 is not 1, as far as their texts fit in `max_bytes` together; one that does not fit is
passed over, and a text is taken whole or not at all. Only passage vectors of these, about 0.4 bytes for each byte of
text, reach the driver. Every document is scored, whole. Scores come from the text alone.

Nulls, ties and edges: null and empty texts are one passage of no words and are scored as such. A doc_id labelled
both 0 and 1 counts as 1; labels that are null or without a document are left out. Of rows that repeat a labelled
doc_id one is learned from, the shortest text, then that of the smallest hash. A very long text is scored whole:
its passages are encoded some at a time and pooled under a running maximum. With no usable label, or only one class, every score is that class's share (0.5 without labels), so `keep_good` keeps all, or none if all labels are 0. Repeated rows repeat their result. Only doc_id
and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_table, bounded_batches, trimmed
from .tokens import small_slices

PASSAGE = 1024
MAX_TRAIN = 4000
MAX_BYTES = 64_000_000
#: Bytes of text that are looked at together; a worker needs about 100 times as much memory.
SLICE = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    own = 8
    for c in range(256):
        if 97 <= c <= 122:
            fine[c], coarse[c] = 0, 0
        elif 65 <= c <= 90:
            fine[c], coarse[c] = 1, 1
        elif 48 <= c <= 57:
            fine[c], coarse[c] = 2, 2
        elif c == 32:
            fine[c], coarse[c] = 3, 3
        elif c == 10:
            fine[c], coarse[c] = 4, 4
        elif c < 32 or c == 127:
            fine[c], coarse[c] = 5, 4
        elif c >= 192:
            fine[c], coarse[c] = 6, 5
        elif c >= 128:
            fine[c], coarse[c] = 7, 5
        else:
            fine[c], coarse[c] = own, 6
            own += 1
    return fine, coarse


FINE, COARSE = _classes()
N_FINE, N_COARSE = int(FINE.max()) + 1, int(COARSE.max()) + 1
WIDTH = N_FINE + N_COARSE**2 + 5
MEAN_CHARS = WIDTH - 5
#: Passages of a long text that are looked at together, and how far the last word of a stretch is followed; what lies
#: beyond counts in its length only.
STRETCH, LONGEST = 256, 1 << 20
_BREAK = re.compile(rb"[\x00-\x20]")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, back = np.full(n, _STEP, np.uint64), np.full(n, np.uint64(pow(int(_STEP), -1, 2**64)), np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


_POWERS: list[np.ndarray] = []


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One row for each passage, and the number of passages of each text (one at least)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    n = len(data)
    sizes = np.array([len(t) + 1 for t in texts])
    bags = np.maximum(1, -(-(sizes - 1) // PASSAGE))
    text_at = np.cumsum(sizes) - sizes
    total = int(bags.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(bags) - bags, bags)
    at = np.repeat(text_at, bags) + nth * PASSAGE
    length = np.diff(np.append(at, n))
    pid = np.repeat(np.arange(total), length)
    fine = np.bincount(pid * N_FINE + FINE[data], minlength=total * N_FINE).reshape(total, N_FINE)
    kind = COARSE[data]
    behind = np.concatenate(([COARSE[10]], kind[:-1]))  # a text begins as after a line's end
    pairs = np.bincount(pid * N_COARSE**2 + behind * N_COARSE + kind, minlength=total * N_COARSE**2).reshape(total, -1)

    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = _powers(max(n + 1, 1 << 16))
    up, down = _POWERS
    solid = np.concatenate(([False], data > 32, [False]))
    first, last = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[:n], dtype=np.uint64)))
    words = (sums[last] - sums[first]) * down[first]
    wpid, chars = pid[first], last - first
    n_words = np.maximum(1, np.bincount(wpid, minlength=total))
    again = (words[1:] == words[:-1]) & (wpid[1:] == wpid[:-1])
    key = words ^ (wpid.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount(wpid[order][new], minlength=total)
    mean_chars = np.bincount(wpid, chars, minlength=total) / n_words
    x = np.concatenate(
        [
            fine / length[:, None],
            pairs / length[:, None],
            np.stack([mean_chars / 10, np.bincount(wpid[1:][again], minlength=total) / n_words, distinct / n_words, np.log1p(n_words) / 5, np.log1p(np.repeat(bags, bags)) / 5], axis=1),
        ],
        axis=1,
    )
    return x.astype(np.float32), bags


def stretches(text: bytes, each: int = STRETCH) -> Iterator[np.ndarray]:
    """The rows of passages([text]), `each` at a time, in memory of about 100 times a stretch.

    A stretch is looked at with the passage before it, where words that reach into it begin, and with the rest of its
    last word; the rows of both are left out.
    """
    total = max(1, -(-len(text) // PASSAGE))
    for k in range(0, total, each):
        begin, end = k * PASSAGE, min(len(text), (k + each) * PASSAGE)
        lead = PASSAGE if k else 0
        more = left_out = 0
        if end < len(text):
            more = 1
            last = end  # where the word that reaches over the end begins
            while last > begin - lead and text[last - 1] > 32:
                last -= 1
            if last >= begin and last < end and text[end] > 32:
                found = _BREAK.search(text, end)
                rest = (found.start() if found else len(text)) - end
                more = min(max(1, rest), LONGEST)
                left_out = rest - more if rest > more else 0
        x = passages([text[begin - lead : end + more]])[0]
        x = x[lead // PASSAGE : lead // PASSAGE + -(-(end - begin) // PASSAGE)] if len(text) else x
        x[:, -1] = np.log1p(total) / 5
        if left_out:
            row = (last - begin) // PASSAGE
            x[row, MEAN_CHARS] += left_out / np.expm1(5 * float(x[row, MEAN_CHARS + 3])) / 10
        yield x


class AttentionModel:
    """Gated-attention pooling over passages; weights are plain arrays, sent along with the scoring tasks."""

    HIDDEN, GATES = 24, 12

    def __init__(self, width: int = WIDTH, seed: int = 5):
        r = np.random.default_rng(seed)
        h, g = self.HIDDEN, self.GATES
        shapes = {"W": (width, h), "b": (h,), "V": (h, g), "U": (h, g), "w": (g,), "c": (h,), "d": ()}
        self.p = {k: r.normal(0, 1 / np.sqrt(max(1, s[0])) if s else 0, s) for k, s in shapes.items()}
        self.mean, self.scale, self.constant = np.zeros(width), np.ones(width), None

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p, at = self.p, np.cumsum(bags) - bags
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        a = e / np.repeat(np.add.reduceat(e, at), bags)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "at": at, "p": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def score_stretches(self, parts: Iterator[np.ndarray]) -> float:
        """The score of one text from its passages some at a time: sums of the attention under a running maximum."""
        if self.constant is not None:
            return float(self.constant)
        p, most, total, z = self.p, -np.inf, 0.0, 0.0
        for x in parts:
            h = np.tanh(np.clip((x - self.mean) / self.scale, -5, 5) @ p["W"] + p["b"])
            e = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
            now = max(most, float(e.max()))
            w, before = np.exp(e - now), np.exp(most - now)
            most, total, z = now, total * before + w.sum(), z * before + w @ h
        return float(1 / (1 + np.exp(-np.clip(z / total @ p["c"] + p["d"], -30, 30))))

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return np.full(len(bags), self.constant) if self.constant is not None else self._forward(x, bags)["p"]

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by weight."""
        f, p = self._forward(x, bags), self.p
        ds = (f["p"] - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], bags, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), bags))
        dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        du = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ du, "w": de @ (f["t"] * f["s"]), "c": ds @ f["z"], "d": ds.sum()}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0, dtype=np.float64), np.maximum(x.std(axis=0, dtype=np.float64), 1e-4)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        for i in range(1, rounds + 1):
            for k, g in self.gradient(x, bags, y).items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 2, SLICE):
            texts = [_encode(t) for t in part.column(2).to_pylist()]
            if len(texts) == 1:
                rows = [np.concatenate(list(stretches(texts[0]))).tobytes()]
            else:
                x, bags = passages(texts)
                rows = [x[b - k : b].tobytes() for b, k in zip(np.cumsum(bags), bags, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])


def fitting(sizes: list[int], most: int) -> list[bool]:
    """Which of the sizes, one after the other, still fit in `most` together."""
    used, out = 0, []
    for n in sizes:
        out.append(used + n <= most)
        used += n if out[-1] else 0
    return out


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> AttentionModel:
    """Fits on at most max_train labelled documents, of max_bytes together, outside the held-out third."""
    spark = docs.sparkSession
    bounded_batches(spark)
    doc = F.col("doc_id").cast("bigint")
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(doc)).groupBy(doc.alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    # Only labels of documents that are there count towards the bound.
    known = known.join(docs.select(doc.alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("quality"), "doc_id")
    some = known.orderBy(order, "doc_id").limit(max_train)
    texts = docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    # One text for each document: at most max_train rows, of three numbers each, come to the driver here.
    size = F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "th")).alias("x")
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(size).select("doc_id", "quality", "x.n", "x.th").orderBy(order, "doc_id").collect()
    taken = [(r.doc_id, r.quality, r.th) for r, fits in zip(found, fitting([r.n for r in found], max_bytes), strict=True) if fits]
    chosen = arrow_table(spark, taken, pa.schema({"doc_id": pa.int64(), "quality": pa.int32(), "th": pa.int64()}))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "th"]).select("doc_id", "quality", "text")
    vectors = rows.mapInArrow(lambda b: trimmed(_vectors(b)), "doc_id bigint, quality int, x binary").dropDuplicates(["doc_id"])
    got = sorted(map(tuple, vectors.collect()))
    vectors = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, _, x in got]
    x = np.concatenate(vectors) if vectors else np.zeros((0, WIDTH), np.float32)
    return AttentionModel().fit(x, np.array([len(v) for v in vectors], int), np.array([q for _, q, _ in got], float))


def _scorer(model: AttentionModel):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(scored(batches))

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [np.zeros(0)]
            for part in small_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, SLICE):
                found = [_encode(t) for t in part.column(0).to_pylist()]
                one = len(found) == 1 and len(found[0]) > SLICE
                out.append(np.array([model.score_stretches(stretches(found[0]))]) if one else model.score(*passages(found)))
            yield pa.array(np.concatenate(out))

    return score


def scores(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    doc = F.col("doc_id").cast("bigint")
    out = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), _scorer(model)(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """The documents predicted 1, with all their columns."""
    bounded_batches(docs.sparkSession)
    return docs.where(_scorer(model)(F.col("text").cast("string")) >= 0.5)
