r"""Chat formatting by columnar byte assembly.

Each turn becomes START role SEP text END. Control strings inside roles and texts are escaped reversibly: every
backslash is doubled, then a backslash is put behind the first character of each control string, so that none is left
in the text; dropping the first of each backslash and its next character gives the text back. A batch of turns is put
together at once: lengths of all parts, their cumulated offsets, and indices that scatter the bytes of the role and
text columns into one preallocated Arrow buffer.

Turns are dealt out by conversation and sorted by turn, and stay rows, so a conversation of any length goes through
a task as a stream; nothing gathers it whole. Its text is the segments of its turns, one after the other.

Nulls, ties and edges: null texts and roles are empty. Turns of equal number are ordered by role, then text; rows
that repeat are turns of their own. A null conv_id is one conversation. The loss mask covers the texts of the role
'assistant'. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import small_slices

START, SEP, END = "<|turn|>", "<|says|>", "<|over|>\n"
CONTROL = ("<|turn|>", "<|says|>", "<|over|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SEGMENTS = "conv_id bigint, turn bigint, segment string, loss_first bigint, loss_bytes bigint"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\")
    for c in CONTROL:
        column = pc.replace_substring(column, c, c[0] + "\\" + c[1:])
    return column


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values in them."""
    column = pa.concat_arrays([column])  # no slice offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Segments of a batch, and where in each its text begins and how many bytes it has."""
    n = len(texts)
    parts = [np.frombuffer(START.encode(), np.uint8), _bytes_of(roles), np.frombuffer(SEP.encode(), np.uint8), _bytes_of(texts), np.frombuffer(END.encode(), np.uint8)]
    lengths = np.stack([np.diff(p[1]) if isinstance(p, tuple) else np.full(n, len(p)) for p in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, len(parts)) if n else np.zeros((0, len(parts)), np.int64)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, p in enumerate(parts):
        if isinstance(p, tuple):
            data, offsets = p
            out[np.arange(len(data)) + np.repeat(begins[:, k] - offsets[:-1], lengths[:, k])] = data
        else:
            out[(begins[:, k, None] + np.arange(len(p))).ravel()] = np.tile(p, n)
    offsets = np.concatenate(([0], ends[:, -1])).astype(np.int32)
    segments = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return segments, begins[:, 3] - begins[:, 0], lengths[:, 3]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_slices(batch, 3, 2_000_000):
            roles, texts = part.column(2), part.column(3)
            segments, first, size = assembled(escaped(roles), escaped(texts))
            loss = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), segments, pa.array(first), pa.array(np.where(loss, size, 0))], names=["conv_id", "turn", "segment", "loss_first", "loss_bytes"])


def format_chat(turns: DataFrame) -> DataFrame:
    """SEGMENTS, one row for each turn: conversations lie in one partition each, in the order of their turns."""
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, SEGMENTS)


class _Conversation:
    def __init__(self, conv_id):
        self.id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, first: int, size: int) -> None:
        if not (segment.startswith(START) and segment.endswith(END)):
            raise ValueError(f"conversation {self.id}: a segment lacks its marks")
        role, text = segment[len(START) : -len(END)].split(SEP)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode("utf-8", "surrogatepass"))
        if size:
            masked = unescaped(segment.encode("utf-8", "surrogatepass")[first : first + size].decode("utf-8", "surrogatepass"))
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        out = []
        for conv, segment, first, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if now is None or now.id != conv:
                if now:
                    out.append(now.row())
                now = _Conversation(conv)
            now.add(segment, first, size)
        if out:
            yield batch_of(out)
    if now:
        yield batch_of([now.row()])


def read_back(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read from its segments as format_chat deals them out."""
    return segments.mapInArrow(_digests, DIGESTS)
