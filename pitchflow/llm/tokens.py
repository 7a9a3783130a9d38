r"""Token counts that equal the tokenizer library's, for texts of any length.

A byte-level BPE tokenizer first cuts a text into pieces that are encoded apart. A space between two characters that
are not white space always begins a piece, so the text can be cut there and the parts encoded one by one: nothing
reaches across. Documents of up to `huge` characters are cut at all such spaces, each distinct part is encoded once
by the library and remembered by the worker, and the counts are added up.

Longer documents go by overlap resynchronisation: chunks that overlap are encoded with offsets; in the overlap a
place is sought that is such a space and from which on both chunks have the same tokens at the same offsets, and the
two are spliced there. If there is none, the overlap is widened until there is one or the text ends. Memory is
bounded by the chunk unless a document has no such place at all.

A tokenizer of another kind (normaliser, other pre-tokenizer, special strings with spaces) is not cut: its texts are
encoded whole. Special strings inside texts are handled as the library does by default.

Nulls, ties and edges: a null text is empty, with 0 bytes and 0 tokens. Rows are judged alone; repeated rows repeat
their result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TOKENIZER = "byte_bpe_50k.json"
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 512
REMEMBERED = 400_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s ")
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def parts_of(text: str) -> list[str]:
    """The text cut at every space between two characters that are not white space, without those spaces."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ") if text else []


def cut_at(text: str, size: int = 65_536) -> list[str]:
    """The text in stretches of about `size` characters that can be encoded one by one; cut spaces begin a stretch."""
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Encoder:
    """A tokenizer with the lengths it has found so far: of the parts that follow a cut space, and of first parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        special = spec.get("added_tokens") or []
        self.cuts = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in special)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _learn(self, known: dict, parts: set[str], lead: str) -> None:
        new = sorted(parts - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted(parts)
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([lead + p for p in some], add_special_tokens=False), strict=True):
                known[part] = len(e.ids)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
        cut = [parts_of(t) for t in texts]
        self._learn(self.first, {c[0] for c in cut if c}, "")
        self._learn(self.later, set().union(*(c[1:] for c in cut)), " ")
        return [self.first[c[0]] + sum(map(self.later.__getitem__, c[1:])) if c else 0 for c in cut]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """The ids of a long text from overlapping chunks."""
        if not self.cuts:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        def encoded(a: int, b: int) -> list[tuple[int, int, int]]:
            e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
            return [(s + a, t + a, i) for (s, t), i in zip(e.offsets, e.ids, strict=True)]

        n, out, low = len(text), [], 0
        start, stop = 0, min(n, chunk + overlap)
        left = encoded(start, stop)
        while stop < n:
            width = overlap
            begin = stop - overlap
            end = min(n, begin + chunk + overlap)
            right = encoded(begin, end)
            place = self._common(text, left, right, begin, stop)
            while place is None and stop < n:
                width *= 2
                stop = min(n, stop + width)
                end = min(n, stop + chunk)
                left, right = encoded(start, stop), encoded(begin, end)
                place = self._common(text, left, right, begin, stop)
            if place is None:
                break
            out += [i for s, t, i in left if s >= low and t <= place]
            low, left, start, stop = place, right, begin, end
        return out + [i for s, _, i in left if s >= low]

    @staticmethod
    def _common(text: str, left: list, right: list, begin: int, stop: int) -> int | None:
        """A proven boundary in text[begin:stop] from which both encodings go on alike."""
        for m in _CUT.finditer(text, begin + 1, stop - 1):
            p = m.start()
            a = [x for x in left if x[0] >= p and x[1] < stop - 32][:16]
            b = [x for x in right if x[0] >= p][: len(a)]
            if a and a == b and not any(s < p < t for s, t, _ in left) and not any(s < p < t for s, t, _ in right):
                return p
        return None


def encoder(path: str) -> Encoder:
    """The worker's own, kept for its next task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def small_slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` characters of one column, so that no step holds a whole batch of texts."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(sizes.searchsorted(done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _counts(batches: Iterator[pa.RecordBatch], path: str, huge: int, limit: int) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:
        for part in small_slices(batch, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            short = [t if len(t) <= huge else "" for t in texts]
            n = e.counts(short)
            for k, t in enumerate(texts):
                if len(t) > huge:
                    n[k] = len(e.spliced(t))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than `limit`)."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda b: _counts(b, path, huge, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
