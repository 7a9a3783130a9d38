"""Token counts, shards, mixing, chat, quality, line dedup and the pipeline on small rows with hard cases."""

import hashlib
import random
import re
import string

import numpy as np
import pytest

import corpus_pipeline
from pitchflow.llm import chat, line_dedup, mixing, quality, token_shards, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3)


HARD = [
    None,
    "",
    " ",
    "a",
    " a  b ",
    "one two\nthree \n four\t five",
    "x<|endoftext|> y <|endoftext|>",
    "it's  o'clock 's 're    é ñ z",
    "a\x1cb \x1c c\x85 d",
    "日本語 テキスト 。 12 3,4",
    "😀 👍🏽 ok",
    "&&& ### !!  ??",
    "tail ",
    "\n\n\n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def random_text(rng, n):
    return "".join(rng.choice(string.ascii_letters + "      \n,.é'1") for _ in range(n))


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(2)
    texts = HARD + [random_text(rng, rng.randrange(1, 400)) for _ in range(60)] + ["word " * 20_000, "x" * 40_000, random_text(rng, 50_000)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in tokens.count_tokens(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), t
    assert tokens.count_tokens(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 60), (64, 40), (1000, 100)])
def test_overlaps_are_spliced(library, chunk, overlap):
    rng = random.Random(chunk)
    e = tokens.Encoder(tokens.default_path())
    for t in [random_text(rng, 3000), "é" * 700 + " a" * 500, "x" * 1500, " ".join(HARD[3:]) * 9, "a " * 2000]:
        assert e.spliced(t, chunk, overlap) == library.encode(t, add_special_tokens=False).ids


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(token_shards.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    assert token_shards.feistel(np.arange(1000), 1000, 1).tolist() != token_shards.feistel(np.arange(1000), 1000, 2).tolist()


def test_shards_hold_the_stream(spark, library, tmp_path):
    rng = random.Random(4)
    texts = HARD + [random_text(rng, rng.randrange(1, 900)) for _ in range(80)] + ["same text", "same text"]
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).write.parquet(src)
    docs = spark.read.parquet(src)
    total = token_shards.write_shards(docs, out, length=32, per_shard=50)
    records = {r.slot: r for r in token_shards.read_shards(spark, out, 32).collect()}
    n = len(records)
    shards = token_shards.manifest(spark, out, 32)
    assert sorted(records) == list(range(n)) and sum(k for _, _, k in shards) == n
    assert all(records[at + i].shard == s and records[at + i].offset == i * 65 for s, at, k in shards for i in range(k))
    library.encode_special_tokens = True
    order = docs.select("text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    streams = {}
    for r in order:
        streams.setdefault(r.file_path, []).extend([*library.encode(r.text or "", add_special_tokens=False).ids, token_shards.END])
    library.encode_special_tokens = False
    want = []
    for ids in streams.values():
        ids += [token_shards.END] * (-len(ids) % 32)
        want += [np.array(ids[k : k + 32], "<u2").tobytes() for k in range(0, len(ids), 32)]
    assert sorted(bytes(r.record) for r in records.values()) == sorted(want)
    # the order is that of the permuted ordinals
    bounds = [-(-sum(len((r.text or "").encode()) + 1 for r in order if r.file_path == f) // 32) for f in streams]
    ordinals = [sum(bounds[:k]) + i for k, ids in enumerate(streams.values()) for i in range(len(ids) // 32)]
    place = token_shards.feistel(np.array(ordinals), total, 17)
    assert total == sum(bounds) and [bytes(records[s].record) for s in range(n)] == [want[k] for k in np.argsort(place)]
    assert sorted(r.slot for r in token_shards.read_shards(spark, out, 32, first_slot=70).collect()) == list(range(70, n))
    assert token_shards.shard_report(docs, length=32, per_shard=50).count() == n
    assert token_shards.shard_report(docs_of(spark, [(1, "not a table of files", "s")])).count() == 1
    assert token_shards.shard_report(docs.limit(0)).count() == 0
    assert "".join(tokens.cut_at("ab  c d\n e" * 50, 7)) == "ab  c d\n e" * 50 and len(tokens.cut_at("a b " * 50, 7)) > 10


def test_frames_are_less_than_a_block_off():
    rng = random.Random(6)
    for _ in range(30):
        counts = {f"s{k}": rng.randrange(0, 40) for k in range(rng.randrange(1, 9))}
        order, total = mixing.frame_order(counts), sum(counts.values())
        assert len(order) == total
        sent = dict.fromkeys(counts, 0)
        for t, s in enumerate(order, 1):
            sent[s] += 1
            assert all(abs(sent[x] - c * t / total) < 1 for x, c in counts.items())


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"a": 1, "b": 7, "": 2}])
def test_mix(spark, weights):
    rows = [(i, f"t{i}", "a" if i % 3 else None) for i in range(90)] + [(i, "t", "b") for i in range(200, 213)] + [(900, "x", "c"), (900, "x", "c")]
    out = mixing.mix(docs_of(spark, rows).withColumnRenamed("n_chars", "block"), weights, block_rows=4).collect()
    n = len(rows)
    assert sorted(r.position for r in out) == list(range(n))
    by_source, slot_of = {}, {}
    for r in sorted(out, key=lambda r: r.position):
        by_source.setdefault(r.source or "", []).append(r)
        slot_of.setdefault(r.slot, set()).add((r.source, r.block))
    assert sorted(slot_of) == list(range(len(slot_of))) and all(len(x) == 1 for x in slot_of.values())
    for rs in by_source.values():
        assert [r.block for r in rs] == [k // 4 for k in range(len(rs))]
    # while all sources have blocks, no source is a whole block from its share
    sizes = {s: len(rs) for s, rs in by_source.items()}
    w = mixing.square_root_weights(sizes) if weights is None else {s: weights.get(s, 1) for s in sizes}
    frames = min(-(-n // 4) // w[s] for s, n in sizes.items())
    total = sum(w.values())
    for t in range(1, frames * total + 1):
        for s in sizes:
            sent = sum(1 for k in range(t) if (next(iter(slot_of[k]))[0] or "") == s)
            assert abs(sent - w[s] * t / total) < 1
    assert mixing.mix(docs_of(spark, rows).limit(0)).count() == 0


def test_mix_of_many_sources_is_bounded(spark):
    # 3 large sources, scheduled alone, and 40 small ones in two size classes
    sizes = {"x": 400, "y": 300, "z": 200} | {f"s{k}": 2 if k % 2 else 5 for k in range(40)}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mixing.mix(docs_of(spark, rows), block_rows=4, alone=3).collect()
    assert sorted(r.position for r in out) == list(range(len(rows))) and sorted(r.doc_id for r in out) == list(range(len(rows)))
    slot_of = {}
    for r in out:
        slot_of.setdefault(r.slot, set()).add(r.source if r.source in "xyz" else f"size {sizes[r.source]}")
    assert sorted(slot_of) == list(range(len(slot_of))) and all(len(x) == 1 for x in slot_of.values())
    weight = {"x": 400**0.5, "y": 300**0.5, "z": 200**0.5, "size 2": 20 * 2**0.5, "size 5": 20 * 5**0.5}
    shares = {s: max(1, round(100 * w / sum(weight.values()))) for s, w in weight.items()}
    blocks = {"x": 100, "y": 75, "z": 50, "size 2": 10, "size 5": 25}
    counts = {s: min(shares[s], blocks[s]) for s in shares}  # the first frame
    total, sent = sum(counts.values()), dict.fromkeys(shares, 0)
    for t in range(1, total + 1):
        sent[next(iter(slot_of[t - 1]))] += 1
        assert all(abs(sent[s] - c * t / total) < 1 for s, c in counts.items())


def test_mix_with_null_texts_and_long_ones(spark):
    rows = [(i, None if i % 2 else "x" * (200_000 if i == 4 else 3), "a") for i in range(20)] + [(None, None, None)]
    out = mixing.mix(docs_of(spark, rows), block_rows=4).collect()
    assert sorted(r.position for r in out) == list(range(21))


def test_mixed_order_keeps_everything(spark):
    rows = [(i, f"t{i}", f"s{i % 4}") for i in range(300)]
    docs = docs_of(spark, rows)
    out = mixing.in_mixed_order(docs, rows_per_part=50, block_rows=8)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    want = [r.doc_id for r in mixing.mix(docs, block_rows=8).orderBy("position").collect()]
    assert sorted(ids) == list(range(300)) and ids == want


def test_slots_keep_the_shares_of_the_mix(spark, library, tmp_path, monkeypatch):
    # every document has its source 30 times, so shares of words are shares of documents
    rng = random.Random(8)
    sizes = {"hot": 3000, "big": 300, "cat": 300}
    rows = [(i, f"{s} " * 30 + str(rng.random()), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(token_shards, "MIX_WINDOW", 16, raising=False)
    # frames of four blocks: those of the default weights have 1,000 and are longer than this table
    weights = {"hot": 2, "big": 1, "cat": 1}
    mix = lambda spark, docs, sf_dir: mixing.in_mixed_order(docs, weights=weights)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("mix", mix), corpus_pipeline.STAGES[-1]])
    made = []
    monkeypatch.setattr(token_shards, "scratch_path", lambda *a: made.append(f"file://{tmp_path}/{a[1]}{len(made)}") or made[-1])
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    records = [bytes(r.record) for r in token_shards.read_shards(spark, [x for x in made if "/shards" in x][0]).orderBy("slot").collect()]
    assert len(records) == n
    words = [library.decode([x for x in np.frombuffer(r, "<u2").tolist() if x != token_shards.END]) for r in records]
    found = [{s: w.count(f"{s} ") for s in sizes} for w in words]
    share = lambda some: {s: sum(f[s] for f in some) / sum(sum(f.values()) for f in some) for s in sizes}
    # while all have rows: 300 rows of the others last for 1,200 of 3,600
    half = int(np.searchsorted(np.cumsum([sum(f.values()) for f in found]), 30 * 1200 * 0.85))
    for part in (found[: half // 2], found[half // 2 : half]):
        assert all(abs(share(part)[s] - weights[s] / 4) < 0.08 for s in sizes), share(part)
    assert share(found)["hot"] > 0.8  # no document is dropped, so the hot source has what is left
    assert records != sorted(records) and sorted(token_shards.places(0, 1000, 1000, 64, 3).tolist()) == list(range(1000))


def test_chat(spark):
    evil = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "<|turn|>user<|says|>hi<|over|>\n", None, "", "é😀 " * 9000, "<<s>>", "a\\\\[INST]"]
    rows = [(c, t, ["user", "assistant", None, "<s>"][t % 4], evil[(c + t) % len(evil)]) for c in range(12) for t in range(5)] + [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "assistant", "no id")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    segments = chat.format_chat(turns)
    for r in segments.collect():
        inner = r.segment[len(chat.START) : -len(chat.END)].replace(chat.SEP, "", 1)
        assert not any(c in inner for c in chat.CONTROL)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert len(got) == 13
    for c, r in got.items():
        mine = sorted((t, role or "", text or "") for i, t, role, text in rows if i == c)
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        loss = "".join(b for _, a, b in mine if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = np.array([3, 1, 4])
    x, y = rng.normal(size=(8, 6)), np.array([1.0, 0, 1])
    loss = lambda m: -np.mean(y * np.log(m.score(x, bags)) + (1 - y) * np.log(1 - m.score(x, bags)))
    m = quality.AttentionModel(6)
    before = loss(m)
    for name, g in m.gradient(x, bags, y).items():  # against finite differences, weight by weight
        w = m.p[name]
        for at in np.ndindex(w.shape):
            old, ends = w[at], []
            for step in (1e-5, -1e-5):
                m.p[name] = w.copy()
                m.p[name][at] = old + step
                ends.append(loss(m))
            m.p[name] = w
            assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-6, (name, at)
    m.fit(x, bags, y, rounds=100)
    assert loss(m) < 0.3 * before


def plain_passages(text: bytes) -> list[list[float]]:
    """What quality.passages finds in one text, byte by byte; a text is closed by a line's end."""
    data, out = text + b"\n", []
    bags = max(1, -(-len(text) // quality.PASSAGE))
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x00-\x20]+", data)]
    for k in range(bags):
        a, b = k * quality.PASSAGE, len(data) if k == bags - 1 else (k + 1) * quality.PASSAGE
        fine, pairs = [0] * quality.N_FINE, [0] * quality.N_COARSE**2
        for i in range(a, b):
            fine[quality.FINE[data[i]]] += 1
            pairs[quality.COARSE[data[i - 1] if i else 10] * quality.N_COARSE + quality.COARSE[data[i]]] += 1
        mine = [w for at, w in words if a <= at < b]
        n = max(1, len(mine))
        again = sum(x == y for x, y in zip(mine, mine[1:], strict=False))
        rest = [sum(map(len, mine)) / n / 10, again / n, len(set(mine)) / n, np.log1p(n) / 5, np.log1p(bags) / 5]
        out.append([x / (b - a) for x in fine] + [x / (b - a) for x in pairs] + rest)
    return out


def test_passages_equal_the_plain_version():
    rng = random.Random(13)
    texts = [b"", b" ", b"a", b"from from from x", b"x" * 1024, b"x" * 1025, b"ab " * 700, "é 日本 😀 A1!".encode() * 200, random_text(rng, 5000).encode(), b"\n\n"]
    x, bags = quality.passages(texts)
    want = [plain_passages(t) for t in texts]
    assert bags.tolist() == [len(w) for w in want]
    np.testing.assert_allclose(x, np.array([r for w in want for r in w]), atol=1e-6)


def test_quality_sample_is_bounded(spark):
    assert quality.fitting([5, 9, 4, 1], 10) == [True, False, True, True] and quality.fitting([], 3) == []
    rows = [(i, f"{'good text' if i % 2 else 'from from'} {i}", "s") for i in range(60)] + [(61, "good " * 1000, "s")]
    docs, labels = docs_of(spark, rows + [rows[3]] * 5), spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id bigint, quality int, toxic int")
    scores = lambda **o: sorted((r.doc_id, r.score) for r in quality.scores(docs, quality.train(docs, labels, **o)).collect())
    assert scores(max_bytes=10**6) != scores(max_bytes=300) and scores(max_bytes=0)[0][1] == 0.5
    # one class alone: all documents are kept or all dropped
    for q in (0, 1):
        model = quality.train(docs, labels.where(f"quality = {q}"))
        assert quality.keep_good(docs.withColumnRenamed("n_chars", "score"), model).count() == q * docs.count()


def test_quality_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 400))]
        good = i % 4 != 0
        # only a part of a bad document is bad
        rows.append((i, " ".join(words if good else words[: len(words) // 2] + ["from"] * (len(words) // 2)), "s"))
        labels.append((i, int(good), 0))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "from " * 50_000, "s"), (5002, "from " * 50_000, "s"), (None, "x", "s")]
    docs = docs_of(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (77_777, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, table)
    out = quality.scores(docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [i for i, *_ in labels if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 != 0) for i in held) > 0.97 * len(held)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i, r in got.items() if r.predicted}
    again = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs.repartition(7), table)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    assert quality.scores(docs, quality.train(docs, table.limit(0))).where("score = 0.5").count() == len(rows)
    assert quality.scores(docs.limit(0), model).count() == 0


def test_line_dedup(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, "a\nb\nc\nd", "s"),
        (2, "x\na\n b\nc \ny", "s"),
        (3, "a\nb\nc\nd", "s"),
        (4, f"{long}\nend", "s"),
        (5, f"top\n{long}\nother\nmore", "s"),
        (6, None, "s"),
        (7, "", "s"),
        (8, "\n\n\n\n", "s"),
        (9, "k\nk\nk\nk\nk", "s"),
        (10, "lone", "s"),
        (10, "lone", "s"),
        (11, "lone", "s"),
    ]
    docs = docs_of(spark, rows)
    out = line_dedup.cut_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {(r.doc_id): (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert got[1] == ("a\nb\nc\nd", 4, 0) and got[2] == ("x\ny", 5, 3) and got[3] == ("", 4, 4)
    assert got[4][2] == 0 and got[5] == ("top\nother\nmore", 4, 1)
    assert got[6] == (None, 1, 0) and got[7] == ("", 1, 0) and got[8][2] == 0
    assert got[9] == ("k\nk\nk", 5, 2) and got[10] == ("lone", 1, 0) and got[11] == ("", 1, 1)
    assert out.count() == len(rows) and line_dedup.cut_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_two_lines_in_both_orders(spark):
    words = lambda mark, n: " ".join(f"{mark}{k}" for k in range(n))
    for first, second in ((words("p", 55), words("q", 40)), (words("p", 40), words("q", 55)), (words("p", 60), words("q", 70))):
        run = f"{first}\n{second}"
        rows = [(1, f"a\n{run}\nb", "s"), (2, f"c\n{run}\nd", "s"), (3, run, "s"), (4, f"{second}\n{first}\ne", "s")]
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.cut_lines(docs_of(spark, rows)).collect()}
        assert got[1] == (f"a\n{run}\nb", 0) and got[2] == ("c\nd", 2) and got[3] == ("", 2)
        # in the other order only lines that are long by themselves are repeats
        assert got[4][0] == "\n".join([x for x in (second, first) if len(x.split()) < 50] + ["e"])


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 9)))
    bench = " ".join(word() for _ in range(20))
    rows, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        t = "from " * 200 if bad else " ".join(word() for _ in range(150))
        rows.append((i, t, f"s{i % 3}"))
        labels.append((i, int(not bad), 0))
    rows[7] = (7, rows[6][1], "s1")
    rows[8] = (8, rows[8][1] + " " + bench, "s2")
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
            left[name] = {r.doc_id for r in docs.collect()}
    clean = {i for i in range(200) if i % 5}
    assert left["quality"] == clean
    assert left["near_duplicates"] == clean - {7}
    assert left["decontamination"] == left["mix"] == clean - {7, 8}
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_shards_of_a_filtered_table(spark, tmp_path):
    rng = random.Random(9)
    texts = [random_text(rng, rng.randrange(1, 300)) for _ in range(100)] + [random_text(rng, 150_000), None]
    docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1).write.parquet(f"{tmp_path}/src")
    docs = spark.read.parquet(f"{tmp_path}/src")
    some = docs.where("doc_id % 2 = 0")
    total = token_shards.write_shards(some, f"{tmp_path}/out", length=32, per_shard=50)
    # one split, hence one stream and one sequence that is filled up
    assert total == -(-sum(len((t or "").encode()) + 1 for t in texts[::2]) // 32)
    read = [bytes(r.record) for r in token_shards.read_shards(spark, f"{tmp_path}/out", 32).collect()]
    ids = np.frombuffer(b"".join(read), "<u2")
    assert (ids == token_shards.END).sum() - 51 < 32
    e = token_shards.encoder(token_shards.default_path())
    want = [i for t in texts[::2] for i in [*e.encode_ordinary(t or ""), token_shards.END]]
    assert len(ids) == -(-len(want) // 32) * 32 and np.bincount(ids).tolist()[: token_shards.END] == np.bincount(want).tolist()[: token_shards.END]


def test_shards_do_not_depend_on_the_cluster(spark, tmp_path):
    rng = random.Random(10)
    docs_of(spark, [(i, random_text(rng, 400), "s") for i in range(300)]).write.parquet(f"{tmp_path}/src")
    docs, found, name = spark.read.parquet(f"{tmp_path}/src"), [], "spark.sql.files.minPartitionNum"
    for k, cores in enumerate(("1", "64")):
        spark.conf.set(name, cores)
        spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
        try:
            token_shards.write_shards(docs, f"{tmp_path}/out{k}", length=32, per_shard=50)
            assert spark.conf.get(name) == cores
        finally:
            spark.conf.unset(name)
            spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        found.append({r.slot: bytes(r.record) for r in token_shards.read_shards(spark, f"{tmp_path}/out{k}", 32).collect()})
    assert found[0] == found[1] and sorted(found[0]) == list(range(len(found[0])))


def test_clashing_columns_long_texts_and_repeats(spark, library):
    long = "\n".join(f"line {k} of a very long text" for k in range(20_000))
    rows = [(1, long, "s"), (2, long, "s"), (3, "one two", "s"), (3, "one two", "s"), (4, None, "s")]
    docs = docs_of(spark, rows)
    clash = docs.withColumnsRenamed({"n_chars": "n_tokens", "source": "slot", "lang": "n_removed"})
    got = tokens.count_tokens(clash).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4] and {r.n_tokens for r in got if r.doc_id == 3} == {2}
    cut = {r.doc_id: r for r in line_dedup.cut_lines(clash).collect()}
    assert cut[1].text == long and cut[1].n_removed == 0 and cut[2].text == "" and cut[2].n_removed == 20_000
    assert line_dedup.cut_lines(clash).count() == 5
    assert token_shards.shard_report(clash, length=32, per_shard=5000).count() > 1000
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", long, "y"), (1, 1, "assistant", long, "y")], "conv_id bigint, turn bigint, role string, text string, segment string")
    (r,) = chat.read_back(chat.format_chat(turns)).collect()
    assert r.n_turns == 3 and r.loss_chars == 2 * len(long)


def pipeline_tables(spark, path, rows, labels, bench):
    docs_of(spark, rows).write.parquet(f"{path}/documents.parquet") if rows else spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def stages(spark, path):
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(path)).write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        left[name] = docs.collect()
    return left


def test_pipeline_edges(spark, tmp_path):
    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n))
    base = text(80).split()
    near = [*base[:40], "changed", *base[41:]]
    rows = [(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, None, None), (4, "", "a"), (5, " ", "a"), (6, text(60), None), (6, text(60), "b"), (7, " ".join(base), "a"), (7, " ".join(base), "a"), (None, text(50), "a"), (8, text(30_000), "a"), (9, f"{text(20)} some benchmark words {text(20)}", "b")]
    pipeline_tables(spark, tmp_path, rows, [], [(None, "some benchmark words"), (3, None), (4, "")])
    left = stages(spark, tmp_path)
    ids = lambda name: sorted(-1 if r.doc_id is None else r.doc_id for r in left[name])
    assert ids("quality") == [-1, 1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 9]  # without labels every score is 0.5
    # near and exact copies give way to the smallest id, texts without words count as one; an id may name two texts
    assert ids("near_duplicates") == [-1, 1, 3, 6, 6, 8, 9] and ids("decontamination") == ids("mix") == [-1, 1, 3, 6, 6, 8]
    assert sorted(r.slot for r in left["shards"]) == list(range(len(left["shards"]))) and left["shards"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline_tables(spark, tmp_path, [], [], [])
    assert all(rows == [] for rows in stages(spark, tmp_path).values())
    (tmp_path / "one").mkdir()
    pipeline_tables(spark, tmp_path / "one", [(1, "from from", "s"), (2, "a b", "s")], [(1, 0, 0), (2, 0, 0), (3, 0, 0)], [])
    assert stages(spark, tmp_path / "one")["quality"] == []  # labels of one class, 0, drop all
