"""Very long texts in the quality classifier, frames as long as their weights need, and the passing digest index."""

import random
import tracemalloc

import numpy as np
import pytest

from pitchflow.llm import exact_dedup, license_scan, mixing, quality, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3)


def bytes_of(rng, n, long_words):
    out = []
    while sum(map(len, out)) < n:
        size = rng.choice([1, 3, 5, 8, 3000] if long_words else [1, 3, 5, 8])
        out.append("".join(rng.choice("abcé.9Z") for _ in range(size)) + rng.choice([" ", "\n", "  "]))
    return "".join(out).encode()


@pytest.mark.parametrize("long_words", [False, True])
def test_stretches_are_the_passages(long_words, monkeypatch):
    rng, model = random.Random(3), quality.AttentionModel()
    for n in (0, 1, 1024, 5000, 40_000):
        text = bytes_of(rng, n, long_words) if n else b""
        x, bags = quality.passages([text])
        for each in (1, 2, 7, 256):
            got = np.concatenate(list(quality.stretches(text, each)))
            assert got.shape == x.shape and np.allclose(got, x, atol=1e-6)
            assert abs(model.score(x, bags)[0] - model.score_stretches(quality.stretches(text, each))) < 1e-6
    monkeypatch.setattr(quality, "LONGEST", 4000)
    text = b"a " + b"y" * 100_000 + b" b"
    assert np.allclose(np.concatenate(list(quality.stretches(text, 16))), quality.passages([text])[0], atol=1e-4)


def test_a_very_long_text_in_little_memory(spark):
    text = ("lorem ipsum dolor " * 3_000_000).encode()
    tracemalloc.start()
    quality.AttentionModel().score_stretches(quality.stretches(text))
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    long = "good words follow, one by one.\n" * 40_000
    docs = docs_of(spark, [(1, long, "a"), (2, long[:500], "a"), (3, None, "a")])
    model = quality.AttentionModel()
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    assert abs(got[1] - model.score(*quality.passages([long.encode()]))[0]) < 1e-6 and len(got) == 3


def test_frames_are_as_long_as_the_weights_need(spark):
    assert mixing._whole_shares({"a": 99_990, "b": 10}) == {"a": 9999, "b": 1}
    assert mixing._whole_shares({"a": 6, "b": 4}) == {"a": 3, "b": 2}
    rows = [(i, f"t{i}", "a") for i in range(24_000)] + [(30_000 + i, f"u{i}", "b") for i in range(40)]
    out = mixing.mix(docs_of(spark, rows), {"a": 99_900, "b": 100}, block_rows=1, only_ids=True).collect()
    sent = 0
    for t, r in enumerate(sorted(out, key=lambda r: r.position)[:20_000], 1):
        sent += r.source == "b"
        assert abs(sent - t / 1000) < 1


def test_a_passing_index_leaves_no_table_and_counts_the_batch(spark):
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(i, "hot" if i < 300 else f"t{i % 40}", "s") for i in range(400)]
    index = exact_dedup.DigestIndex(spark, "digest_bounds")
    index.add(exact_dedup.digests(docs_of(spark, [(9000, "HOT", "s")])))
    got = exact_dedup.decisions(docs_of(spark, rows), index).collect()
    assert len(got) == 400 and {(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id < 300} == {(9000, 1, False)}
    alone = exact_dedup.decisions(docs_of(spark, rows)).collect()
    assert sum(r.kept for r in alone) == 41 and {r.group_size for r in alone if r.doc_id < 300} == {300}
    assert {t.name for t in spark.catalog.listTables()} - before == {"digest_bounds"}
    spark.sql("DROP TABLE digest_bounds")


def test_a_file_of_all_licences_has_all_labels(spark):
    every = {t.label for t in license_scan.TEXTS}
    rng = random.Random(9)
    orders = [rng.sample(license_scan.TEXTS, len(license_scan.TEXTS)) for _ in range(3)]
    rows = [(k, "\n\n".join(t.text for t in order), "s") for k, order in enumerate(orders)]
    rows += [(100 + k, " filler words between them ".join([t.text] * 2), "s") for k, t in enumerate(license_scan.TEXTS)]
    rows += [(200 + k, "lorem ipsum dolor " * 3000 + t.text + " sit amet" * 3000, "s") for k, t in enumerate(license_scan.TEXTS)]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert all(every <= got[k] for k in range(3))
    assert all(t.label in got[100 + k] and t.label in got[200 + k] for k, t in enumerate(license_scan.TEXTS))


def test_pairs_near_the_limit_are_decided_by_their_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for k in range(60):
        base = [word() for _ in range(700)]
        other = list(base)
        for at in rng.sample(range(20, 680, 6), rng.choice([10, 13, 15, 16, 17, 18, 20, 25])):
            other[at] = word()  # each changes five shingles
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(other), "s")]
        a, b = (set(simhash.shingle_set(" ".join(x)).tolist()) for x in (base, other))
        want[k] = len(a & b) / len(a | b)
    classes = {r.doc_id: r.component_id for r in simhash.similar_classes(docs_of(spark, rows)).collect()}
    joined = {k for k in want if classes[2 * k] == classes[2 * k + 1]}
    alike = {k for k, v in want.items() if v >= simhash.SIMILAR}
    assert joined <= alike  # none is joined below the limit
    assert len(joined) >= 0.9 * len(alike) and any(0.75 < v < 0.8 for v in want.values()) and any(0.8 <= v < 0.85 for v in want.values())
    assert simhash.exact_similarity(b"", b"") == 0 and simhash.exact_similarity(simhash.shingle_set("a b c d e f").tobytes(), simhash.shingle_set("a b c d e f g").tobytes()) == 2 / 3


def test_no_similar_pair_is_left_out(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    template = [word() for _ in range(150)]
    for _ in range(60):  # twins of one template, which is no link by itself: over 32 texts at one anchor
        own = template[:110] + [word() for _ in range(40)]
        texts += [own, [*own[:-3], word(), *own[-2:]]]
    for size in (6, 12, 20, 30, 60):  # word fingerprints of short texts and of long runs differ in many bits
        for _ in range(30):
            base = [word() for _ in range(size)]
            texts += [base, [*base, *(word() for _ in range(size // 5))]]
    texts = {k: " ".join(t) for k, t in enumerate(texts)}
    sets = {k: set(simhash.shingle_set(t).tolist()) for k, t in texts.items()}
    name = {k: k for k in sets}
    for b in sets:
        for a in range(b):
            if len(sets[a] & sets[b]) >= simhash.SIMILAR * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {k: low if v == high else v for k, v in name.items()}
    docs = docs_of(spark, [(k, t, "s") for k, t in texts.items()])
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()} == name
    monkeypatch.setattr(simhash, "ORDER_TEXTS", 100)
    assert {r.doc_id: r.component_id for r in simhash.similar_classes(docs, crowded=10).collect()} == name
