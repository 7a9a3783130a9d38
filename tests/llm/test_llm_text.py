"""Exact dedup, licence scan, decontamination and SimHash on small rows with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pitchflow.llm import decontaminate, exact_dedup, license_scan, simhash

DOCS = "doc_id bigint, text string, lang string, count bigint"


def docs_of(spark, texts):
    rows = [(i, t, "en", 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark):
    df = docs_of(spark, [(1, "A b"), (2, "a B"), (3, "Ä"), (4, "ä"), (5, None), (6, ""), (7, "x"), (7, "x"), (None, "x")])
    out = exact_dedup.decisions(df).collect()
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in out)
    assert got == [(-1, 7, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 3, True), (7, 7, 3, True)]
    assert {r.text_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(b"a b").hexdigest()}
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7]
    assert exact_dedup.decisions(df.limit(0)).count() == 0


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "digest_test")
    index.add(exact_dedup.digests(docs_of(spark, [(1, "one"), (2, "two"), (3, "ONE")])))
    again = exact_dedup.DigestIndex(spark, "digest_test")
    again.add(exact_dedup.digests(docs_of(spark, [(9, "two"), (10, "three")])))
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 3, 10]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.decisions(docs_of(spark, [(20, "Two"), (21, "four")]), again).collect()) == [(20, 2, False), (21, 21, True)]


def test_digests_that_were_appended_twice_count_once(spark):
    # a job that is run again after its driver was lost between the write and the commit appends once more
    index = exact_dedup.DigestIndex(spark, "digest_twice")
    rows = spark.createDataFrame([(exact_dedup.digests(docs_of(spark, [(1, "one")])).first().digest, 1, 1)], exact_dedup.INDEX_SCHEMA)
    index._append(rows, "append")
    index._append(rows, "append")
    assert exact_dedup.decisions(docs_of(spark, [(2, "One"), (3, "two" * 100_000)]).withColumnRenamed("count", "kept"), index).count() == 2
    assert "Exchange" not in index.rows()._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_hot_digest_is_joined_whole(spark):
    df = docs_of(spark, [(i, "same") for i in range(3000)] + [(i, str(i)) for i in range(3000, 6000)])
    out = exact_dedup.decisions(df)
    assert out.count() == 6000 and out.where("kept").count() == 3001 and out.where("group_size = 3000").count() == 3000


def test_license_scan(spark):
    long = "word " * 40_000 + "Under the MIT License"
    df = docs_of(
        spark,
        [
            (1, "Released under the MIT-License. UNDER the mit license!"),
            (2, "Apache License, Version 2.0"),
            (3, "licence apache version 2"),
            (4, None),
            (5, ""),
            (6, long),
            (7, "CC BY-NC 4.0, GNU General Public License, version 3"),
            (8, "GNU General Public License and version 3"),
            (9, "under the mit under the mit license"),
        ],
    )
    got = by_id(license_scan.scan(df))
    short = lambda i: (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels, round(got[i].score, 3))
    assert short(1) == (2, 1, 5, "mit", "mit", 1)
    assert short(2) == (1, 0, 0, "apache-2", "apache-2", 1)
    assert short(3)[:4] == (0, None, None, "")
    assert short(4) == short(5) == (0, None, None, "", "", 0) and got[5].n_words == 0
    assert short(6) == (1, 40_000, 40_000, "mit", "mit", 1)
    assert short(7) == (1, 0, 0, "cc-by-nc", "cc-by-nc,gpl-3", 1)
    assert short(8) == (0, None, None, "", "", 1)  # both phrases stand, but not at their places
    assert short(9)[:3] == (1, 3, 3)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_texts(spark):
    texts, long = {t.label: t.text for t in license_scan.TEXTS}, "plain words of another kind stand here "
    wrapped = lambda t: long * 30 + "Copyright 2020 Someone\n# " + t.replace("\n", "\n# ") + "\n" + long * 900
    rows = [(k, wrapped(t.text)) for k, t in enumerate(license_scan.TEXTS)]
    cut = texts["mit"].split("THE SOFTWARE IS")[0]  # without the disclaimer
    mixed = " ".join(sorted(texts["mit"].split()))  # all its words, at other places
    rows += [(50, cut), (51, mixed), (52, texts["mit"] + long + texts["zlib"]), (52, texts["mit"] + long + texts["zlib"]), (53, texts["isc"].replace("hereby", "now and hereby"))]
    rows += [(100 + k, long) for k in range(20)]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows).withColumnRenamed("count", "n_words")).collect()}
    for k, t in enumerate(license_scan.TEXTS):
        assert t.label in got[k].labels.split(",") and got[k].score == 1, t.label
    labels = lambda k: got[k].labels.split(",")
    assert not {"bsd-2"} & set(labels(3)) and "bsd-3" not in labels(2) and "gpl-3" not in labels(4) and "gpl-2" not in labels(5)
    assert labels(50) == ["mit"] and got[50].n_base == 0  # the short phrases alone name it
    assert got[51].labels == "" and labels(52) == ["mit", "zlib"] and "isc" in labels(53)
    assert all(got[100 + k].labels == "" and got[100 + k].score < 1 for k in range(20))
    assert sum(r.doc_id == 52 for r in license_scan.scan(docs_of(spark, rows)).collect()) == 2


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for k in range(max(0, len(x) - 9) + (0 < len(x) < 10) if len(x) < 10 else len(x) - 9):
            g = x[k : k + 10]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("max_patterns", [2_000_000, 1])
def test_decontaminate(spark, max_patterns):
    rng = random.Random(5)
    vocab = ["ab", "cd", "É", "x1", "the"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 14])))) for k in range(6)] + [(90, None), (91, "..."), (5, "the the the cd")]
    texts = [(k, ", ".join(rng.choices(vocab, k=rng.randrange(0, 60)))) for k in range(40)]
    texts += [(50, "--- " + items[3][1].upper().replace("É", "É") + "!"), (51, None), (52, ""), (53, items[4][1] + " ab" * 30_000)]
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.report(df, bench, max_patterns))
    for i, t in texts:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(t, items), i
    clean = {r.doc_id for r in decontaminate.clean(df, bench, max_patterns).collect()}
    assert clean == {i for i, _ in texts if not got[i].contaminated} and clean
    assert decontaminate.report(df.limit(0), bench).count() == 0
    assert decontaminate.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id_are_searched_for(spark):
    df = docs_of(spark, [(1, "one two three four"), (2, "five six seven"), (3, "five six"), (3, "five six")]).withColumnRenamed("count", "n_hit")
    bench = spark.createDataFrame([(None, "two three"), (None, None), (7, "five six")], "item_id bigint, text string")
    for most in (2_000_000, 1):
        out = decontaminate.report(df, bench, most).collect()
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in out}
        assert len(out) == 4 and got == {1: (2, 0, True), 2: (2, 1, True), 3: (2, 1, True)}
        assert {r.items_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
        assert decontaminate.clean(df, bench, most).count() == 0


def test_decontaminate_offsets(spark):
    df = docs_of(spark, [(1, "Ünlike - Über, the END... no")])
    bench = spark.createDataFrame([(1, "über the end")], "item_id bigint, text string")
    row = decontaminate.report(df, bench).first()
    assert not row.contaminated  # only A-Z is lower-cased
    bench = spark.createDataFrame([(1, "Über the end")], "item_id bigint, text string")
    (span,) = decontaminate.report(df, bench).first().char_spans
    assert "Ünlike - Über, the END... no"[span.first : span.last].startswith("Über, the END")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    s = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    name = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and name[a] > name[b]:
                    name[a], changed = name[b], True
    return name


def test_golay_covers():
    begin, patterns, _ = simhash._cover()
    for s in range(2**11):
        assert min(int(p).bit_count() for p in patterns[begin[s] : begin[s + 1]]) <= 3


def test_simhash_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for g in range(12):
        base = rng.choices(words, k=300)
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = "New"
            texts.append(" ".join(t))
    texts += [None, "", "  \n", "one two", "one two", "a b c\x1cd é f g", "z " * 30_000]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    for crowded in (simhash.CROWDED, 2):
        got = by_id(simhash.near_duplicates(docs_of(spark, rows), crowded))
        prints = {i: brute_fingerprint(t) for i, t in rows}
        assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
        assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def brute_similar(texts):
    """component by doc_id: Jaccard of five-word shingles of 0.8 or more, by all pairs."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in texts.items()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    alike = {(a, b): not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0 for a in texts for b in texts if a < b}
    name = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for (a, b), yes in alike.items():
            if yes and name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    return name, alike


def test_similar_texts_by_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    texts, n = {}, 0
    for size in (12, 40, 90, 110, 300):  # up to 128 shingles the similarity is exact
        for _ in range(6):
            base = rng.choices(words, k=size)
            for edits in (0, 0, 1, 1, 2, 3):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(len(t))] = "New"
                texts[n] = " ".join(t)
                n += 1
    texts |= {900: None, 901: "", 902: " \n", 903: "one two", 904: "one  two", 905: "one two three", 906: "z " * 30_000}
    want, alike = brute_similar(texts)
    for crowded in (simhash.CROWDED, 3):
        got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs_of(spark, texts.items()), crowded=crowded).collect()}
        linked = [p for p, yes in alike.items() if yes]
        recall = sum(got[a] == got[b] for a, b in linked) / len(linked)
        wrong = [i for i in got if want[i] != want[got[i]] and len(texts[i].split()) <= 128]
        assert recall >= 0.95 and not wrong and got[900] == got[901] == got[902] == 900 and got[903] == got[904] != got[905]
    rows = [*texts.items(), (0, texts[0]), (900, None)]
    kept = simhash.keep_one(docs_of(spark, rows).withColumnRenamed("count", "component_id"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.keep_one(docs_of(spark, rows).limit(0)).count() == 0


def test_similarity_of_sketches():
    long = [f"w{k}" for k in range(2000)]
    sketch = lambda w: simhash.similar_prints(" ".join(w))[3]
    assert simhash.similarity(sketch(long), sketch(long)) == 1.0 and simhash.similarity(sketch(long), sketch(long[::-1])) == 0.0
    assert abs(simhash.similarity(sketch(long), sketch(long[:1000])) - 996 / 1996) < 0.12 and simhash.similarity(b"", b"") == 1.0
    assert simhash.similarity(sketch(long[:60]), sketch(long[:54])) == 50 / 56


def test_keepers_without_ids_and_with_repeated_ids(spark):
    a, b, c = ("red fox runs far away", "seven ships sail past the old harbour wall", "nothing else here matches at all tonight")
    df = docs_of(spark, [(5, a), (5, b), (5, b), (3, a), (None, c), (None, c), (None, a), (None, a + " but never twice in one row")])
    want = sorted([(3, a), (5, b), (-1, c), (-1, a + " but never twice in one row")])
    for keep in (simhash.keep_one, exact_dedup.deduplicate):
        kept = keep(df)
        assert kept.columns == df.columns
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect())
        # Exact dedup keeps the largest doc_id of a text, SimHash the smallest.
        assert got == (want if keep is simhash.keep_one else sorted([(5, a), *[w for w in want if w[0] != 3]]))


def test_near_pairs_planted_distances(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = {}
    for k, b in enumerate(base):
        prints[3 * k] = int(b)
        for j, n in ((1, 4), (2, 5)):
            x = int(b)
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            prints[3 * k + j] = x
    signed = {i: p - 2**64 if p >= 2**63 else p for i, p in prints.items()}
    fps = spark.createDataFrame([(p,) for p in set(signed.values())], "fp bigint")
    for crowded in (simhash.CROWDED, 1):
        linked = {frozenset(r) for r in simhash.near_pairs(fps, crowded).collect()}
        want = {frozenset((signed[a], signed[b])) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4}
        assert linked == want


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}
