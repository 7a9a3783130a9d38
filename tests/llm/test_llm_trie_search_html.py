"""The prefix trie, the ranked search and the text of pages against brute force on small rows with hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pitchflow.llm import html_text, lexical, prefix_trie

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, parent string, depth int"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(rows, shared):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
            turns[c].append((t is not None, t or 0, digest, (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        whole[c] = tuple(turns.get(c - c % 100, [])[:h]) + tuple(own[h:])
    members, below, totals = defaultdict(list), defaultdict(list), {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            below[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * len(s[-1][1]) if s else 0
        totals[s] = (sum(totals[k][0] for k in below[s]) or 1, sum(totals[k][1] for k in below[s]) + own)
    out = set()
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(s))))
        out.add((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(below[s]), *totals[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(30), *range(100, 125), *range(205, 215), 1234]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 40 if c % 7 == 0 else 3])):
            turn = t if rng.random() < 0.95 else rng.choice([None, 2])
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"]) if t > 1 else "hi", "x", 1))
        if rows and rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(7000 + i, t, "user", f"t{t}", "x", 1) for i in range(20) for t in range(i % 5 * 9)]
    rng.shuffle(rows)
    return [*rows, (None, 1, "user", "x", "x", 1)]


@pytest.mark.parametrize(("base", "shared"), [(1, True), (3, False), (16, True)])
def test_trie_equals_brute_force(spark, base, shared, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = conversations(base)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(3), shared, base).collect()
    want = brute_trie(rows, shared)
    assert len(got) == len(want) and {tuple(r[c] for c in NODE) for r in got} == want


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS), True).count() == 0


def test_trie_of_one_hot_conversation_and_many_copies(spark):
    long = [(5, t, "user", "same" if t % 2 else f"t{t}", "x", 1) for t in range(700)]
    copies = [(1000 + c, t, "user", f"t{t}" if t == 0 else "same", "x", 1) for c in range(300) for t in range(2)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(long + copies, CONVERSATIONS).repartition(5), False, 4).collect()
    assert {tuple(r[c] for c in NODE) for r in got} == brute_trie(long + copies, False)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top):
    found = [(i, Counter(terms_of(t))) for i, t in docs]
    n_all, l_all = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df, asked, out = Counter(t for _, c in found for t in c), {}, set()
    for i, t in items:
        if t is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    for i, terms in asked.items():
        scores = []
        for doc, c in found:
            if c:
                m = 50 + 50 * sum(c.values()) * n_all // l_all
                s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
                scores += [(-s, doc is not None, doc or 0, doc)] if s else []
        out |= {(i, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])}
    return out


@pytest.mark.parametrize("small", [True, False])
def test_search_equals_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "STRETCH", 1 << 10)
    if small:
        for name, n in (("PIECE", 16), ("POSTINGS", 60), ("FIRST", 1), ("ITEMS", 5)):
            monkeypatch.setattr(lexical, name, n)
    rng = random.Random(small)
    words = [f"w{k}" for k in range(60)] + ["É", "über", "Zoo"]
    docs = [(k if k != 17 else None, " ".join(rng.choice(words[: 1 + rng.randrange(63)]) for _ in range(rng.choice([0, 3, 3, 10, 50, 300])))) for k in range(250)]
    docs += [(1000 + k, "w1 w2 w3. same-copy w5") for k in range(80)]
    docs += [(900, None), (901, ""), (902, "!!! --"), (5, "w1 w7"), (5, "w1 w7"), (903, "Zoo " * 100_000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20])))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "absent words"), (3, "w1 same"), (None, "w2")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, m int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    for index in (None, lexical.build_index(d)):
        got = [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(d, q, 10, index).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_search(docs, items, 10)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def p(k):
    return f"Paragraph {k} of the article has a good number of words, so that it weighs what text weighs, and it ends here."


PAGES = {
    "soup": (
        f"<html><body><div><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div><h1>Title &amp; more</h1><p>{p(1)}</p><p>{p(2)} <b>bold</b>&nbsp;end</p>"
        f"<div>{p(3)}</div></div><div>Copyright 2020</div></div></body></html>",
        ["Title & more", p(1), p(2) + " bold end", p(3)],
    ),
    "classes": (
        "<body class='has-sidebar page'><header><h1>Site</h1><a href=/>x</a></header><div id='cookie-notice'>We use cookies. Accept?</div><div class='menu'><ul><li><a>1</a></ul></div>"
        f"<main><article><header><h1>T</h1><p class=byline>by me</p></header><p>{p(1)}<p>{p(2)}<ul><li>one<li>two</ul><form><input name=q><label>Search</label></form><aside>see also</aside>"
        f"<p>{p(3)}<section class='comments'><h2>Comments</h2><p>{p(9) * 3}</p></section></article></main><div class=sidebar>{p(7)}</div><footer>foot</footer></body>",
        ["T", p(1), p(2), "one", "two", p(3)],
    ),
    "sections": (
        f"<body><div class=wrap><div><section><h2>A</h2><p>{p(1)}</p><p>{p(2)}</p></section><section><h2>B</h2><p>{p(3)}</p><p>{p(4)}</p></section></div></div><div class='ad-box'>Buy</div></body>",
        ["A", p(1), p(2), "B", p(3), p(4)],
    ),
    "comments": (
        f"<body><div id=content><h1>T</h1><p>{p(1)}</p><p>{p(2)}</p></div><div id='comments'><article class='comment'><p>{p(8) * 5}</p></article><article class='comment'><p>{p(8) * 5}</p></article></div></body>",
        ["T", p(1), p(2)],
    ),
    "form": (f"<body><form id=aspnet><div><h1>T</h1><p>{p(1)}</p><input><select><option>a<option>b</select></div></form></body>", ["T", p(1)]),
    "table": (f"<body><article><p>{p(1)}</p><table><tr><td>a<td>b<tr><td>c<td>d</table><pre>x\n  y</pre></article></body>", [p(1), "a", "b", "c", "d", "x y"]),
    "script": (
        f"<body><article><p>a</p><script>if (a<b) document.write('</p><p>x</p>')</script><style>p{{}}</style><p>{p(1)}</p><!-- c --><noscript>no</noscript></article><script>never ends <p>zz",
        ["a", p(1)],
    ),
    "heading": (
        f"<body><div class=top><a href=1>x</a></div><h1>Head</h1><div class=c><p>{p(1)}</p><p>{p(2)}</p></div><div class='related-posts'><a href=1>r1</a><a>r2</a></div></body>",
        ["Head", p(1), p(2)],
    ),
    "links": (
        f"<body><article><h1>T</h1><p>{p(1)}</p><ul><li><a href=1>one thing</a></li><li><a href=2>two thing</a></li><li><a href=3>three thing</a></li></ul></article></body>",
        ["T", p(1)],
    ),
    "quotes": (f"<body><article title=\"a > b\"><p class='x\" y'>{p(1)}</p><a href=\"un><p>{p(2)}</p></article></body>", [p(1), p(2)]),
    "plain": ("just text &lt;b&gt; é", ["just text <b> é"]),
    "signs": ("<p>1 < 2 and 3 > 2 &am</p>", ["1 < 2 and 3 > 2 &am"]),
    "no text": ("<p></p><div>", []),
    "empty": ("", []),
    "null": (None, []),
    "deep": ("<div>" * 20_000 + "x", ["x"]),
    "long": ("<article><p>" + "word " * 400_000 + "<p>end</article>", [("word " * 400_000).strip(), "end"]),
}


def test_pages(spark):
    rows = [(k, name, html, "x", 1) for k, (name, (html, _)) in enumerate(PAGES.items())] + [(0, "soup", PAGES["soup"][0], "x", 1), (None, None, "<p>t", "x", 1)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int").repartition(2)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "\n\n".join(PAGES[r.url][1]) if r.url else "t"
        assert (r.text, r.n_chars) == (want, len(want)), r.url
