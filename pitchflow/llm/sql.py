"""DuckDB SQL for the queries of this folder."""

from .license_scan import AGREE, BASE, RARE, SLACK, STRETCH, TEMPLATES, TEXTS, phrase_list, postings_of

FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + FOLD.format("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, sha256({FOLD.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_PHRASES = phrase_list(TEMPLATES)
_KEYS = _values((p, w, k, len(phrase.split())) for p, phrase in enumerate(_PHRASES) for k, w in enumerate(phrase.split()))
_BASE = _values((_PHRASES.index(p), label) for label, p in BASE.items())
_PARTS = _values((t, template.label, k, _PHRASES.index(p), rel, len(p.split())) for t, template in enumerate(TEMPLATES) for k, (p, rel) in enumerate(template.phrases))
_POST = _values((t, w, p) for w, posts in postings_of().items() for t, p in posts)
_MUST = _values((t, text.label, k, _PHRASES.index(p), text.place(p)) for t, text in enumerate(TEXTS) for k, p in enumerate(text.mandatory))

OP2 = f"""
WITH post(t, word, p) AS (VALUES {_POST}),
must(t, label, k, p, rel) AS (VALUES {_MUST}),
keys(p, word, off, len) AS (VALUES {_KEYS}),
base(p, label) AS (VALUES {_BASE}),
parts(t, label, k, p, rel, len) AS (VALUES {_PARTS}),
d AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
found AS (SELECT doc_id, p, pos - off AS pos FROM w JOIN keys USING (word) GROUP BY doc_id, p, pos - off HAVING count(*) = max(len)),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM found JOIN base USING (p) GROUP BY doc_id),
placed AS (SELECT f.doc_id, x.t, x.label, f.pos - x.rel AS start, count(*) AS n FROM found f JOIN parts x USING (p) GROUP BY ALL),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE word IN (SELECT word FROM post) GROUP BY word),
rare AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, word FROM (SELECT DISTINCT doc_id, pos // {STRETCH} AS k, word, df FROM w JOIN df USING (word))
      QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY df, word) <= {RARE})),
votes AS (SELECT doc_id, t, pos - post.p AS start, count(*) AS votes FROM w JOIN rare USING (doc_id, word) JOIN post USING (word) GROUP BY ALL HAVING count(*) >= {AGREE}),
total AS (SELECT doc_id, t, count(*) AS total FROM rare JOIN post USING (word) GROUP BY ALL),
verified AS (SELECT votes.doc_id, label, start, votes / total AS share FROM votes JOIN total USING (doc_id, t) JOIN must USING (t)
      JOIN found f ON f.doc_id = votes.doc_id AND f.p = must.p AND abs(f.pos - start - rel) <= {SLACK}
      JOIN (SELECT t, count(*) AS all_k FROM must GROUP BY t) USING (t) GROUP BY ALL HAVING count(DISTINCT k) = max(all_k)),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM placed
      JOIN (SELECT t, count(*) AS all_n FROM parts GROUP BY t) USING (t) WHERE n = all_n UNION ALL SELECT doc_id, label FROM verified) GROUP BY doc_id),
s AS (SELECT doc_id, max(score) AS score FROM (SELECT doc_id, share AS score FROM verified UNION ALL SELECT doc_id, max(have / total) FROM (
        SELECT doc_id, t, sum(len)::DOUBLE AS have FROM (SELECT DISTINCT doc_id, t, k, x.len FROM found JOIN parts x USING (p)) GROUP BY doc_id, t)
      JOIN (SELECT t, sum(len) AS total FROM parts GROUP BY t) USING (t) GROUP BY doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP10 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS words FROM benchmark),
win AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(list_slice(words, k, k + 9), ' ') AS gram
        FROM (SELECT item, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS k FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
g AS (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(words) >= n),
m AS (SELECT g.doc_id, g.k, g.n, win.item FROM g JOIN win ON g.n = win.n AND array_to_string(list_slice(g.words, g.k, g.k + g.n - 1), ' ') = win.gram),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_WORDS_IN = "len(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, text, lines, unnest(generate_series(1, len(lines))) AS i FROM d),
s AS (SELECT *, len(lines) AS m FROM p),
w AS (SELECT doc_id, text, i, least(3, m) AS n, lines[i : i + least(3, m) - 1] AS ls FROM s WHERE i <= m - least(3, m) + 1
      UNION ALL SELECT doc_id, text, i, 1, [lines[i]] FROM s WHERE m > 1 AND {_WORDS_IN.format("lines[i]")} >= 50
      UNION ALL SELECT doc_id, text, i, 2, lines[i : i + 1] FROM s WHERE m > 2 AND i < m
                AND {_WORDS_IN.format("lines[i]")} + {_WORDS_IN.format("lines[i + 1]")} >= 50),
k AS (SELECT doc_id, text, i, n, array_to_string(list_transform(ls, lambda l: trim(l)), chr(10)) AS key FROM w
      WHERE list_sum(list_transform(ls, lambda l: {_WORDS_IN.format("l")})) > 0),
o AS (SELECT *, first_value(doc_id) OVER a AS fd, first_value(i) OVER a AS fi FROM k WINDOW a AS (PARTITION BY n, key ORDER BY doc_id, i)),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(CASE WHEN fd = doc_id THEN greatest(i, fi + n) ELSE i END, i + n - 1)) AS line
      FROM o WHERE fd <> doc_id OR fi <> i),
g AS (SELECT s.doc_id, any_value(m) AS n_lines, count(c.line) AS n_removed,
             coalesce(string_agg(lines[s.i], chr(10) ORDER BY s.i) FILTER (WHERE c.line IS NULL), '') AS kept
      FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND s.i = c.line GROUP BY s.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(kept) AS text_sha256 FROM g
"""


def _chat_escape(column: str) -> str:
    from .chat import CONTROL

    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def op7() -> str:
    from .chat import END, SEP, START

    marks = len(START) + len(SEP) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_chat_escape("role")}) + length({_chat_escape("text")}) + {marks})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

#: crc32 bit by bit; prefixes are named by the digests of their turns, one after the other.
OP11 = """
WITH RECURSIVE c AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok) - 1 AS pos, tok, size
    FROM (SELECT conv_id, turn, coalesce(length(text), 0) AS size,
                 sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS tok
          FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (
    SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM c
    UNION ALL
    SELECT conv_id, s, k + 1, xor(w >> 1, (w & 1) * 3988292384)
    FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, ascii(s[k // 8 + 1])) ELSE v END AS w FROM bits) WHERE k < 8 * length(s)),
hs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM bits WHERE k = 8 * length(s)),
turns AS (
    SELECT hs.conv_id, 0 AS own, c.pos, c.tok, c.size FROM hs JOIN c ON c.conv_id = hs.base AND c.pos < hs.h
    UNION ALL SELECT hs.conv_id, 1, c.pos, c.tok, c.size FROM hs JOIN c ON c.conv_id = hs.conv_id AND c.pos >= hs.h),
steps AS (SELECT conv_id, size, row_number() OVER w AS depth, sha256(string_agg(tok, '') OVER w) AS node
          FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT hs.conv_id, coalesce(max(depth), 0) AS total FROM hs LEFT JOIN steps USING (conv_id) GROUP BY hs.conv_id),
p AS (SELECT conv_id, depth, node, size FROM steps UNION ALL SELECT conv_id, 0, 'root', 0 FROM hs),
n AS (SELECT node, depth, min(p.conv_id) AS first, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
             sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
      FROM p JOIN ends USING (conv_id) GROUP BY node, depth),
up AS (SELECT n.node, n.depth, a.node AS above, a.depth AS above_depth FROM n JOIN p AS a ON a.conv_id = n.first AND a.depth <= n.depth),
kids AS (SELECT above AS node, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY above),
sums AS (SELECT up.above AS node, count(*) FILTER (WHERE kids.node IS NULL) AS n_leaves, sum(n.saved) AS saved
         FROM up JOIN n ON n.node = up.node LEFT JOIN kids ON kids.node = up.node GROUP BY up.above)
SELECT n.first::BIGINT AS conv_id, n.depth::BIGINT AS depth, above.first::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN kids USING (node)
LEFT JOIN up ON up.node = n.node AND up.above_depth = n.depth - 1 LEFT JOIN n AS above ON above.node = up.above
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, terms FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
al AS (SELECT count(*) AS n_all, sum(len(terms))::BIGINT AS l_all FROM d),
m AS (SELECT r, doc_id, 50 + (50 * len(terms) * n_all) // l_all AS m FROM d, al),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, al GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
      FROM s JOIN m USING (r) WHERE score > 0)
WHERE rank <= 50
"""

#: Reads the markup of the given pages, whose articles are all in <article>; the operator judges by density.
OP13 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
          regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
