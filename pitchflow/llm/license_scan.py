r"""Licence scans by a positional index of rare words.

Two kinds of templates. Phrases: a licence is named by key phrases at their places relative to the first one. Texts:
the words of whole licences and notices (license_texts), with mandatory key phrases. The words of five letters or
more of the texts are the index words; an index word's postings are (template, place in the template).

A first scan of all documents counts in how many each licence word stands. A second one notes, of each file, where
the words of phrases stand and where its rare words do: of each stretch of `STRETCH` words the `RARE` index words of
the highest IDF. A file of several licences, one after the other, so has rare words of each. Every such word in a file gives,
by each of its postings, the place where the template would begin; where at least `AGREE` of them agree on one
beginning, the mandatory phrases are verified: each has to stand at its own place from there, `SLACK` words off at
most. A phrase is found likewise from its word of the highest IDF: all its words at their relative places.

Nulls, ties and edges: a null text is empty; a text without words has no labels, score 0 and null first_word and
last_word. Equal document frequencies fall to the smaller word. Phrases may overlap or repeat, each place counts.
A very long text gives one row of places of licence words. Rows are judged alone, so repeated rows give repeated
results; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import WORD, ascii_lower, written

#: The base labels and their phrases.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


@dataclass(frozen=True)
class Template:
    label: str
    #: (key phrase, place of its first word relative to that of the first key phrase)
    phrases: tuple[tuple[str, int], ...]


TEMPLATES: tuple[Template, ...] = (
    *(Template(label, ((phrase, 0),)) for label, phrase in BASE.items()),
    Template("agpl-3", (("gnu affero general public license", 0),)),
    Template("all-rights-reserved", (("all rights reserved", 0),)),
    Template("bsd", (("redistribution and use in source and binary forms", 0), ("with or without modification", 8))),
    Template("cc-by", (("cc by 4", 0),)),
    Template("cc-by-sa", (("cc by sa", 0),)),
    Template("cc0", (("cc0 1 0 universal", 0),)),
    Template("gpl-2", (("gnu general public license", 0), ("version 2", 4))),
    Template("gpl-3", (("gnu general public license", 0), ("version 3", 4))),
    Template("lgpl", (("gnu lesser general public license", 0),)),
    Template("mit", (("permission is hereby granted free of charge", 0), ("to any person obtaining a copy", 7))),
    Template("mpl-2", (("mozilla public license", 0), ("version 2", 3))),
    Template("public-domain", (("released into the public domain", 0),)),
)


@dataclass(frozen=True)
class Text:
    label: str
    text: str
    #: phrases that have to stand at their places
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    def place(self, phrase: str) -> int:
        p = phrase.split()
        return next(k for k in range(len(self.words)) if self.words[k : k + len(p)] == p)


TEXTS: tuple[Text, ...] = (
    Text("agpl-3", license_texts.AGPL_3, ("gnu affero general public license as published by the free software foundation", "version 3 of the license")),
    Text("apache-2", license_texts.APACHE_2, ("licensed under the apache license version 2", "without warranties or conditions of any kind")),
    Text("bsd-2", license_texts.BSD_2, ("redistribution and use in source and binary forms", "this software is provided by the copyright holders and contributors")),
    Text("bsd-3", license_texts.BSD_3, ("redistribution and use in source and binary forms", "neither the name of", "this software is provided by the copyright holders and contributors")),
    Text("gpl-2", license_texts.GPL_2, ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    Text("gpl-3", license_texts.GPL_3, ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    Text("isc", license_texts.ISC, ("permission to use copy modify and or distribute this software", "the author disclaims all warranties")),
    Text("lgpl-3", license_texts.LGPL_3, ("gnu lesser general public license as published by the free software foundation", "version 3 of the license")),
    Text("mit", license_texts.MIT, ("permission is hereby granted free of charge", "the software is provided as is")),
    Text("mpl-2", license_texts.MPL_2, ("subject to the terms of the mozilla public license",)),
    Text("unlicense", license_texts.UNLICENSE, ("this is free and unencumbered software", "dedicate any and all copyright interest")),
    Text("zlib", license_texts.ZLIB, ("without any express or implied warranty", "altered source versions must be plainly marked as such")),
)

#: RARE words are taken from each STRETCH of words, so that no licence of a file spends the words of another one.
RARE, STRETCH, AGREE, SLACK = 16, 64, 5, 8


def phrase_list(templates: tuple[Template, ...], texts: tuple[Text, ...] = TEXTS) -> list[str]:
    return sorted({p for t in templates for p, _ in t.phrases} | {p for t in texts for p in t.mandatory})


def phrase_words(templates: tuple[Template, ...], texts: tuple[Text, ...] = TEXTS) -> list[str]:
    return sorted({w for p in phrase_list(templates, texts) for w in p.split()})


def postings_of(texts: tuple[Text, ...] = TEXTS) -> dict[str, list[tuple[int, int]]]:
    """index word -> (number of the text, place in it)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, text in enumerate(texts):
        for place, w in enumerate(text.words):
            if len(w) >= 5:
                out.setdefault(w, []).append((t, place))
    return out


def _strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    pattern = WORD.replace("\\", "\\\\")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("t")
    ).select("doc_id", F.expr(f"regexp_extract_all(t, '{pattern}', 0)").alias("words"))


def document_frequencies(words: DataFrame, known: list[str]) -> dict[str, int]:
    """In how many documents each known word stands, over all documents. At most one row for each known word."""
    rows = words.select(F.explode(F.expr(f"array_intersect(array({_strings(known)}), words)")).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


def word_places(words: DataFrame, in_phrases: list[str], by_idf: list[str]) -> DataFrame:
    """doc_id, n_words, rare: the index words of the highest IDF of the document's stretches, hits: the places of those words and of
    the words of phrases as (pos, word), in order."""
    none = "cast(array() as array<string>)"
    if not by_idf:
        chosen = words.withColumn("rare", F.expr(none))
    else:
        ranked = f"named_struct('k', cast(i div {STRETCH} as int), 'r', array_position(array({_strings(by_idf)}), w), 'w', w)"
        index = f"filter(transform(words, (w, i) -> if(w in ({_strings(by_idf)}), {ranked}, null)), x -> x is not null)"
        # Sorted by stretch and rank; a word is one of the RARE first of its stretch if the one RARE places before it is of another stretch.
        first = f"filter(ranked, (x, i) -> i < {RARE} or get(ranked, i - {RARE}).k <> x.k)"
        chosen = words.withColumn("index", F.expr(index)).withColumn("ranked", F.expr("array_sort(array_distinct(index))"))
        chosen = chosen.withColumn("rare", F.expr(f"if(size(index) < {AGREE}, {none}, array_distinct(transform({first}, x -> x.w)))"))
    index = f"w in ({_strings(by_idf)}) and array_contains(rare, w)" if by_idf else "false"
    hits = f"filter(transform(words, (w, i) -> if(w in ({_strings(in_phrases)}) or ({index}), named_struct('pos', i, 'word', w), null)), h -> h is not null)"
    return chosen.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "rare", F.expr(hits).alias("hits"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", texts: tuple[Text, ...] = TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: (phrase, first, last) word positions of every key phrase found. score: the largest share of a template: of
    its key words, that lie in phrases found in the document, or of a verified text's postings of the document's rare
    words, that agree on its place; 1 for a full template.
    """
    words = _words(docs, id_col, text_col)
    posts = postings_of(texts)
    in_phrases = phrase_words(templates, texts)
    df = document_frequencies(words, sorted({*in_phrases, *posts}))
    by_idf = sorted(posts, key=lambda w: (df.get(w, 0), w))
    places = written(word_places(words, in_phrases, by_idf), "licence-words")
    phrases = phrase_list(templates, texts)
    postings: dict[str, list[tuple[int, int]]] = {}
    for p, phrase in enumerate(phrases):
        words = phrase.split()
        anchor = min(words, key=lambda w: (df.get(w, 0), w))  # the highest IDF
        postings.setdefault(anchor, []).append((p, words.index(anchor)))
    anchors = sorted(postings)
    posting_sql = "array(" + ", ".join("array(" + ", ".join(f"named_struct('p', {p}, 'off', {o})" for p, o in postings[w]) + ")" for w in anchors) + ")"
    phrase_sql = "array(" + ", ".join(f"array({_strings(p.split())})" for p in phrases) + ")"

    at_anchor = f"filter(transform(hits, (h, j) -> if(h.word in ({_strings(anchors)}), named_struct('j', j, 'word', h.word), null)), a -> a is not null)"
    starts = f"flatten(transform(anchors, a -> transform(element_at({posting_sql}, cast(array_position(array({_strings(anchors)}), a.word) as int)), q -> named_struct('p', q.p, 'j', a.j - q.off))))"
    # All words of a phrase are licence words, so a phrase that is there takes consecutive hits at consecutive places.
    stands = "filter(starts, s -> s.j >= 0 and forall(transform(element_at({0}, s.p + 1), (w, m) -> coalesce(get(hits, s.j + m).word = w and get(hits, s.j + m).pos = get(hits, s.j).pos + m, false)), x -> x))".format(phrase_sql)
    found = f"transform(stands, s -> named_struct('p', s.p, 'pos', get(hits, s.j).pos, 'len', size(element_at({phrase_sql}, s.p + 1))))"

    def have(t: Template) -> str:
        first, rest = t.phrases[0], t.phrases[1:]
        more = "".join(f" and exists(found, y -> y.p = {phrases.index(p)} and y.pos = x.pos + {rel})" for p, rel in rest)
        return f"exists(found, x -> x.p = {phrases.index(first[0])}{more})"

    def share(t: Template) -> str:
        total = sum(len(p.split()) for p, _ in t.phrases)
        parts = " + ".join(f"if(exists(found, x -> x.p = {phrases.index(p)}), {len(p.split())}, 0)" for p, _ in t.phrases)
        return f"({parts}) / {total}D"

    post_sql = "array(" + ", ".join("array(" + ", ".join(f"named_struct('t', {t}, 'p', {p})" for t, p in posts[w]) + ")" for w in by_idf) + ")"
    posts_of = f"element_at({post_sql}, cast(array_position(array({_strings(by_idf)}), {{0}}) as int))"
    # A beginning as one number, which sorts by text and place; a text of which only the end is there begins before 0.
    beginning = "q.t * 1000000000000L + h.pos - q.p + 1000000L"
    begins = f"if(size(rare) = 0, cast(array() as array<bigint>), array_sort(flatten(transform(filter(hits, h -> array_contains(rare, h.word)), h -> transform({posts_of.format('h.word')}, q -> {beginning})))))"
    agreed = f"filter(begins, (x, i) -> get(begins, i + {AGREE - 1}) = x and not (coalesce(get(begins, i - 1), -1L) = x))"
    candidates = "transform(agreed, x -> named_struct('t', cast(x div 1000000000000L as int), 'at', x % 1000000000000L - 1000000L, 'votes', size(filter(begins, y -> y = x))))"
    of_rare = f"if(size(agreed) = 0, cast(array() as array<struct<t:int,p:int>>), flatten(transform(rare, w -> {posts_of.format('w')})))"

    def stands_at(k: int, text: Text) -> str:
        must = "".join(f" and exists(found, y -> y.p = {phrases.index(p)} and abs(y.pos - x.at - {text.place(p)}) <= {SLACK})" for p in text.mandatory)
        return f"x.t = {k}{must}"

    verified = "filter(candidates, x -> " + (" or ".join(f"({stands_at(k, t)})" for k, t in enumerate(texts)) or "false") + ")"
    named = f"element_at(array({_strings([t.label for t in texts] or [''])}), x.t + 1)"
    matched = "transform(verified, x -> x.votes / size(filter(of_rare, q -> q.t = x.t)))"

    base = ", ".join(str(phrases.index(p)) for p in BASE.values())
    base_labels = ", ".join(f"if(exists(found, x -> x.p = {phrases.index(p)}), '{label}', null)" for label, p in BASE.items())
    labels = ", ".join(f"if({have(t)}, '{t.label}', null)" for t in templates)
    joined = "array_join(array_sort(array_distinct(filter({0}, x -> x is not null))), ',')"
    out = places.withColumn("anchors", F.expr(at_anchor)).withColumn("starts", F.expr(starts)).withColumn("stands", F.expr(stands)).withColumn("found", F.expr(found))
    if texts:
        out = out.withColumn("begins", F.expr(begins)).withColumn("agreed", F.expr(agreed)).withColumn("candidates", F.expr(candidates)).withColumn("of_rare", F.expr(of_rare)).withColumn("verified", F.expr(verified))
    else:
        out = out.withColumn("verified", F.expr("cast(array() as array<struct<t:int,at:bigint,votes:int>>)")).withColumn("of_rare", F.expr("cast(array() as array<struct<t:int,p:int>>)"))
    return out.withColumn("base", F.expr(f"filter(found, x -> x.p in ({base}))")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.expr("cast(array_min(transform(base, x -> x.pos)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(base, x -> x.pos)) as bigint)").alias("last_word"),
        F.expr(joined.format(f"array({base_labels})")).alias("base_labels"),
        F.expr(joined.format(f"concat(array({labels}), transform(verified, x -> {named}))")).alias("labels"),
        F.expr(f"cast(greatest({', '.join(share(t) for t in templates)}, coalesce(array_max({matched}), 0D)) as double)").alias("score"),
        F.expr(f"transform(found, x -> named_struct('phrase', element_at(array({_strings(phrases)}), x.p + 1), 'first', x.pos, 'last', x.pos + x.len - 1))").alias("spans"),
    )
