"""Licence scan with a positional index of rare tokens, in column expressions only.

Templates are short licence passages, each with a mandatory key phrase. Of each
key phrase the two words with the highest inverse document frequency in the
corpus go into the index, with their positions. A document looks up where it
has these words; a posting at position i of a word that the template has at p
proposes that the template starts at i - p. The proposals of both words are
intersected, so that only places remain where the rare words stand at the right
distance, and there the key phrase is verified word by word. Around it, the
share of template words that stand at their place is the score. In a key phrase
that is part of a sentence, and not a licence's name, a few words (SLACK) may stand
between its own: a posting proposes a start for each number of them, and words
count that far from their place.

Scale: one pass counts documents for the templates' words (a few hundred
counts, whatever the corpus), one pass scans; neither shuffles texts. Only
documents that hold an indexed word pay for the lookups.

Edge cases: null text counts as empty; a document without a match has empty
labels, score 0 and null places; rows are independent, so repeated rows and ids
are each answered; of key words
with the same frequency the first in the phrase is indexed; a very long text is
scanned whole; an empty table gives an empty result; other columns of the input are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that must stand at their places around its key phrase.
LEAST = 0.5
#: Indexed words of each key phrase.
ANCHORS = 2
#: Words that may stand between those of a key phrase that is a sentence's; in a licence's name one word makes another licence.
SLACK = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False
    sentence: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def slack(self) -> int:
        """How many words may stand between those of the key phrase."""
        return SLACK if self.sentence else 0

    @property
    def key_at(self) -> int:
        k = self.key_words
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)


# The base phrases and their labels.
BASE = [Template(label, phrase, phrase, True) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))]

TEMPLATES = BASE + [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "to any person obtaining a copy of this software", sentence=True),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies", sentence=True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "distributed under the license is distributed on an as is basis", sentence=True),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", sentence=True),
    Template("bsd", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software", sentence=True),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked as such", sentence=True),
    Template("bsl-1", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "to any person or organization obtaining a copy of the software", sentence=True),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain", sentence=True),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("artistic-2", "under the terms of the artistic license 2 0", "artistic license 2 0"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute this software", sentence=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("gpl-3", "licensed under the gnu gpl v3", "gnu gpl v3"),
    Template("gpl-2", "licensed under the gnu gpl v2", "gnu gpl v2"),
    Template("mit", "spdx license identifier mit", "spdx license identifier mit"),
    Template("apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    Template("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    Template("gpl-3", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    Template("gpl-2", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    Template("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
]


def words(text: Column) -> Column:
    """Lower-cased words. Lower-casing other letters than A-Z can't change a licence word, except that the
    Kelvin sign would become k; it is put aside first."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def inverse_frequency(docs: DataFrame, templates: list[Template] = TEMPLATES) -> dict[str, float]:
    """Of the templates' words, over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    # One row for each word of the templates at most, and one for the number of documents.
    counted = docs.select(F.explode(F.concat(found, F.array(F.lit(" ")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r.word: r.n for r in counted}
    return {w: math.log((n.get(" ", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def index(idf: dict[str, float], templates: list[Template] = TEMPLATES) -> list[list[tuple[str, int]]]:
    """Of each template its ANCHORS rarest key words, with their positions in the template."""
    out = []
    for t in templates:
        first = {w: t.key_at + i for i, w in reversed(list(enumerate(t.key_words)))}
        out.append(sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[:ANCHORS])
    return out


def _sum_matched(own: Column, t: Template, start: Column) -> Column:
    """Share of the template's words at their places, or as far from them as words may stand between."""
    expected = F.array(*map(F.lit, t.words))
    if t.slack:
        first = lambda j: F.greatest(start + j - t.slack, F.lit(0))
        near = lambda j: F.slice(own, first(j) + 1, F.greatest(start + j + t.slack + 1 - first(j), F.lit(0)))
        hit = lambda w, j: F.array_contains(near(j), w)
    else:
        hit = lambda w, j: F.coalesce(F.get(own, start + j) == w, F.lit(False))
    return F.size(F.filter(expected, hit)) / F.lit(float(len(t.words)))


def _starts(hits: Column, word: str, position: int, slack: int) -> Column:
    """Where the template would start for each place of its word at that position, with up to slack words before it."""
    exact = F.transform(F.filter(hits, lambda x: x["w"] == word), lambda x: x["i"] - position)
    return F.array_distinct(F.flatten(F.transform(exact, lambda s: F.sequence(s - slack, s)))) if slack else exact


def _match(t: Template, places: Column) -> Column:
    good = F.filter(places, lambda x: x["score"] >= LEAST)
    return F.transform(good, lambda x: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), x["at"].alias("word"), x["score"].alias("score")))


def _places(t: Template, anchors: list[tuple[str, int]], hits: Column, own: Column) -> Column:
    """Starts (may be below 0) and scores of the template's verified places."""
    proposals = F.array_intersect(*(_starts(hits, w, p, t.slack) for w, p in anchors)) if len(anchors) > 1 else _starts(hits, *anchors[0], t.slack)
    key, at, n = F.array(*map(F.lit, t.key_words)), t.key_at, len(t.key_words)
    there = lambda s: F.slice(own, F.greatest(s + at, F.lit(0)) + 1, n + t.slack)
    if t.slack:
        # The first word at the start, the others in order behind it, each taken where it comes first.
        in_order = lambda s: F.aggregate(there(s), F.lit(0), lambda done, w: done + F.coalesce(F.get(key, done) == w, F.lit(False)).cast("int"))
        holds = lambda s: (F.get(own, s + at) == t.key_words[0]) & (in_order(s) == n)
    else:
        holds = lambda s: there(s) == key
    verified = F.filter(proposals, lambda s: (s + at >= 0) & holds(s))
    return F.transform(verified, lambda s: F.struct((s + at).alias("at"), _sum_matched(own, t, s).alias("score")))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, word, score)."""
    anchors = index(inverse_frequency(docs, templates), templates)
    indexed = sorted({w for a in anchors for w, _ in a})
    lit = F.array(*map(F.lit, indexed))
    own = docs.select("doc_id", words(F.col("text")).alias("words"))
    at = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    none = F.array().cast("array<struct<w:string,i:int>>")
    hits = F.when(F.size(F.array_intersect("words", lit)) > 1, F.filter(at, lambda x: F.array_contains(lit, x["w"]))).otherwise(none)
    looked = own.select("doc_id", "words", hits.alias("hits"))
    found = [_match(t, _places(t, a, F.col("hits"), F.col("words"))) for t, a in zip(templates, anchors, strict=True)]
    empty = F.array().cast("array<struct<label:string,base:boolean,word:int,score:double>>")
    matches = F.when(F.size("hits") > 1, F.concat(*found)).otherwise(empty)
    out = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), matches.alias("matches"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["word"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        F.transform("matches", lambda m: F.struct(m["label"], m["word"], m["score"])).alias("matches"),
    )


def oracle() -> str:
    """The same in DuckDB SQL, by trying every start."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n".join(f"('{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {quoted(t.key_words)}, {t.key_at}, {t.slack})" for t in TEMPLATES)
    return f"""
        WITH t(label, base, tw, key, key_at, slack) AS (VALUES {rows}),
        w AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS words FROM documents),
        k AS (SELECT r, label, base, tw, key_at, slack, words,
                     unnest(list_filter(range(len(words)), lambda i: words[i + 1] = key[1] AND len(key) =
                         list_reduce(range(i, least(i + len(key) + slack, len(words))), lambda n, x: CASE WHEN words[x + 1] = key[n + 1] THEN n + 1 ELSE n END, 0))) AS word
              FROM w, t WHERE list_has_all(words, key)),
        m AS (SELECT r, label, base, word,
                     len(list_filter(range(len(tw)), lambda j: len(list_filter(range(greatest(word - key_at + j - slack, 0), word - key_at + j + slack + 1), lambda x: words[x + 1] = tw[j + 1])) > 0)) / len(tw)::DOUBLE AS score
              FROM k),
        g AS (SELECT r, count(*) FILTER (base) AS n_base, min(word) FILTER (base) AS first_word, max(word) FILTER (base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
              FROM m WHERE score >= {LEAST} GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM w LEFT JOIN g USING (r)"""
