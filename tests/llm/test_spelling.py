"""Spelling variants against all pairs of words."""

import itertools
import re
import zlib
from collections import Counter

import pytest

from seqgraph.llm import spelling
from seqgraph.llm.queries import QUERIES


def edits(a, b):
    """Whether one insertion, deletion or replacement makes a into b, by trying all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(words):
    near = {w: [] for w in words}
    holes = {}
    for w in words:  # two near words leave the same with one letter taken out of either or both, at the same place
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(x, []).append(w)
    for group in holes.values():
        for a, b in itertools.combinations(set(group), 2):
            if edits(a, b):
                near[a].append(b)
                near[b].append(a)
    near = {w: set(x) for w, x in near.items()}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w]) or 0) for w, n in words.items())


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_near():
    words = ["".join(x) for k in range(5) for x in itertools.product("ab", repeat=k)]
    assert all(spelling.near(a, b) == edits(a, b) for a in words for b in words)


WORDS = {"colour": 40, "color": 90, "colours": 7, "colors": 11, "colored": 3, "xolor": 3, "xolour": 5, "größe": 9, "grösse": 4, "gröse": 3, "zzzzz": 5, "zzzzy": 5, "aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "é" * 6: 3, "é" * 7: 8, "e" * 14 + "xy": 3, "e" * 15 + "xy": 7, "e" * 16 + "xy": 15, "e" * 17 + "xy": 31, "e" * 300: 3, "e" * 299: 7, "e" * 298: 15}


@pytest.mark.parametrize("stored,asked", [(100_000, 200_000), (2, 3), (1, 1)])
def test_parts_and_copies(spark, stored, asked):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    assert told(spelling.rooted(spelling.forms(words, stored, asked))) == plain(WORDS)
    pairs = sorted(tuple(r) for r in spelling.near_pairs(words, stored, asked).collect())
    assert pairs == sorted((a, WORDS[a], b, WORDS[b]) for a in WORDS for b in WORDS if edits(a, b))


def test_documents(spark):
    rows = [(i, "Colour color COLOR colours× naïve-naïve " * (i % 4)) for i in range(60)] + [(None, "Colour " * 5), (None, None), (5, ""), (5, "x" * 5000 + " " + "é" * 300), (6, "Ärger ärger Ärger Ärger ärger ärger colou1color")]
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    words = plain_words(rows)
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == words
    assert told(spelling.variants(docs)) == plain(words)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(plain_words(rows))
    assert told(QUERIES["op13_spelling_variants"](spark, sf)) == expected
    assert sum(bool(r[1]) for r in expected) > 50
