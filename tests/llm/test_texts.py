"""Packing, exact dedup, licences, rules, token counts and SentencePiece: brute force, SQL and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqgraph.llm import exact_dedup, licenses, packing, pieces, rules, wordpiece
from seqgraph.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import rows as oracle_rows
from ..oracle import same

EDGES = [
    (1, None, "a", None), (2, "", "a", "s"), (3, "  \n\t", "a", "s"), (None, "one", "b", "s"), (5, "one", "b", "s"), (5, "one", "b", "s"), (6, "é " * 30_000, "b", None),
    (7, "Under the MIT License! under THE mit license", "c", "s"), (8, "▁x <|endoftext|> ", "c", "s"), (9, "x" * 200_000, "c", "s"),
]
COLUMNS = "doc_id long, text string, lang string, source string"


def docs(spark, rows=EDGES, parts=2):
    """With columns whose names clash with inner ones."""
    extra = {c: F.lit("x") for c in ("digest", "rid", "part", "n_words", "words", "row", "host", "ids", "rank", "task", "length", "kept", "matches", "bucket", "lines")}
    return spark.createDataFrame(rows, COLUMNS).repartition(parts).withColumns(extra)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, sf, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name], sf) > 0


# Exact dedup


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.randbytes(32) for _ in range(3000)]
    own = exact_dedup.CuckooFilter(4096)
    assert all(own.insert(k) for k in keys) and all(k in own for k in keys)
    assert sum(rng.randbytes(32) in own for _ in range(20_000)) < 40
    for k in keys[:1500]:
        assert own.delete(k)
    assert all(k in own for k in keys[1500:]) and sum(k in own for k in keys[:1500]) < 10


def test_bucket_resizes_from_its_keys():
    rng = random.Random(2)
    own = exact_dedup.Bucket()
    keys = [rng.randbytes(32) for _ in range(2000)]
    for i, k in enumerate(keys * 2):
        own.upsert(k, (i, i), 1)
    assert own.filter.capacity >= 2000 and all(k in own.filter for k in keys) and all(own.get(k) == [(i + 2000, i + 2000), 2] for i, k in enumerate(keys))
    own.delete(keys[0])
    assert own.get(keys[0]) is None and sorted(d for d, _, _ in own.entries()) == sorted(keys[1:])


def test_index_updates(spark):
    rows = [(bytes([i]) * 32, i, i, 1) for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "digest binary, keep_id long, keep_rid long, group_size long")
    index = exact_dedup.update_index(None, frame(rows), n_buckets=3).cache()
    more = exact_dedup.update_index(index, frame([(bytes([5]) * 32, 99, 99, 4), (bytes([50]) * 32, 50, 50, 1)]), frame(rows[:2]).select("digest"), n_buckets=3)
    found = {bytes(r.digest)[0]: (r.keep_id, r.group_size) for r in exact_dedup.entries(more).collect()}
    assert len(found) == 19 and found[5] == (99, 5) and found[50] == (50, 1) and 0 not in found
    assert sorted(d for d, in exact_dedup.update_index(more, frame([])).select("digest").where("digest is not null").collect()) == sorted(d for d, in more.select("digest").where("digest is not null").collect())
    with pytest.raises(ValueError, match="3 buckets"):
        exact_dedup.update_index(index, frame(rows), n_buckets=4)


def test_dedup_edge_cases(spark):
    found = exact_dedup.exact_dedup(docs(spark)).collect()
    assert len(found) == len(EDGES)
    assert sum(r.kept for r in found) == len({t or "" for _, t, *_ in EDGES})
    one = [r for r in found if r.group_size == 3]
    assert len(one) == 3 and sum(r.kept for r in one) == 1 and all(r.keep_id == 5 for r in one)
    kept = exact_dedup.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == 7
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_dedup_of_copies_from_many_partitions(spark):
    rows = [(i, f"text {i % 4}" if i % 4 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert found == {i: (196 + i % 4, 50, i == 196 + i % 4) for i in range(200)}
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [196, 197, 198, 199]


# Packing


def check_plan(counts, size):
    """Every piece placed once, no gap, no overflow; the number of sequences."""
    where = {}
    for length, first, sequence, copies, offset in packing.plan(counts, size):
        where.setdefault(length, []).append((first, sequence, copies, offset))
    filled = {}
    for length in np.flatnonzero(counts):
        spans = sorted(where[length])
        for rank in range(counts[length]):
            first, sequence, copies, offset = [s for s in spans if s[0] <= rank][-1]
            nth = rank - first
            filled.setdefault(sequence + nth // copies, []).append((offset + nth % copies * length, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(filled)


def fewest(lengths, size):
    """Fewest sequences, by search."""
    best = [len(lengths)]

    def go(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(gaps)
            return
        for k in range(len(gaps)):
            if gaps[k] >= lengths[i] and gaps[k] not in gaps[:k]:
                go(i + 1, [*gaps[:k], gaps[k] - lengths[i], *gaps[k + 1 :]])
        go(i + 1, [*gaps, size - lengths[i]])

    go(0, [])
    return best[0]


def test_plans_are_valid_and_tight():
    rng = np.random.default_rng(4)
    worse = 0
    for _ in range(60):
        size = int(rng.integers(5, 30))
        lengths = sorted(rng.integers(1, size + 1, 8).tolist(), reverse=True)
        found = check_plan(np.bincount(lengths, minlength=size + 1), size)
        worse += found - fewest(lengths, size)
    assert worse <= 3
    assert check_plan(np.bincount([3] * 1000, minlength=11), 10) == 334
    many = np.bincount(rng.integers(1, 513, 5000), minlength=513)
    assert check_plan(many, 512) <= max(-(-(many * np.arange(513)).sum() // 512), many[257:].sum() + -(-many[256] // 2)) * 1.01


def test_exact_combinations_come_first():
    counts = np.bincount([10, 6, 4, 7, 3, 5, 3, 2, 8, 1, 1], minlength=11)
    assert check_plan(counts, 10) == 5


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own, rng = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(2)
    letters = list("abcXYZ é ÉßñİıſΣςσ'.,!-_*12½²٣ ̈́ \x1c\x85　中\U0001f600\n\t\r\x0b\x0cKﬁ<|>")
    for i in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + (" <|endoftext|> a" if i % 50 == 0 else "")
        assert own.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = packing.pack(docs(spark)).collect()
    expected = []
    for doc_id, text, *_ in EDGES:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(doc_id, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(expected, key=str)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) <= 4096
    assert packing.pack(docs(spark, [])).count() == 0
    whole = packing.sequences(docs(spark)).collect()
    assert len(whole) == len(by) and sum(len(r.ids) for r in whole) == 4 * sum(e[3] for e in expected)


# Licences


def test_license_passages_tell_licences_apart(spark):
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use it.",
        "apache-2": "Software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "bsd": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "agpl": "You may copy it under the terms of the GNU Affero General Public License.",
        "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "": "The names of its contributors may be printed here; source versions must be marked, and the public license is free.",
    }
    rows = [(i, f"x y {t} z", "", "") for i, t in enumerate(texts.values())]
    found = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [found[i].labels for i in range(len(rows))] == list(texts) and all(r.n_base == 0 for r in found.values())


def test_licenses_with_inserted_words(spark):
    grant = "Permission is hereby granted, free of charge, to any person {} a copy of this {}software and associated documentation files"
    forms = "Redistribution and use in source and {}binary forms, with or without modification, are permitted"
    cases = [
        (grant.format("who is obtaining", ""), "mit"), (grant.format("obtaining", "very "), "mit"), (grant.format("who is now obtaining", ""), ""), (grant.format("who obtaining is", ""), "mit"),
        (grant.format("who wants", ""), ""), (forms.format("in "), "bsd"), ("a " * 40 + forms.format("in any "), "bsd"), (forms.format("in any other "), ""), (forms.format("in ")[14:], ""),
        ("This is under the GNU GPL v3.", "gpl-3"), ("SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache-2"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("under the very MIT license", ""),
    ]
    rows = docs(spark, [(i, t, "", "") for i, (t, _) in enumerate(cases)])
    found = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert [found[i].labels for i in range(len(cases))] == [label for _, label in cases]
    # A word pushed out of its place still counts.
    assert found[0].score == found[5].score == 1.0 and found[0].n_base == 0


def test_licenses_with_inserted_words_like_sql(spark, tmp_path):
    passages = [t.key for t in licenses.TEMPLATES] + [t.text for t in licenses.TEMPLATES]
    rng, rows = random.Random(12), []
    for i in range(300):
        words = [w for _ in range(rng.randint(1, 3)) for w in (*["filler"] * rng.randint(0, 3), *rng.choice(passages).split())]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["is", "the", "of", "and", "x"]))
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        rows.append((i, " ".join(words), "", ""))
    docs(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = c.sql(licenses.oracle()).df()
    columns = list(expected.columns)
    found = licenses.scan(spark.read.parquet(f"file://{tmp_path}/documents.parquet")).select(*columns).toPandas()
    assert oracle_rows(found, columns) == oracle_rows(expected, columns)
    assert (found["labels"] != "").mean() > 0.5


def test_licenses(spark):
    found = {r.doc_id: r for r in licenses.scan(docs(spark)).collect() if r.doc_id is not None}
    seven = found[7]
    assert (seven.n_words, seven.n_base, seven.first_word, seven.last_word, seven.base_labels, seven.score) == (8, 2, 0, 4, "mit", 1.0)
    assert found[1].n_words == 0 and found[1].score == 0 and found[1].labels == "" and found[1].first_word is None
    rows = [(1, "cc by-nc cc-by-nc", "", ""), (2, "under the MIT licensK license under the", "", ""), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted", "", ""), (4, "the mit license", "", ""), (5, "apache license, version 2", "", "")]
    found = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (found[1].n_base, found[1].base_labels) == (2, "cc-by-nc")
    assert found[2].labels == "" and found[3].labels == "bsd" and found[3].n_base == 0 and found[4].labels == "" and found[5].base_labels == "apache-2"
    assert licenses.scan(docs(spark, [])).count() == 0


# Rules


def repeated(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + j for places in seen.values() if len(places) > 1 for i in places for j in range(8)})


def test_rules_like_brute_force(spark):
    rng = random.Random(6)
    rows = [*EDGES]
    for i in range(40):
        block = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        rows.append((100 + i, rng.choice(["\n", " ", "\t"]).join(block * rng.randint(1, 4) + [rng.choice("abcd") for _ in range(rng.randint(0, 40))]) + rng.choice(["", "\n#|\n#|", "\n \n "]), "x", "s"))
    found = {(r.doc_id, r.n_words, r.n_repeat_words): r for r in rules.judge(docs(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        text = text or ""
        words = text.encode().split()
        r = found[doc_id, len(words), repeated(words)]
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r.word_chars == sum(len(w.decode()) for w in words) and r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)


def test_frequent_lines_deplete(spark):
    common = "Subscribe to our letter number 7 and read on every day of the week for no money at all, dear friends of ours\n" * 1
    rows = [(i, common.replace("7", f"{i:02d}") + ("" if i < 30 else f"own words of {chr(97 + i % 26)}{chr(97 + i // 26)} " * 12), "en", "h") for i in range(60)]
    rows += [(1000 + i, f"another text of host {chr(97 + i % 26)}{chr(97 + i // 26)} " * 9 + " ".join(f"{chr(97 + i % 26)}{j}" for j in range(9)), "en", "h") for i in range(100)]
    rows += [(2000 + i, "every copy is a document of its host, so the line of many copies is frequent there, whatever it says to us all", "en", "h") for i in range(40)]
    rows += [(3000 + i, "but a line of as many documents as the limit says is none yet, and twice in one document is once, as we all know\n" * 2, "en", "h") for i in range(rules.LINE_DOCS)]
    found = {r.doc_id: r for r in rules.judge(docs(spark, rows)).collect()}
    assert all(found[i].depleted and not found[i].kept for i in range(30)) and all(not found[i].depleted and found[i].lost > 0 for i in range(30, 60))
    assert all(found[2000 + i].depleted and not found[2000 + i].kept and not found[2000 + i].base_failed for i in range(40))
    assert all(not found[3000 + i].depleted and found[3000 + i].lost == 0 for i in range(rules.LINE_DOCS))
    clean = {r.doc_id: r.text for r in rules.cleaned(docs(spark, rows)).collect()}
    assert "Subscribe" not in clean.get(45, "") and rules.judge(docs(spark, [])).count() == 0


def test_line_frequency_changes_verdicts_as_in_sql(spark, tmp_path):
    """Rows on which the verdict hangs on the lines of other documents, against the SQL of the query."""
    menu = ["Home | News | Sport | Weather | Travel | Money and all the other pages of this site", "Sign in to read on and to leave your comments, or  register NOW 100 % free"]
    own = lambda i, n: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(n))
    rows = []
    for i in range(60):
        host, lines = ("a", "b", None)[i % 3], [menu[0], menu[1].replace("100", str(i))][: 1 + (i % 2)]
        rows.append((i, "\n".join([*lines, own(i, 4 if i % 4 else 26)]), "en", host))
    rows += [(100 + i, "\n".join([*menu, own(i, 3)]), "en", "rare") for i in range(rules.LINE_DOCS)]
    rows += [(7, rows[7][1], "en", "b"), (None, None, None, None), (None, "", "en", "a")]
    path = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    found, expected = QUERIES["op5_quality_rules"](spark, path).toPandas(), duckdb.connect()
    expected.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    expected = expected.sql(ORACLE_SQL["op5_quality_rules"]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns) and oracle_rows(found, columns) == oracle_rows(expected, columns)
    decided = found[~found.base_failed]
    assert (decided.kept == 0).sum() >= 10 and decided.kept.sum() >= 10
    cleaned = rules.cleaned(spark.read.parquet(f"{path}/documents.parquet"))
    assert cleaned.count() == found.kept.sum()


# Token counts


def greedy(vocab, word):
    i = n = 0
    while i < len(word):
        k = max((len(v) for v in vocab if word.startswith(v, i)), default=0)
        n += 1 if k else len(word[i].encode())
        i += k or 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(200):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        own = wordpiece.Automaton(sorted(vocab))
        for _ in range(20):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14)))
            assert own.count(word) == greedy(vocab, word)


def test_token_counts(spark):
    vocab = set(wordpiece.vocabulary())
    by_length = sorted(vocab, key=len)
    longest = len(by_length[-1])

    def count(word):
        i = n = 0
        while i < len(word):
            k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in vocab), 0)
            n += 1 if k else len(word[i].encode())
            i += k or 1
        return n

    found = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in wordpiece.counts(docs(spark)).collect()), key=str)
    expected = []
    for doc_id, text, *_ in EDGES:
        words = [w.decode() for w in (text or "").encode().split()]
        expected.append((doc_id, len(words), sum(count("▁" + w) for w in words)))
    assert found == sorted(expected, key=str) and wordpiece.counts(docs(spark, [])).count() == 0


# SentencePiece


def test_viterbi_is_best_and_exact():
    own, rng = pieces.Codec.load(), random.Random(9)
    scores = {i: s for i, s in own.pieces.values()}

    def best(word):
        out = [0.0]
        for end in range(1, len(word) + 1):
            top = out[end - 1] - pieces.BYTE_COST * len(word[end - 1].encode())
            for k in range(max(0, end - own.longest), end):
                if (found := own.pieces.get(word[k:end])) and out[k] + found[1] > top:
                    top = out[k] + found[1]
            out.append(top)
        return out[-1]

    letters = list("aeinrst  .\n\té漢😀▁")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " ", "\n", "  a", "▁", "\ue000", "\ue0001"]
    ids = own.encode(texts)
    assert [own.decode(i) for i in ids] == texts
    for word in {w for t in texts for w in own.mark(t) if pieces._ASIDE not in w and w != "▁"}:
        total = sum(scores.get(i, -pieces.BYTE_COST) for i in np.frombuffer(own.encode([word.replace("▁", " ")[1:] if word[0] == "▁" else word])[0], "<u4").tolist())
        assert total == pytest.approx(best(word))
    # Whole texts: cutting them into words loses nothing, runs of spaces included.
    whole = [t for t in texts if "▁" not in t and pieces._ASIDE not in t] + ["a" + " " * n + "in  the \n   end" for n in range(40)]
    for t, i in zip(whole, own.encode(whole), strict=True):
        total = sum(scores.get(x, -pieces.BYTE_COST) for x in np.frombuffer(i, "<u4").tolist())
        marked = t.replace(" ", "▁")
        assert total == pytest.approx(best(marked if marked[:1] in ("", "\n") else "▁" + marked))
        assert own.decode(i) == t


def test_sentencepiece_round_trip(spark):
    encoded = pieces.encode(docs(spark)).cache()
    assert encoded.where("not exact").count() == 0
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(encoded).collect()), key=str)
    assert back == sorted(((d, t or "") for d, t, *_ in EDGES), key=str) and pieces.digest(docs(spark, [])).count() == 0


def test_expected_pieces_over_all_segmentations():
    own = pieces.Codec({"a": (0, -1.0), "b": (1, -1.5), "ab": (2, -1.2), "ba": (3, -2.0), "aba": (4, -2.5)}, list(range(10, 266)), 4.0)

    def ways(word):
        if not word:
            yield [], 1.0
        for k in range(1, len(word) + 1):
            found = [(i, math.exp(s)) for p, (i, s) in own.pieces.items() if p == word[:k]] + ([(-1, math.exp(-4.0 * len(word[0].encode())))] if k == 1 else [])
            for i, p in found:
                for rest, q in ways(word[k:]):
                    yield [i, *rest], p * q

    for word in ("a", "ab", "abab", "bbaba", "aéab", "é"):
        total = sum(p for _, p in ways(word))
        plain = {i: sum(w.count(i) * p for w, p in ways(word)) / total for i in range(5)}
        assert own.expected(word) == pytest.approx({i: x for i, x in plain.items() if x})


def test_words_together_as_one_by_one(monkeypatch):
    """Same ids, and same expected pieces, of words that go through the trie together; few go one by one."""
    rng = random.Random(4)
    plain = pieces.Codec.load()
    tied = pieces.Codec({"a": (0, -4.0), "b": (1, -2.0), "ab": (2, -6.0), "ba": (3, -4.0), "aba": (4, -8.0), "bab": (5, -6.0)}, list(range(10, 266)), 4.0)
    for own, letters, n in ((plain, "▁aeinrst.éж", 2_000), (plain, "▁ae日漢😀", 300), (tied, "ab", 300), (tied, "abé", 300)):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(n)} | {"a" * 300, letters * 3, "é" * 200})
        counts = [rng.randint(1, 9) for _ in words]
        alone, each = [], own.expected
        wanted = np.zeros(max(i for i, _ in own.pieces.values()) + 1)
        for word, k in zip(words, counts, strict=True):
            for i, x in each(word).items():
                wanted[i] += k * x
        own.known.clear()
        own._learn_sorted(words)
        ids = dict(own.known)
        for cells in (pieces.CELLS, 600):
            own.known.clear()
            with monkeypatch.context() as m:
                m.setattr(pieces, "CELLS", cells)
                m.setattr(own, "expected", lambda word, each=each, alone=alone: alone.append(word) or each(word))
                assert own.total(words, counts) == pytest.approx(wanted, rel=1e-9)
                own.learn(set(words))
            assert own.known == ids
            if cells != 600:
                assert len(alone) <= 35
    assert tied.total([], []).tolist() == [0] * 6
    with pytest.raises(KeyError):
        plain.decode(np.array([1], "<u4").tobytes())


def test_estimated_scores(spark, sf):
    """Pieces that texts need get dearer or cheaper with their use; texts cost fewer ids, and decode as before."""
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scores = pieces.fit(given)
    assert (scores == pieces.fit(given.repartition(3))).all()
    kept = [i for i, _ in pieces.Codec.load().pieces.values()]
    assert np.exp(scores[kept].astype(float)).sum() == pytest.approx(1, abs=1e-3)
    before, after = (pieces.encode(given, scores=s).agg(F.sum(F.octet_length("ids")).alias("n"), F.bool_and("exact").alias("exact")).first() for s in (None, scores))
    assert after.exact and after.n < before.n
    texts = spark.createDataFrame(EDGES, COLUMNS)
    assert pieces.fit(docs(spark, [])) is None and pieces.encode(texts, scores=pieces.fit(texts)).where("not exact").count() == 0


def test_scores_are_of_all_words(spark, monkeypatch):
    """Long texts, long words and words with characters put aside count too, and so does each of many texts."""
    rows = [(i, f"w{i % 7} common") for i in range(3_000)] + [(3_000, "tail " * 5_000), (3_001, "x" * 70), (3_002, "ab▁cd▁"), (3_003, None)]
    monkeypatch.setattr(pieces, "COUNTED", 5)
    found = {r.word: r.n for r in pieces.counted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own, plain = pieces.Codec.load(), Counter()
    for _, text in rows:
        plain.update(p for w in own.mark(text or "") for p in re.split(f"{pieces._ASIDE}[01]", w) if p)
    assert found == plain and found["▁common"] == 3_000 and found["▁tail"] == 5_000 and found["▁" + "x" * 70] == 1
    assert pieces.fit(spark.createDataFrame([(1, "tail " * 5_000 + "x" * 70)], "doc_id long, text string")) is not None
    # In logs as in plain numbers.
    for word in ("▁internationalisation", "▁aéab日"):
        before = own.expected(word)
        with monkeypatch.context() as m:
            m.setattr(pieces, "TINY", 2.0)
            assert own.expected(word) == pytest.approx(before)
    assert sum(own.expected("é日" * 500 + "common").values()) > 0.5
