"""The similarity join against brute force."""

import random

import numpy as np
import pytest

from seqgraph.llm import jaccard as J


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """doc_id to (n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n_base, copies, edits, passage=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(passage)]
    rows, k = [], 0
    for _ in range(n_base):
        base = [word() for _ in range(rng.choice([3, 12, 40, 120]))]
        at = rng.randrange(len(base))
        base[at:at] = common
        for _ in range(rng.choice(copies)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            rows.append((k, " ".join(own)))
            k += 1
    rng.shuffle(rows)
    return rows


def answer(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard(docs).collect()), key=str)


@pytest.mark.parametrize("case", [(1, 25, [1, 2, 5], 3, 0), (2, 6, [30], 3, 30), (3, 40, [1, 1, 3], 1, 60)])
def test_like_brute_force(spark, case):
    rows = corpus(*case)
    assert answer(spark, rows) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rows = corpus(5, 3, [40], 4, 10)
    assert answer(spark, rows) == brute(rows)
    # Chains of passages that several texts share, around near copies.
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(120):
        own = [w for p in rng.sample(passages, rng.choice([1, 2])) for w in p] + [f"own{i // 3}x{j}" for j in range(rng.choice([4, 12, 30]))]
        own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own)))
    assert answer(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three four"), (8, "One two three four"), (8, "One two three four"), (None, "one two"), (9, "Été " * 3000), (10, "Été " * 3000)]
    assert answer(spark, rows, 2) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert answer(spark, [], 1) == []
    docs = spark.createDataFrame([(1, "a b c d e", 5, "x"), (2, "a b c d e", 6, "y")], "doc_id long, text string, n long, sig string")
    assert sorted(J.jaccard(docs).select("doc_id", "component_id").collect()) == [(1, 1), (2, 1)]
    assert J.keep_one(docs).collect() == [(1, "a b c d e", 5, "x")]


def test_shingle_sets_have_the_right_sizes():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", None, "\t a\r\n", "x" * 5000]
    found = J.shingle_sets(texts)
    assert [len(f) for f in found] == [len(shingles(t)) for t in texts]
    assert all((np.diff(f.astype(object)) > 0).all() for f in found if len(f) > 1)


def test_tree_bound_never_drops_a_link():
    rng = random.Random(11)
    base = [rng.getrandbits(62) for _ in range(200)]
    sets = [np.array(sorted(set(rng.sample(base, rng.randint(150, 200)))), np.uint64) for _ in range(40)]
    for n in (125, 126, 127, 128, 129, 130, 131):  # about where bitmaps grow
        sets += [np.array(sorted(rng.sample(base[:135], n)), np.uint64) for _ in range(6)]
    bits = [int.from_bytes(J.bitmap(s, J.bits_for(len(s))), "little") for s in sets]
    found = {frozenset(p) for p in J.may_link([len(s) for s in sets], bits, J.Union(len(sets)))}
    sides = [i % 3 == 0 for i in range(len(sets))]
    across = {frozenset(p) for p in J.may_link([len(s) for s in sets], bits, J.Union(len(sets)), sides)}
    for i in range(len(sets)):
        for j in range(i):
            if J.linked(sets[i], sets[j]):
                assert frozenset((i, j)) in found and (sides[i] == sides[j]) == (frozenset((i, j)) not in across)


def test_components(spark):
    edges = [(b"e", b"d"), (b"d", b"c"), (b"c", b"b"), (b"b", b"a"), (b"z", b"y"), (b"x", b"z")]
    found = dict((bytes(r.node), bytes(r.comp)) for r in J.components(spark.createDataFrame(edges, "a binary, b binary")).collect())
    assert found == {b"a": b"a", b"b": b"a", b"c": b"a", b"d": b"a", b"e": b"a", b"x": b"x", b"y": b"x", b"z": b"x"}


def test_components_of_a_node_with_more_edges_than_shares(spark):
    name = lambda i: i.to_bytes(2, "big")
    leaves = range(J.SALTS * 5, J.SALTS * 8)
    edges = [(name(J.SALTS * 5 - 1), name(i)) for i in leaves] + [(name(leaves[-1]), name(1)), (name(2), name(3))]
    found = dict((bytes(r.node), bytes(r.comp)) for r in J.components(spark.createDataFrame(edges, "a binary, b binary")).collect())
    assert found == {name(i): name(1) for i in (1, J.SALTS * 5 - 1, *leaves)} | {name(2): name(2), name(3): name(2)}


def test_copies_from_many_partitions(spark):
    texts = ["a b c d e f", "", "g h i j", None]
    rows = [(i, texts[i % 3 if i % 50 else 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    found = sorted(map(tuple, J.jaccard(docs).collect()))
    least = {t: min(i for i, x in rows if x == t) for t in texts}
    assert found == [(i, n, least[t] if n else i) for i, t in rows for n in [{texts[0]: 3, texts[2]: 1}.get(t, 0)]]


def kept_by_brute_force(rows):
    """The texts that stay of each component, and all rows without words."""
    sets = [shingles(t) for _, t in rows]
    groups = {}
    for i, (d, t) in enumerate(rows):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                groups.setdefault(i, set()).add(j)
                groups.setdefault(j, set()).add(i)
    seen, kept = set(), []
    for i in range(len(rows)):
        if not sets[i]:
            kept.append(rows[i])
            continue
        if i in seen:
            continue
        todo, own = [i], set()
        while todo:
            k = todo.pop()
            if k not in own:
                own.add(k)
                todo += groups.get(k, ())
        seen |= own
        ids = [rows[k][0] for k in own]
        least = min((d is None, d or 0) for d in ids)
        kept.append((least, [rows[k] for k in own if (rows[k][0] is None, rows[k][0] or 0) == least]))
    return kept


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda t, w: " ".join([*t[:-1], w])
    rows = [
        (2, " ".join(a)), (3, near(a, "x")), (3, " ".join(b)),  # a repeated id with another text
        (None, near(a, "y")), (None, " ".join(c)), (None, near(c, "z")),  # null ids: one that is near, two near each other
        (7, ""), (7, ""), (None, None), (8, " ".join(b)), (8, " ".join(b)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r.doc_id, r.text) for r in J.keep_one(docs).collect()]
    expected = kept_by_brute_force(rows)
    assert len(found) == len(expected)
    for x in expected:
        if isinstance(x[1], list):
            assert len([f for f in found if f in x[1]]) == 1
        else:
            assert x in found
    assert sorted(found, key=str) == sorted([(2, " ".join(a)), (3, " ".join(b)), (7, ""), (7, ""), (None, None)] + [f for f in found if f[1] and f[1][0] == "c"], key=str)


def test_linked_sets_share_a_key():
    rng = random.Random(8)
    for n in [1, 2, 5, 6, 7, 11, 12, 13, 40, 79, 80, 200, 1000, 3000]:
        base = sorted({rng.getrandbits(64) for _ in range(n)})
        for _ in range(20):
            # Of two sets, as many elements as may be are in one only.
            other = set(base)
            apart = rng.randint(0, 2 * int(J.most_apart(np.int64(n))))
            for _ in range(apart):
                if rng.random() < 0.5 and len(other) > 1:
                    other.discard(rng.choice(base))
                else:
                    other.add(rng.getrandbits(64))
            x, y = (np.array(sorted(s), np.uint64) for s in (base, other))
            if J.linked(x, y):
                at, tag, key, rank = J.part_keys([x, y])
                use = rank <= J.most_apart(np.array([len(x), len(y)]))[at]
                first, second = ({(t, k) for a, t, k in zip(at[use], tag[use], key[use], strict=True) if a == i} for i in (0, 1))
                assert first & second, n


def test_few_parts_are_made_up_for():
    # All shingles lie in a few parts, so parts alone give too few keys.
    x = np.arange(1, 101, dtype=np.uint64)
    y = np.concatenate([x[:-4], np.arange(500, 504, dtype=np.uint64)])
    at, tag, key, rank = J.part_keys([x, y])
    assert J.linked(x, y) and -1 in tag
    use = rank <= J.most_apart(np.array([100, 100]))[at]
    assert {k for a, k in zip(at[use], key[use], strict=True) if a == 0} & {k for a, k in zip(at[use], key[use], strict=True) if a == 1}
