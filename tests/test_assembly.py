"""Unitigs, components, transitive arcs and tips against plain Python on random graphs with both strands."""

import random

import pytest

from seqgraph.operators import assembly, components
from seqgraph.plans import derived
from seqgraph.plans.queries import QUERIES

PAIRS = str.maketrans("ACGT", "TGCA")


def random_graph(seed, n=40):
    """Sequences by segment, arcs with complements: mostly ways, with rings, forks, hairpins and parallel arcs."""
    rng = random.Random(seed)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(rng.randint(4, 9))) for i in range(n)}
    arcs, ids = set(), list(range(n))
    rng.shuffle(ids)
    at = 0
    while at < n:
        way = [i * 2 + rng.randint(0, 1) for i in ids[at : at + rng.randint(1, 7)]]
        at += len(way)
        arcs |= {(a, b, rng.randint(0, 3)) for a, b in zip(way, way[1:], strict=False)}
        if rng.random() < 0.4:
            arcs.add((way[-1], way[0], rng.randint(0, 3)))
    for _ in range(n // 8):
        v = rng.randrange(2 * n)
        arcs.add((v, rng.choice([rng.randrange(2 * n), v ^ 1]), rng.randint(0, 3)))
    return seqs, sorted({(v, w, o, o) for v, w, o in arcs} | {(w ^ 1, v ^ 1, o, o) for v, w, o in arcs})


def frames(spark, seqs, arcs):
    segments = spark.createDataFrame([(i, s, len(s)) for i, s in seqs.items()], "seg_id long, seq string, len int")
    return spark.createDataFrame(arcs, "v long, w long, ov int, ow int"), segments, spark.createDataFrame([(2 * i + k, len(s)) for i, s in seqs.items() for k in (0, 1)], "v long, len int")


def text(seqs, v):
    return seqs[v >> 1].translate(PAIRS)[::-1] if v & 1 else seqs[v >> 1]


def plain_unitigs(seqs, arcs):
    out, into = {}, {}
    for a in arcs:
        out.setdefault(a[0], []).append(a)
        into.setdefault(a[1], []).append(a)
    after = {a[0]: a for a in arcs if len(out[a[0]]) == 1 and len(into[a[1]]) == 1 and a[1] != a[0] ^ 1}
    before = {a[1]: a for a in after.values()}
    found, seen = {}, set()
    for v in [v for v in range(2 * len(seqs)) if v not in before] + sorted(before):
        if v in seen:
            continue
        way, at = [v], v
        while at in after and after[at][1] != v:
            at = after[at][1]
            way.append(at)
        seen |= set(way)
        ring = v in before
        if v < (min(x ^ 1 for x in way) if ring else way[-1] ^ 1):
            found[v] = ("".join(text(seqs, x)[before[x][3] if x in before else 0 :] for x in way), len(way), ring)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_unitigs(spark, seed):
    seqs, arcs = random_graph(seed)
    own, segments, _ = frames(spark, seqs, arcs)
    spelled, between = assembly.unitig_graph(own, segments)
    expected = plain_unitigs(seqs, arcs)
    assert {r.unitig: (r.seq, r.n, r.circular) for r in spelled.collect()} == expected
    assert any(x[2] and x[1] > 1 for x in expected.values()) or seed
    # Every arc between unitigs leads from the end of one to the beginning of another, and has its complement.
    rows = {tuple(r) for r in between.collect()}
    assert rows == {(w ^ 1, v ^ 1, ow, ov) for v, w, ov, ow in rows}


def closure(n, arcs):
    reach = {v: {v} for v in range(n)}
    changed = True
    while changed:
        changed = False
        for v, w in arcs:
            more = reach[w] - reach[v]
            if more:
                reach[v] |= more
                changed = True
    return reach


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    n = 40
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(30 + 10 * seed)] + [(i, i + 1) for i in range(0, 20)] + [(20, 12), (5, 3), (30, 31), (31, 32), (32, 30), (7, 7)]
    reach = closure(n, arcs)
    found = components.strong(spark.createDataFrame(arcs, "v long, w long"), spark.range(n).withColumnRenamed("id", "v"))
    assert {r.v: r.component for r in found.collect()} == {v: min(w for w in reach[v] if v in reach[w]) for v in range(n)}


def test_a_ring_and_a_chain_in_few_rounds(spark, monkeypatch):
    seen, plain = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name, *a: seen.append(name) or plain(df, name, *a))
    n = 3_000
    arcs = spark.range(n - 1).selectExpr("id as v", "id + 1 as w").unionByName(spark.createDataFrame([(n - 1, n // 2)], "v long, w long"))
    found = components.strong(arcs, spark.range(n).withColumnRenamed("id", "v"))
    assert {r.component: r["count"] for r in found.where(f"v >= {n // 2 - 1}").groupBy("component").count().collect()} == {n // 2 - 1: 1, n // 2: n // 2}
    assert len(seen) < 30


def test_transitive_arcs_with_and_without_hubs(spark):
    rng = random.Random(1)
    seqs = {i: "A" * rng.randint(5, 30) for i in range(25)}
    arcs = sorted({(rng.randrange(50), rng.randrange(50), rng.randint(0, 4), 0) for _ in range(500)})
    own, segments, _ = frames(spark, seqs, arcs)
    length = {}
    for v, w, ov, _ in arcs:
        length[v, w] = min(length.get((v, w), 99), len(seqs[v >> 1]) - ov)
    gone = {(v, w) for (v, u), a in length.items() for (x, w), b in length.items() if x == u and (v, w) in length and a + b <= length[v, w] + 6 and max(a, b) < length[v, w]}
    expected = gone | {(w ^ 1, v ^ 1) for v, w in gone}
    assert len(gone) > 20
    for hub in (1_000, 2):
        assert {(r.v, r.w) for r in assembly.transitive_arcs(own, segments, 6, hub=hub).collect()} == expected


def plain_tips(sizes, arcs, steps, length):
    left, live = dict(sizes), {(a[0], a[1]) for a in arcs}
    while True:
        out, into = {}, {}
        for v, w in live:
            out.setdefault(v, []).append(w)
            into.setdefault(w, []).append(v)
        gone = set()
        for v in left:
            way = [v]
            if into.get(v) or len(out.get(v, [])) > 1:
                continue
            while True:
                after = out.get(way[-1], [])
                if not after or len(into[after[0]]) > 1:
                    if len(way) <= steps and sum(left[x] for x in way) <= length:
                        gone |= set(way) | {x ^ 1 for x in way}
                    break
                if len(out.get(after[0], [])) > 1:
                    break
                way.append(after[0])
        if not gone:
            return set(left)
        left = {v: n for v, n in left.items() if v not in gone}
        live = {(v, w) for v, w in live if v not in gone and w not in gone}


@pytest.mark.parametrize("seed", range(3))
def test_tips(spark, seed):
    seqs, arcs = random_graph(seed + 10, 60)
    own, _, vertices = frames(spark, seqs, arcs)
    found = assembly.drop_tips(own, vertices, 3, 20)
    kept = {r.v for r in found.collect()}
    assert kept == plain_tips({2 * i + k: len(s) for i, s in seqs.items() for k in (0, 1)}, arcs, 3, 20)
    assert 0 < len(kept) < 120 and {v ^ 1 for v in kept} == kept
    again = assembly.drop_tips(own.join(found, "v", "left_semi").join(found.withColumnRenamed("v", "w"), "w", "left_semi"), vertices.join(found, "v", "left_semi"), 3, 20)
    assert {r.v for r in again.collect()} == kept


def test_rounds_of_tips_write_what_they_meet(spark, monkeypatch):
    """A tree whose leaves go round by round, and ways that a fork stops until its branch is gone, beside many rings."""
    rows, plain = [], assembly.materialise
    monkeypatch.setattr(assembly, "materialise", lambda df, *a: (found := plain(df, *a), rows.append(found.count()))[0])
    arcs = {(2 * i, 2 * ((i + 1) // 2 - 1)) for i in range(1, 31)}
    for at in range(200, 240, 8):  # a way to a fork, whose one branch is a tip from the other strand; it ends in a ring
        arcs |= {(2 * at, 2 * at + 2), (2 * at + 2, 2 * at + 4), (2 * at + 2, 2 * at + 8), (2 * at + 4, 2000)}
    arcs |= {(2 * i, 2 * (i - 4 if i % 5 == 4 else i + 1)) for i in range(1_000, 3_000)}
    arcs = sorted(arcs | {(w ^ 1, v ^ 1) for v, w in arcs})
    sizes = {2 * i + k: 5 for i in [*range(31), *range(200, 240), *range(1_000, 3_000)] for k in (0, 1)}
    vertices = spark.createDataFrame(list(sizes.items()), "v long, len int")
    expected = plain_tips(sizes, [(*a, 0, 0) for a in arcs], 3, 20)
    assert len(expected) == 4_000
    once = [(v, w) for v, w in arcs if (v, w) <= (w ^ 1, v ^ 1)] * 2  # complements need not be given
    assert {r.v for r in assembly.drop_tips(spark.createDataFrame(once, "v long, w long"), vertices, 3, 20).collect()} == expected
    assert sum(rows) < 2 * len(sizes)


def test_the_query_of_tips(spark, sf):
    arcs = [tuple(r) for r in derived.order_arcs(spark, sf).collect()]
    sizes = {2 * r.seg_id + k: r.len for r in derived.order_segments(spark, sf).collect() for k in (0, 1)}
    assert {r.v for r in QUERIES["drop_tips"](spark, sf).collect()} == plain_tips(sizes, arcs, 3, 60)


def test_rounds_follow_ways_and_not_the_table(spark, monkeypatch):
    """Many short cycles beside many short ways: tables written do not grow with their number."""
    from seqgraph.operators import reach

    written = []
    for module in (reach, assembly):
        plain = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, *a, plain=plain, **k: (written.append(name), plain(df, name, *a, **k))[1])
    counts = []
    for n in (4, 600):
        cycles = [(10 * i + k, 10 * i + (k + 1) % 5) for i in range(n) for k in range(5)]
        ways = [(10 * i + k, 10 * i + k - 1) for i in range(n) for k in range(6, 10)] + [(10**6 + i, i % 5) for i in range(n)]
        links = spark.createDataFrame([(v, p, 1) for v, p in cycles + ways], "v long, p long, n long")
        written.clear()
        found = {(r.v, r.p, r.n) for r in reach.doubled(links).collect()}
        assert found == {(10 * i + k, 10 * i + 5, k - 5) for i in range(n) for k in range(6, 10)}
        heads = {r.v: r["head"] for r in assembly.cycle_heads(spark.createDataFrame(cycles, "v long, p long")).collect()}
        assert heads == {v: v // 10 * 10 for v, _ in cycles}
        counts.append(len(written))
    assert counts[0] == counts[1] <= 10


def test_transitive_arcs_of_more_ends_than_bits(spark):
    """A vertex with 300 ends marks all bits; one with few lets through only pairs that end among them."""
    rng = random.Random(4)
    lens = {i: rng.randint(8, 30) for i in range(200)}
    arcs = {(0, rng.randrange(2, 400)) for _ in range(900)} | {(rng.randrange(400), rng.randrange(400)) for _ in range(1_500)}
    arcs = sorted((v, w, rng.randint(0, 3)) for v, w in arcs)
    n = {(v, w): lens[v >> 1] - o for v, w, o in arcs}
    after = {}
    for v, w in n:
        after.setdefault(v, []).append(w)
    gone = {(v, w) for v, u in n for w in after.get(u, []) if (v, w) in n and n[v, u] + n[u, w] <= n[v, w] + 15 and max(n[v, u], n[u, w]) < n[v, w]}
    assert gone and len(after[0]) > assembly.SIGNATURE
    rows = spark.createDataFrame([(*a, 0) for a in arcs], "v long, w long, ov int, ow int")
    segments = spark.createDataFrame(list(lens.items()), "seg_id long, len int")
    for hub in (1_000, 50):
        found = assembly.transitive_arcs(rows, segments, fuzz=15, hub=hub)
        assert {(r.v, r.w) for r in found.collect()} == gone | {(w ^ 1, v ^ 1) for v, w in gone}
    assert "bit_get" in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("bitwiseget", "bit_get")
