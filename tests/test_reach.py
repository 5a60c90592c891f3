"""Searches against Dijkstra's in plain Python, and their rounds."""

import heapq
import random

import pytest

from seqgraph.operators import reach


def dijkstra(arcs, starts, most=1 << 30):
    out = {}
    for v, w, n in arcs:
        out.setdefault(v, []).append((w, n))
    best, heap = {}, [(0, s) for s in starts]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for w, n in out.get(v, []):
                if d + n <= most:
                    heapq.heappush(heap, (d + n, w))
    return best


def tables(spark, arcs, starts):
    return spark.createDataFrame(arcs, "v long, w long, n long"), spark.createDataFrame([(s,) for s in starts], "v long")


def found(spark, arcs, starts, most=1 << 30):
    return {r.v: r.dist for r in reach.distances(*tables(spark, arcs, starts), "n", most).collect()}


@pytest.fixture
def rounds(monkeypatch):
    """How many tables the searches write."""
    seen, plain = [], reach.materialise
    monkeypatch.setattr(reach, "materialise", lambda df, name, *a: seen.append(name) or plain(df, name, *a))
    return seen


def shapes(seed):
    """Chains, bubbles, tips, cycles with and without a way in, parallel arcs, what is not reached."""
    rng, arcs, at = random.Random(seed), [], 1
    ends = [0]
    for _ in range(25):
        v, kind = rng.choice(ends[-3:]), rng.randint(0, 4)
        if kind < 2:  # chain
            for _ in range(rng.randint(1, 12)):
                arcs.append((v, at, rng.randint(0, 9)))
                v, at = at, at + 1
        elif kind == 2:  # bubble
            join = at
            at += 1
            for _ in range(rng.randint(2, 3)):
                arcs += [(v, at, rng.randint(0, 9)), (at, join, rng.randint(0, 9))]
                at += 1
            v = join
        elif kind == 3:  # a cycle that is entered, and one that is not
            arcs += [(v, at, 1), (at, at + 1, 2), (at + 1, at, 3), (at + 2, at + 3, 1), (at + 3, at + 2, 1), (at + 3, v, 1)]
            v, at = at + 1, at + 4
        else:  # back, and parallel
            arcs += [(v, rng.choice(ends), rng.randint(0, 9)), (v, at, 5), (v, at, 4)]
            v, at = at, at + 1
        ends.append(v)
    arcs.append((at, 0, 1))
    return arcs


@pytest.mark.parametrize("seed", range(2))
def test_like_dijkstra(spark, monkeypatch, seed):
    monkeypatch.setattr(reach, "PLAIN", 1)
    arcs = shapes(seed)
    assert found(spark, arcs, [0]) == dijkstra(arcs, [0])
    assert found(spark, arcs, [0, arcs[9][1]], 20) == dijkstra(arcs, [0, arcs[9][1]], 20)
    ones = [(v, w, 1) for v, w, _ in arcs]
    assert {r.v: r.hops for r in reach.levels(*tables(spark, arcs, [0])).collect()} == dijkstra(ones, [0])


def test_start_in_the_middle_of_a_chain_and_on_a_cycle(spark, monkeypatch):
    monkeypatch.setattr(reach, "PLAIN", 1)
    arcs = [(i, i + 1, i) for i in range(20)] + [(30 + i, 30 + (i + 1) % 7, 1) for i in range(7)]
    for start in (0, 11, 20, 33, 99):
        assert found(spark, arcs, [start]) == dijkstra(arcs, [start])


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 100_000
    arcs = spark.range(n).selectExpr("id as v", "id + 1 as w", "id % 3 as n")
    start = spark.createDataFrame([(0,)], "v long")
    got = reach.distances(arcs, start, "n").selectExpr("count(*) as c", "max(dist) as m", "sum(dist) as s").first()
    assert (got.c, got.m) == (n + 1, sum(i % 3 for i in range(n)))
    assert len(rounds) <= 40


def test_a_long_chain_of_bubbles_takes_few_rounds(spark, rounds):
    n = 2_000
    arcs = [a for i in range(n) for a in ((3 * i, 3 * i + 1, 1), (3 * i, 3 * i + 2, 2), (3 * i + 1, 3 * i + 3, 1), (3 * i + 2, 3 * i + 3, 1))]
    got = found(spark, arcs, [0])
    assert len(got) == 3 * n + 1 and got[3 * n] == 2 * n and got[3 * n - 1] == 2 * n
    assert len(rounds) <= 60


def test_what_nothing_reaches_is_left_out_before_the_graph_is_contracted(spark, monkeypatch):
    """All twelve vertices are met in the first round and come nearer in twelve; a thousand others never are."""
    seen, contract = [], reach.contract
    monkeypatch.setattr(reach, "contract", lambda arcs, start: seen.append(arcs.count()) or contract(arcs, start))
    rows = [(0, i, 5 if i == 1 else 100) for i in range(1, 13)] + [(i, i + 1, 1) for i in range(1, 12)] + [(i, i + 1, 1) for i in range(1_000, 2_000)]
    arcs, start = spark.createDataFrame(rows, "v long, w long, n long"), spark.createDataFrame([(0,)], "v long")
    expected = {0: 0, **{i: 4 + i for i in range(1, 13)}}
    assert {r.v: r.dist for r in reach.distances(arcs, start, "n").collect()} == expected and seen == [23]
    assert {r.v: r.dist for r in reach.distances(arcs, start, "n", 9).collect()} == {v: d for v, d in expected.items() if d <= 9}
