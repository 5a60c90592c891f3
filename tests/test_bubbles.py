"""Superbubbles by their definition on random graphs."""

import random

import pytest

from seqgraph.operators import bubbles
from seqgraph.plans import derived
from seqgraph.plans.queries import QUERIES


def by_definition(arcs, most=1_000):
    """Entrance to exit: what the entrance reaches without the exit is what reaches the exit without the entrance, has no
    cycle, and no vertex of it would do as a nearer exit."""
    out, into = {}, {}
    for v, w in arcs:
        out.setdefault(v, set()).add(w)
        into.setdefault(w, set()).add(v)

    def reach(start, ways, stop):
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            for w in ways.get(v, ()) if v != stop else ():
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    def acyclic(inside, s, t):
        left, edges = set(inside), {(v, w) for v in inside for w in out.get(v, ()) if w in inside}
        if any(v == t or w == s for v, w in edges):
            return False
        while free := {v for v in left if not any(w == v and u in left for u, w in edges)}:
            left -= free
        return not left

    found = {}
    for s in out:
        if len(out[s] - {s}) < 2:
            continue
        exits = [t for t in reach(s, out, None) - {s} if (u := reach(s, out, t)) == reach(t, into, s) and acyclic(u, s, t)]
        exits = [(len(reach(s, out, t)) - 2, t) for t in exits]
        if exits and min(exits)[0] + 1 <= most:
            found[s] = min(exits)[::-1]
    return found


def random_arcs(seed):
    rng, arcs, v, at = random.Random(seed), set(), 0, 1
    for _ in range(9):
        kind, join = rng.randint(0, 5), at
        at += 1
        if kind < 3:  # two or three ways, one perhaps straight
            for k in range(rng.randint(2, 3)):
                if k == 0 and rng.random() < 0.5:
                    arcs.add((v, join))
                    continue
                way = list(range(at, at + rng.randint(1, 3)))
                at = way[-1] + 1
                arcs |= set(zip([v, *way], [*way, join], strict=True))
                if rng.random() < 0.3:
                    arcs.add((way[0], join))
        else:
            arcs.add((v, join))
        if kind == 4:  # a tip, or a way in from outside
            arcs.add((join, at) if rng.random() < 0.5 else (at, join))
            at += 1
        if kind == 5:
            arcs.add((join, rng.randrange(at)))
        v = join
    return sorted(arcs)


@pytest.mark.parametrize("seed", range(4))
def test_like_the_definition(spark, seed):
    arcs = random_arcs(seed)
    found = bubbles.superbubbles(spark.createDataFrame(arcs, "v long, w long")).collect()
    assert {r.entrance: (r.exit, r.n) for r in found} == by_definition(arcs)


def test_nested_and_large_ones(spark):
    arcs = [(0, 1), (0, 9), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 5), (5, 6), (5, 7), (6, 8), (7, 8), (8, 8)]
    own = spark.createDataFrame(arcs, "v long, w long")
    assert {r.entrance: (r.exit, r.n) for r in bubbles.superbubbles(own).collect()} == by_definition(arcs) == {0: (5, 5), 1: (4, 2)}
    assert {r.entrance: r.exit for r in bubbles.superbubbles(own, 3).collect()} == {1: 4}


def test_the_query(spark, sf):
    arcs = [(r.v, r.w) for r in derived.order_arcs(spark, sf).collect()]
    found = {r.entrance: (r.exit, r.n) for r in QUERIES["superbubbles"](spark, sf).collect()}
    assert found == by_definition(arcs) and len(found) > 100


def test_a_bubble_of_many_ways(spark):
    arcs = [a for v in range(1, 1_201) for a in ((0, v), (v, 1_201))]
    assert [tuple(r) for r in bubbles.superbubbles(spark.createDataFrame(arcs, "v long, w long")).collect()] == [(0, 1_201, 1_200)]


def test_a_bubble_of_long_ways(spark, monkeypatch):
    """One way is 1,500 vertices, the other three bubbles within each other; it takes a few rounds nevertheless."""
    monkeypatch.setattr(bubbles, "ROUNDS", 2)
    written, old = [], bubbles.materialise
    monkeypatch.setattr(bubbles, "materialise", lambda df, name, *rest: written.append(name) or old(df, name, *rest))
    way = [0, *range(1_000, 2_500), 1]
    arcs = list(zip(way, way[1:], strict=False)) + [(0, 10), (10, 11), (10, 12), (12, 13), (12, 14), (14, 15), (14, 16), (15, 17), (16, 17), (17, 18), (13, 18), (18, 19), (11, 19), (19, 1)]
    found = {r.entrance: (r.exit, r.n) for r in bubbles.superbubbles(spark.createDataFrame(arcs, "v long, w long")).collect()}
    assert found == {14: (17, 2), 12: (18, 5), 10: (19, 8), 0: (1, 1_510)} and len(written) < 60


@pytest.mark.parametrize("rounds", [1, 2])
def test_contracted_graphs_have_the_same_bubbles(spark, monkeypatch, rounds):
    """Random graphs beside each other, whose bubbles need more rounds than are tried before each contraction."""
    monkeypatch.setattr(bubbles, "ROUNDS", rounds)
    arcs, expected = [], {}
    for seed in range(60):
        rng, at = random.Random(seed), 1_000 * seed
        own = random_arcs(seed)
        if seed % 3 == 1:  # few vertices and any arcs, circles and arcs to themselves too
            own = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randint(5, 12))})
        elif seed % 3 == 2:  # arcs that go forward, most of them not far
            own = sorted({(v, min(14, v + rng.choice([1, 1, 2, 3]))) for v in rng.choices(range(14), k=26)})
        arcs += [(at + v, at + w) for v, w in own]
        expected |= {at + s: (at + t, n) for s, (t, n) in by_definition(own).items()}
    found = [(r.entrance, (r.exit, r.n)) for r in bubbles.superbubbles(spark.createDataFrame(arcs, "v long, w long")).collect()]
    assert sorted(found) == sorted(expected.items()) and len(found) > 50
