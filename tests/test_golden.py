"""Known distances on two graphs that are not part of this repository: GOLDEN_GRAPHS names a folder that holds them."""

import glob
import os
import random

import pytest

from seqgraph.operators import align as A
from seqgraph.operators import graph as G

#: By number of segments; the queries are those of mutated() and others(), in this order.
SCORES = {
    80: [0, 3, 9, 21, 4, 18, 46, 7, 42, 87, 35, 37, 10, 0, 0, 0, 1, 5, 27, 0],
    820: [0, 3, 9, 21, 4, 18, 45, 7, 42, 88, 99, 39, 10, 0, 0, 0, 1, 5, 30, 0, 54, 234, 485, 0],
}


def changed(text, rate):
    rng, out = random.Random(42), []
    for c in text:
        x = rng.random()
        if x < rate / 3:
            out.append(rng.choice([b for b in "ACGT" if b != c]))
        elif x >= 2 * rate / 3:
            out.append(c + rng.choice("ACGT") if x < rate else c)
    return "".join(out)


def mutated(path, lengths):
    return [changed(path[:n], e) for n in lengths for e in (0.01, 0.05, 0.10)]


def others(path):
    return [path[100:300], "T" * 50, "N" * 10, path[:1], path[:31], path[:32], path[:20] + path[21:50], path[5:60], path[::-1][:60], ""]


def walks(file):
    """What the paths of a graph's file spell; where there is none, the way along each segment's first link."""
    text, first, found = {}, {}, []
    for line in open(file):
        f = line.rstrip("\n").split("\t")
        if f[0] == "S":
            text[f[1]] = f[2]
        elif f[0] == "L":
            first.setdefault(f[1], f[3])
        elif f[0] == "P":
            found.append([x[:-1] for x in f[2].split(",")])
        elif f[0] == "W":
            found.append(f[6].split(">")[1:])
    if not found:
        way = [next(iter(text))]
        while way[-1] in first:
            way.append(first[way[-1]])
        found.append(way)
    return len(text), ["".join(text[s] for s in way) for way in found]


FILES = glob.glob(f"{os.environ['GOLDEN_GRAPHS']}/**/*.gfa", recursive=True) if os.environ.get("GOLDEN_GRAPHS") else []


@pytest.mark.skipif(not FILES, reason="GOLDEN_GRAPHS is not set")
@pytest.mark.parametrize("file", FILES)
def test_known_distances(spark, file):
    size, spelled = walks(file)
    path = spelled[0]
    queries = [path, *mutated(path, (200, 500, 1000)), *others(path)] + (mutated(path, (5000,)) + spelled[1:] if len(spelled) > 1 else [])
    reads = spark.createDataFrame(list(enumerate(queries)), "read_idx long, seq string")
    found = A.graph_edit_distance(reads, G.read_gfa(spark, f"file://{file}")).orderBy("read_idx").collect()
    assert [r.score for r in found] == SCORES[size]
