"""Clustering with and without the VA-file."""

import hashlib

import numpy as np
import pytest

from seqgraph.llm import vafile
from seqgraph.llm.queries import QUERIES

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows):
    """Lloyd's rounds over all vectors, in Python's integers."""
    good = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    ordered = sorted(good, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x, centroids = np.array([v for _, v in good], object), [v for _, v in ordered[:8]]
    for at in range(11):
        d = np.array([((x - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], object)
        nearest = [min(range(len(centroids)), key=lambda c: (col[c], c)) for col in d.T]
        if at < 10:
            sums = [[x[i] for i, n in enumerate(nearest) if n == c] for c in range(len(centroids))]
            centroids = [[int(s) // len(own) for s in np.sum(own, axis=0)] if own else c for own, c in zip(sums, centroids, strict=True)]
    own = [int(d[n, i]) for i, n in enumerate(nearest)]
    of = {c: sum(o for o, n in zip(own, nearest, strict=True) if n == c) for c in set(nearest)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, o, of[n], sum(own), sha[n]) for (i, _), n, o in zip(good, nearest, own, strict=True)), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, path string")


def test_like_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(600)]
    rows += [(i, rows[7][1]) for i in range(600, 900)]  # one vector for a third
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, [0.0] * 64), (900, [0.5] * 63), (901, None), (902, [float("nan")] * 64), (903, [float("inf"), *[0.0] * 63]), (904, [None, *[0.0] * 63]), (905, [1e4, *[-1e4] * 63])]
    trace = []
    assert told(vafile.cluster(frame(spark, rows).repartition(7), trace=trace)) == plain(rows)
    assert trace[-1] < 450  # intervals decide most vectors when the centroids have settled


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), *[0.0] * 63]) for i in range(40)]
    assert told(vafile.cluster(frame(spark, rows))) == plain(rows)
    assert told(vafile.cluster(frame(spark, rows[:3]))) == plain(rows[:3])
    assert told(vafile.cluster(frame(spark, []))) == []
    with pytest.raises(Exception, match="beyond"):
        vafile.cluster(frame(spark, [(1, [1e30] * 64)])).collect()


def test_files_and_batches_of_any_size(spark):
    rng = np.random.default_rng(6)
    vectors = vafile.kept(frame(spark, [(i, rng.normal(size=64).tolist()) for i in range(100)]).coalesce(1))
    cuts = vafile.borders(vectors)
    files = vafile.write(vectors, cuts, file_rows=30, batch_rows=7)
    assert sorted(r.n for r in files.collect()) == [30, 35, 35]
    ends = vafile.extent(files)
    centroids = vafile.first_centroids(vectors)
    low, high = vafile.tables(centroids, cuts, ends)
    for r in files.collect():
        own = vafile.Vectors(r.path)
        for _, batch in own.parts():
            x = own.fetch(batch, np.arange(batch.num_rows))
            middle = np.median(centroids, axis=0).astype(np.int64)
            true = vafile.squared(x, centroids) - ((x - middle) ** 2).sum(axis=1)[:, None]
            assert (vafile.bounds(own.cells(batch), low) <= true).all() and (true <= vafile.bounds(own.cells(batch), high)).all()


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert told(QUERIES["op12_centroid_clustering"](spark, sf)) == plain(rows)
