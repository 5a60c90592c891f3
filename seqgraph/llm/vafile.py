"""Lloyd's clustering of integer vectors over a VA-file.

A VA-file keeps beside the vectors an approximation of each: for every
dimension the number of the cell, one of 256, that holds its component. In each
round a lookup table for each dimension and centroid gives the least and the
largest share of the squared distance that components of that cell can have;
summed over the dimensions they bound a vector's distance from every centroid.
Where one centroid's interval lies below all others the vector is assigned without
being looked at. Only where intervals overlap is the vector fetched and its
distances computed.

With 64 dimensions and centroids near to each other such intervals are wide: the
vector's own square is part of each, and as uncertain in all. So tables leave it
out, being the same for all centroids, and measure from the centroids' median, where
products are small. On sf0.1 sixteen cells leave 97 % of the vectors to be fetched
in this form, 64 cells 40 %, and 256 cells a share that `trace` tells.

Sums of a cluster are carried from round to round: a round fetches the vectors
that changed their cluster, and adds them here and takes them off there. So what
a round reads besides the approximation shrinks as the centroids settle. Sums and
distances are exact integers, so the result depends on no order.

Scale: vectors lie in Arrow files of fixed-size lists in the shared folder, at
most FILE_ROWS to a file, with a row of a written table for each, and are fetched
by position. A round is one job over that table: a task reads a file's approximation
and the assignment before, and returns the assignment after with sums for each
centroid and dimension; these are added up by Spark, and k times as many numbers as
dimensions reach the driver. No vector is shuffled.
A file that an unfinished attempt leaves is in no table and counts for nothing.

Cells are those of a bounded sample: borders of each dimension are quantiles of
the up to SAMPLE vectors with the smallest hash of their ids. They decide only how
often vectors are fetched, not the result.

Edge cases: null vectors, vectors of another size and those with a null, NaN or
infinite component are left out; repeated rows and rows of equal or null vec_id are
kept each (a null id hashes as empty; equal hashes are in order of the vectors);
ties go to the smaller centroid; with fewer than k vectors there are as many
centroids as vectors; an empty table gives an empty result; other columns are
ignored. Components beyond 2^26 after scaling raise, as squared distances would not
fit 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir
from .tokenfile import place

SIZE = 64
K = 8
ROUNDS = 10
SCALE = 1024.0
SEED = 3
CELLS = 256
SAMPLE = 20_000
FILE_ROWS = 1 << 18
#: Vectors of a batch of a file, and vectors whose bounds are computed at once.
BATCH = 4096
LARGEST = 1 << 26

FILES = "path string, n long, low array<int>, high array<int>"
ROUND = "path string, n long, clusters binary, fetched long, sums array<struct<cluster:int,dim:int,value:long>>"


def integers(vector: Column, size: int = SIZE) -> Column:
    """floor(SCALE * x) of each component, null for a vector that is left out."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when((F.size(x) == size) & ~F.exists(x, lambda v: F.coalesce(odd(v), F.lit(True))), F.transform(x, lambda v: F.floor(v * SCALE)))


def kept(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id, vector of integers."""
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), size).alias("vector")).where("vector is not null")
    large = F.exists("vector", lambda v: F.abs(v) > LARGEST)
    return found.withColumn("vector", F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("array<bigint>")).otherwise(F.col("vector")))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hashes."""
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    return np.array([r.vector for r in hashed.orderBy("h", "vector").limit(k).collect()], np.int64).reshape(-1, SIZE)


def borders(vectors: DataFrame) -> np.ndarray:
    """For each dimension, up to CELLS - 1 borders: a component is in the cell of the number of borders at or below it.

    Towards both ends they stand ever closer, so that an outlier makes no wide cell for others.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vector").limit(SAMPLE).select("vector").toArrow()  # SAMPLE rows
    sample = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
    n = len(sample)
    tails = 2 ** np.arange(max(1, n.bit_length() - 1))
    inner = np.linspace(0, n, CELLS - 2 * len(tails) + 1)[1:-1].astype(int)
    return np.sort(sample, axis=0)[np.unique(np.concatenate([tails, n - tails, inner]).clip(0, n - 1))].T.copy()


def _schema(size: int) -> pa.Schema:
    return pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int32(), size)), ("cells", pa.list_(pa.uint8(), size))])


def cells(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cells of each vector, a byte for each dimension."""
    own = np.empty(vectors.shape, np.uint8)
    for d, cut in enumerate(cuts):
        own[:, d] = np.searchsorted(cut, vectors[:, d], side="right")
    return own


def write(vectors: DataFrame, cuts: np.ndarray, file_rows: int = FILE_ROWS, batch_rows: int = BATCH) -> DataFrame:
    """Vectors and their cells into Arrow files; the table of files, itself written."""
    top = f"{shared_dir(vectors.sparkSession)}/vector-files-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = place(top)
        where.create_dir(folder, recursive=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"vectors-{uuid.uuid4().hex}.arrow"
            whole = pa.Table.from_batches(held)
            vector = whole["vector"].combine_chunks().flatten().to_numpy().astype(np.int32)
            approximate = cells(vector.reshape(-1, SIZE), cuts)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n) for x, n in ((vector, SIZE), (approximate, SIZE))]
            with where.open_output_stream(f"{folder}/{name}") as sink, pa.ipc.new_file(sink, _schema(SIZE)) as file:
                file.write_table(pa.Table.from_arrays([whole["vec_id"].combine_chunks(), *lists], schema=_schema(SIZE)), max_chunksize=batch_rows)
            square = vector.reshape(-1, SIZE)
            ends = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (square.min(axis=0), square.max(axis=0))]
            return pa.RecordBatch.from_arrays([pa.array([f"{top}/{name}"]), pa.array([len(whole)], pa.int64()), *ends], names=["path", "n", "low", "high"])

        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                held.append(part)
                size += part.num_rows
                if size >= file_rows:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return materialise(vectors.mapInArrow(run, FILES), "vector-files")


class Vectors:
    """A file of vectors: approximations whole, vectors by position."""

    def __init__(self, path: str):
        where, name = place(path)
        self.file = pa.ipc.open_file(pa.memory_map(name) if path.startswith(("file:", "/")) else where.open_input_file(name))
        self.fetched = 0

    def parts(self) -> Iterator[tuple[int, pa.RecordBatch]]:
        at = 0
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            yield at, batch
            at += batch.num_rows

    @staticmethod
    def cells(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("cells").flatten().to_numpy().reshape(-1, SIZE)

    def fetch(self, batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
        """Vectors of some rows: a view of the mapped file, of which only these rows are touched."""
        self.fetched += len(rows)
        return batch.column("vector").flatten().to_numpy().reshape(-1, SIZE)[rows].astype(np.int64)


def extent(files: DataFrame) -> np.ndarray:
    """The least and the largest component of each dimension."""
    ends = files.select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")).groupBy("dim").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    return np.array([[r.low, r.high] for r in sorted(ends.collect())], np.int64)  # SIZE rows


def tables(centroids: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension, cell and centroid: the least and the largest share of the squared distance, less the square
    of the vector itself, measured from the centroids' median. The outermost cells reach to the ends of their
    dimension.
    """
    middle = np.median(centroids, axis=0).astype(np.int64)
    low = (np.concatenate([ends[:, :1], cuts], 1) - middle[:, None])[:, :, None]
    high = (np.concatenate([cuts - 1, ends[:, 1:]], 1) - middle[:, None])[:, :, None]
    c = (centroids - middle).T[:, None, :]
    one, other = c * c - 2 * c * low, c * c - 2 * c * high
    return np.minimum(one, other), np.maximum(one, other)


def bounds(approximate: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(approximate), table.shape[2]), np.int64)
    for b in range(approximate.shape[1]):
        out += table[b][approximate[:, b]]
    return out


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector from each centroid."""
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], 1)


def assigned(own: Vectors, batch: pa.RecordBatch, centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector of a batch."""
    approximate = own.cells(batch)
    least, most = bounds(approximate, low), bounds(approximate, high)
    nearest = most.argmin(axis=1)
    rivals = least <= np.take_along_axis(most, nearest[:, None], 1)
    rivals[np.arange(len(nearest)), nearest] = False
    open_rows = np.flatnonzero(rivals.any(axis=1))
    if len(open_rows):
        nearest[open_rows] = squared(own.fetch(batch, open_rows), centroids).argmin(axis=1)
    return nearest


def _round(files: DataFrame, centroids: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> DataFrame:
    """files: path, n, clusters (a byte for each vector, null before the first round). The same with the clusters
    after, the vectors fetched, and what sums and counts (dim -1) have changed by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = tables(centroids, cuts, ends)
        k = len(centroids)
        for rows in batches:
            for path, n, before in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                old = np.full(n, k, np.uint8) if before is None else np.frombuffer(before, np.uint8)
                new, own = np.empty(n, np.uint8), Vectors(path)
                change = np.zeros((k + 1, SIZE + 1), np.int64)
                for at, batch in own.parts():
                    mine = slice(at, at + batch.num_rows)
                    new[mine] = assigned(own, batch, centroids, low, high)
                    moved = np.flatnonzero(new[mine] != old[mine])
                    if len(moved):
                        vectors = own.fetch(batch, moved)
                        for side, sign in ((new, 1), (old, -1)):
                            which = side[mine][moved]
                            for c in np.unique(which).tolist():
                                some = vectors[which == c]
                                change[c, :SIZE] += sign * some.sum(axis=0)
                                change[c, SIZE] += sign * len(some)
                told = [{"cluster": c, "dim": d if d < SIZE else -1, "value": int(change[c, d])} for c, d in np.argwhere(change[:k]).tolist()]
                kind = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("value", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([new.tobytes()], pa.binary()), pa.array([own.fetched], pa.int64()), pa.array([told], kind)], names=["path", "n", "clusters", "fetched", "sums"])

    return dealt(files.select("path", "n", "clusters")).mapInArrow(run, ROUND)


def dealt(files: DataFrame) -> DataFrame:
    """The rows of the table of files over the tasks at hand, by their paths."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 2, "path")


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, trace: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of rows (vec_id, embedding).

    trace, if given, gets the number of vectors that each round fetched.
    """
    spark = rows.sparkSession
    vectors = kept(rows)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    cuts = borders(vectors)
    files = write(vectors, cuts)
    ends, state = extent(files), files.withColumn("clusters", F.lit(None).cast("binary"))
    sums = np.zeros((len(centroids), SIZE + 1), dtype=object)
    for at in range(rounds + 1):
        state = materialise(_round(state, centroids, cuts, ends), "vector-clusters", state if at else None)
        if trace is not None:
            trace.append(state.agg(F.sum("fetched")).first()[0])
        if at == rounds:
            break
        # Of centroids and dimensions, a number each.
        for r in state.select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.dim").agg(F.sum("s.value").alias("value")).collect():
            sums[r.cluster, r.dim] += r.value
        centroids = np.array([[s // own[SIZE] for s in own[:SIZE]] if own[SIZE] else old.tolist() for own, old in zip(sums.tolist(), centroids, strict=True)], np.int64)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path, clusters in zip(*(c.to_pylist() for c in paths.columns), strict=True):
                which, own = np.frombuffer(clusters, np.uint8), Vectors(path)
                for start, batch in own.parts():
                    mine = which[start : start + batch.num_rows]
                    apart = own.fetch(batch, np.arange(batch.num_rows)) - centroids[mine]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(mine.astype(np.int32)), pa.array((apart**2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    placed = materialise(dealt(state.select("path", "clusters")).mapInArrow(told, "vec_id long, cluster int, distance long"), "vector-distances")
    inertia = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    names = {c: hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for c, own in enumerate(centroids.tolist())}
    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in names]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(names.values()).alias("centroid_sha256")
    )


def oracle(k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> str:
    """The same in DuckDB: every vector against every centroid, a few common tables a round. Doubles hold these integers."""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {size})",
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda v: floor({SCALE} * v)) AS x FROM e WHERE len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT x, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept) ORDER BY k LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := {square}, k := k)) AS m FROM kept, c{i} GROUP BY r)")
        if i < rounds:
            means = f"SELECT k, list(floor(s / n) ORDER BY d) AS mean FROM (SELECT m.k AS k, d, sum(v) AS s, count(*) AS n FROM (SELECT m, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM a{i}) GROUP BY ALL) GROUP BY k"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(mean, c) AS c FROM c{i} LEFT JOIN ({means}) USING (k))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(m.k AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = m.k"""
