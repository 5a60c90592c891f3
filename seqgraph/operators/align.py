"""Edit distance of reads against a sequence graph.

score(q) is the least edit distance between the whole query and a prefix of
what some walk from the start vertex spells. Reads are independent, so they are
dealt out evenly and scored many at a time: a batch's states (read, vertex,
diagonal, offset) move through the score levels together as arrays. The graph goes
to the executors once, and is cut first to what these reads can reach.

A score is at most the read's length, for inserting the whole read at the start is
one way. So a best walk spells at most twice as many characters as the longest read
has, and vertices that are entered behind that play no part, however large the graph.
With a fixed end the bound is the shortest walk to it instead, where that is longer.
The cut is a search for distances, by joins; only its result is looked at in one
place. Where even that holds more than MOST_BASES, the graph is cut into shards between
which the states travel (shards.score).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import BASES, PAIRED, reverse_complement, segment_of, strand_of
from ..sources.storage import materialise
from . import reach
from .graph import SequenceGraph

#: Largest graph that is looked at in one place and sent to the executors: bases, and eight for each arc and segment.
MOST_BASES = 64_000_000
#: Reads whose states move together.
TOGETHER = 256
STEP = 64


class Flat:
    """The graph as arrays: texts end to end, arcs by vertex."""

    def __init__(self, texts: list[bytes], arcs: list[tuple[int, int, int]] | np.ndarray, start: int, end: int | None = None):
        """arcs: from, to (outside if there is no such text), overlap in the target. end: the vertex at whose end a walk must
        end, if any."""
        self.length = np.array([len(t) for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.text = np.frombuffer(b"".join(texts) + bytes(STEP + 1), np.uint8)
        table = np.asarray(arcs, np.int64).reshape(-1, 3)
        table = table[np.lexsort(table.T[::-1])]
        within = table[table[:, 1] < len(texts)]
        if (within[:, 2] >= self.length[within[:, 1]]).any():
            raise ValueError("an overlap covers its whole target vertex")
        self.first = np.searchsorted(table[:, 0], np.arange(len(texts) + 1))
        self.to, self.over, self.start, self.end = table[:, 1], table[:, 2], start, end


def _last_of(key: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their largest k."""
    order = np.lexsort((k, key))
    key, k = key[order], k[order]
    last = np.append(key[1:] != key[:-1], True)[: len(key)]
    return key[last], k[last]


def _among(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def scores(graph: Flat, queries: list[bytes]) -> np.ndarray:
    """Of each query; all levels of all queries at once."""
    each = np.arange(len(queries))
    none = np.zeros(len(queries), np.int64)
    return propagate(graph, queries, each, none + graph.start, none, none - 1, none)[0]


def propagate(graph: Flat, queries: list[bytes], r: np.ndarray, v: np.ndarray, d: np.ndarray, k: np.ndarray, at: np.ndarray, most: int = 1 << 60) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """States (query r, vertex v, diagonal d, offset k), each from its level (at) on, moved through all levels up to most.

    Of each query the level at which it ended (-1 if it did not) and whether the limit stopped it; and the states that
    left the graph, with their levels: r, v, d, k, level. Vertices numbered beyond the graph's are outside.
    """
    length = np.array([len(q) for q in queries], np.int64)
    place = np.concatenate([[0], np.cumsum(length)])[:-1]
    text = np.frombuffer(b"".join(queries) + bytes(STEP + 1), np.uint8)
    score, cut = np.full(len(queries), -1), np.zeros(len(queries), bool)
    n = len(graph.length)
    span = int(length.max(initial=0)) + int(graph.length.max(initial=0)) + 2  # diagonals of a vertex
    shift = int(graph.length.max(initial=0)) + 1
    wide = np.arange(1, STEP + 1)

    def pack(r, v, d):
        return (r * n + v) * span + d + shift

    def unpack(key):
        rv, d = np.divmod(key, span)
        r, v = np.divmod(rv, n)
        return r, v, d - shift

    def extend(r, v, d, k):
        """k moved along matching characters, STEP at a time for those that still match."""
        room = np.minimum(graph.length[v] - k, length[r] - d - k) - 1
        moved, active = np.zeros(len(k), np.int64), np.flatnonzero(room > 0)
        while len(active):
            a, b = graph.offset[v[active]] + k[active] + moved[active], place[r[active]] + d[active] + k[active] + moved[active]
            same = graph.text[np.minimum(a[:, None] + wide, len(graph.text) - 1)] == text[np.minimum(b[:, None] + wide, len(text) - 1)]
            run = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
            moved[active] = np.minimum(moved[active] + run, room[active])
            active = active[(run == STEP) & (moved[active] < room[active])]
        return k + moved

    def finished(r, v, d, k):
        done = d + k == length[r] - 1
        return done if graph.end is None else done & (v == graph.end) & (k == graph.length[v] - 1)

    order = np.argsort(at, kind="stable")
    waiting, waiting_k, at = pack(r, v, d)[order], k[order], at[order]
    taken, level = 0, 0
    key, k = waiting[:0], waiting_k[:0]
    ended = np.zeros(0, np.int64)  # keys of diagonals that have reached their vertex's end
    left = []
    while len(key) or taken < len(at):
        level = level if len(key) else int(at[taken])
        if level > most:
            cut[unpack(waiting[taken:])[0]] = True
            break
        due = int(np.searchsorted(at, level, side="right"))
        if due > taken:
            fresh = waiting[taken:due]
            free = ~_among(ended, fresh) & (score[unpack(fresh)[0]] < 0)
            key, k = _last_of(np.concatenate([key, fresh[free]]), np.concatenate([k, waiting_k[taken:due][free]]))
            taken = due
        every_key, every_k = [key[:0]], [k[:0]]
        while len(key):
            r, v, d = unpack(key)
            k = extend(r, v, d, k)
            every_key.append(key)
            every_k.append(k)
            done = r[finished(r, v, d, k)]
            score[done[score[done] < 0]] = level
            at_end = (k == graph.length[v] - 1) & (score[r] < 0)
            at_end &= ~_among(ended, key)
            ended = np.insert(ended, np.searchsorted(ended, key[at_end]), key[at_end])
            r, v, place_in = r[at_end], v[at_end], (d + k)[at_end]
            fan = graph.first[v + 1] - graph.first[v]
            arc = np.repeat(graph.first[v] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            to, over = graph.to[arc], graph.over[arc]
            r, d, k = np.repeat(r, fan), np.repeat(place_in, fan) - over + 1, over - 1
            out = to >= n
            if out.any():
                left.append((r[out], to[out], d[out], k[out], np.full(out.sum(), level)))
            key, k = _last_of(pack(r, to, d)[~out], k[~out])
        key, k = _last_of(np.concatenate(every_key), np.concatenate(every_k))
        r, v, d = unpack(key)
        going = score[r] < 0
        r, v, d, k = r[going], v[going], d[going], k[going]
        r, v = np.tile(r, 3), np.tile(v, 3)
        d, k = np.concatenate([d + 1, d, d - 1]), np.concatenate([k, k + 1, k + 1])
        inside = (k < graph.length[v]) & (d + k < length[r])
        key, k = _last_of(pack(r, v, d)[inside], k[inside])
        fresh = ~_among(ended, key)
        key, k = key[fresh], k[fresh]
        level += 1
        if level > most and len(key):
            cut[unpack(key)[0]] = True
            key, k = key[:0], k[:0]
    none = np.zeros(0, np.int64)
    return score, cut, tuple(map(np.concatenate, zip(*left, strict=True))) if left else (none,) * 5


def spelled(arcs: DataFrame, segments: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """v, dist: how many characters the shortest walk from start to the end of v spells behind the start vertex."""
    first = segments.select(F.lit(start).cast("long").alias("v")).limit(1)
    sized = arcs.join(segments.select(F.col("seg_id"), F.octet_length("seq").alias("__n")), segment_of("w") == F.col("seg_id"))
    return reach.distances(sized.select("v", "w", F.greatest(F.coalesce(F.col("__n") - F.col("ow"), F.lit(0)), F.lit(0)).alias("n")), first, "n", (1 << 62) if most is None else max(most, 0))


def within(arcs: DataFrame, segments: DataFrame, start: int, radius: int) -> DataFrame:
    """v: start, and the vertices that walks enter before they have spelled radius characters."""
    own = segments.where(F.col("seg_id") == start >> 1).agg(F.max(F.octet_length("seq"))).first()[0] or 0
    near = spelled(arcs, segments, start, radius - own - 1).select("v") if radius > own else segments.select(F.lit(start).cast("long").alias("v")).limit(1)
    if radius <= own:
        return near
    near = materialise(near, "align-near")
    return near.unionByName(arcs.join(near, "v", "left_semi").select(F.col("w").alias("v"))).distinct()


def oriented(graph: SequenceGraph, start: int, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, seq) and arcs (v, w, ow) reachable from start, in reading direction; both written. radius: only what
    walks enter before they have spelled so many characters."""
    every = materialise(graph.arcs.select("v", "w", "ow"), "align-arcs")
    if radius is None:
        reached = reach.levels(every, graph.segments.select(F.lit(start).cast("long").alias("v")).limit(1)).select("v")
    else:
        reached = materialise(within(every, graph.segments, start, radius), "align-within")
    met = reached.join(graph.segments.select("seg_id", "seq"), segment_of("v") == F.col("seg_id"))
    vertices = met.select("v", F.when(strand_of("v") == 1, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))
    return materialise(vertices, "align-vertices"), materialise(reach.subgraph(every, reached), "align-reached").select("v", "w", "ow")


def find_start(graph: SequenceGraph, name: str | None = None, strand: int = 0) -> int:
    """The vertex of a segment's name, by default the one numbered first."""
    rows = graph.segments.where(F.col("name") == name) if name is not None else graph.segments
    first = rows.agg(F.min("seg_id")).first()[0]
    if first is None:
        raise ValueError(f"no segment named {name}" if name is not None else "the graph has no segment")
    return first * 2 + strand


def flat(vertices: DataFrame, arcs: DataFrame, start: int, end: int | None = None) -> Flat | None:
    """The graph as arrays, or None if it is too large to send about."""
    size = vertices.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)), F.count(F.lit(1)), F.count("seq")).first()
    if size[1] != size[2]:
        raise ValueError("a reachable segment has no sequence")
    if size[0] > MOST_BASES or arcs.count() > MOST_BASES // 8:
        return None
    rows, links = vertices.orderBy("v").toArrow(), arcs.distinct().toArrow()
    ids = np.asarray(rows["v"])
    place = lambda v: int(np.searchsorted(ids, v)) if v in ids else -1
    table = np.stack([np.searchsorted(ids, np.asarray(links[c])) for c in ("v", "w")] + [np.asarray(links["ow"])], 1)
    return Flat([t.as_py().encode() for t in rows["seq"]], table, place(start), None if end is None else place(end))


def small_flat(graph: SequenceGraph, start: int, end: int | None = None) -> Flat | None:
    """What is reachable from start as arrays, or None if the whole graph is too large to look at in one place. Of a small
    graph this is the quicker way: without a job for each hop."""
    segments = materialise(graph.segments.select("seg_id", "seq"), "align-segments")
    every = materialise(graph.arcs.select("v", "w", "ow").distinct(), "align-arcs")
    if (segments.agg(F.sum(F.length("seq"))).first()[0] or 0) + 8 * (every.count() + segments.count()) > MOST_BASES:
        return None
    rows, links = segments.orderBy("seg_id").toArrow(), every.orderBy("v").toArrow()
    v, w, over = (np.asarray(links[c]) for c in ("v", "w", "ow"))
    reached = frontier = np.array([start])
    while len(frontier):
        first, last = np.searchsorted(v, frontier), np.searchsorted(v, frontier, side="right")
        out = np.unique(w[np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])]) if (last > first).any() else frontier[:0]
        frontier = np.setdiff1d(out, reached, assume_unique=True)
        reached = np.union1d(reached, frontier)
    kept = np.isin(v, reached)
    table = np.stack([np.searchsorted(reached, v[kept]), np.searchsorted(reached, w[kept]), over[kept]], 1)
    ids, texts = np.asarray(rows["seg_id"]), rows["seq"]
    own = [texts[int(i)].as_py() for i in np.searchsorted(ids, reached >> 1)]
    if None in own:
        raise ValueError("a reachable segment has no sequence")
    pairs = str.maketrans(BASES, PAIRED)
    spelled = [(t.translate(pairs)[::-1] if x & 1 else t).encode() for t, x in zip(own, reached.tolist(), strict=True)]
    place = lambda x: int(np.searchsorted(reached, x)) if x in reached else -1
    return Flat(spelled, table, place(start), None if end is None else place(end))


def score_reads(reads: DataFrame, graph: Flat | None) -> DataFrame:
    """read_idx, score. Works on streams too.

    Scoring a read costs far more than moving it, so equal reads are scored once, and the texts are dealt out evenly
    first, wherever they were read. A stream's reads are scored each.
    """
    if graph is None:
        raise ValueError("the graph is too large to send about; shards.score takes any")
    spark = reads.sparkSession
    shared = spark.sparkContext.broadcast(graph)
    rows = reads.select(F.col("read_idx").cast("long").alias("read_idx"), F.coalesce("seq", F.lit("")).alias("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = scores(shared.value, [q.encode() for q in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.int32))], names=[part.schema.names[0], "score"])

    if reads.isStreaming:
        return rows.mapInArrow(run, "read_idx long, score int")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = rows.select("seq").distinct().repartition(tasks, "seq")
    scored = texts.select("seq", F.col("seq").alias("text")).mapInArrow(run, "seq string, score int")
    return rows.join(scored, "seq").select("read_idx", "score")


def needed_radius(reads: DataFrame, graph: SequenceGraph, start: int, end: int | None = None) -> int:
    """How many characters a walk may have spelled where a best one enters its last vertex; see above."""
    longest = reads.agg(F.max(F.octet_length("seq"))).first()[0] or 0
    if end is None:
        return 2 * longest
    arcs = materialise(graph.arcs.select("v", "w", "ow"), "align-arcs")
    own = graph.segments.where(F.col("seg_id") == start >> 1).agg(F.max(F.octet_length("seq"))).first()[0] or 0
    there = spelled(arcs, graph.segments, start).where(F.col("v") == end).first()
    return longest + max(longest, own + (there.dist if there else 0))


def graph_edit_distance(reads: DataFrame, graph: SequenceGraph, start: str | None = None, strand: int = 0, end: str | None = None, radius: int | None = None) -> DataFrame:
    """read_idx, score of reads (read_idx, seq) against what is reachable from the start segment.

    With end, walks must end at the end of that segment, forward; -1 where none does. radius: only vertices that walks
    enter before they have spelled so many characters; by default as far as these reads can tell a difference.
    """
    first = find_start(graph, start, strand)
    last = None if end is None else find_start(graph, end)
    own = small_flat(graph, first, last) if radius is None else None
    if own is None:
        if radius is None and not reads.isStreaming:
            radius = needed_radius(reads, graph, first, last)
        vertices, arcs = oriented(graph, first, radius)
        own = flat(vertices, arcs, first, last)
        if own is None:
            from . import shards

            if reads.isStreaming:
                raise ValueError("a stream of reads needs a graph that can be sent about")
            return shards.score(reads, vertices, arcs, first, last)
    return score_reads(reads, own)


def projection(graph: SequenceGraph, start: str | None = None, radius: int | None = None) -> DataFrame:
    """The reachable part as GFA lines, in one strand and with new numbers by vertex. radius: as in oriented()."""
    first = find_start(graph, start)
    vertices, arcs = oriented(graph, first, radius)
    from ..functions.numbering import numbered

    ids = numbered(vertices, ["v"], "id").select("v", "id", "seq")
    s = ids.select(F.concat_ws("\t", F.lit("S"), "id", "seq", F.concat(F.lit("LN:i:"), F.length("seq"))).alias("line"))
    ends = arcs.join(ids.select("v", F.col("id").alias("a")), "v").join(ids.select(F.col("v").alias("w"), F.col("id").alias("b")), "w")
    return s.unionByName(ends.select(F.concat_ws("\t", F.lit("L"), "a", F.lit("+"), "b", F.lit("+"), F.concat("ow", F.lit("M"))).alias("line")))
