"""Scoring against graphs that are too large to send about: shards of the graph, and states that travel between them.

Vertices are cut into shards of about SHARD bases in the order of their numbers, so
what was numbered together mostly lies together. In a superstep each shard takes the
states that entered it since the last one, of all reads at once, and moves them through
the score levels in arrays (align.propagate) until they end, leave or reach a limit.
What leaves is a row: read, vertex, diagonal, offset and score. A state enters again
only if its score is lower than all with which it entered before.

The limit is on scores and grows twofold from phase to phase; a phase begins anew with
the reads that are still open. All states up to the limit are seen in it, so a score
found is the least, and the phases before cost about as much as the last one. Supersteps
are as many as a best walk crosses from shard to shard, for each phase.

A task holds one shard and the reads of one share of those that enter it: reads at a
shard that many enter (the start's above all) are dealt over shares, to each of which
its part of the graph goes. Every superstep is written, so a lost executor costs a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import running
from ..sources.storage import discard, materialise
from . import align as kernel

#: Bases of a shard; each vertex counts as eight more. A longer vertex is a shard of its own.
SHARD = 8_000_000
#: Reads that a task takes.
READS = 4_096
#: Greatest score looked for in the first phase.
FIRST = 16

_OUT = "read_idx long, v long, d long, k long, score int"
#: What a row of a superstep tells if it is no state: the read's score in this shard, or that the limit stopped it.
_SCORE, _CUT = -1, -2


def sharded(vertices: DataFrame, arcs: DataFrame, bases: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Places v, shard; and the graph's rows shard, v, seq, w, ow: one for each vertex (w null) and each arc; both written."""
    sized = running(vertices.select("v", "seq"), ["v"], F.octet_length("seq") + 8, "__before")
    rows = materialise(sized.select("v", F.floor(F.col("__before") / bases).cast("int").alias("shard"), "seq"), "shard-vertices")
    places = rows.select("v", "shard")
    linked = arcs.select("v", "w", "ow").distinct().join(places, "v").select("shard", "v", F.lit(None).cast("string").alias("seq"), "w", "ow")
    own = rows.select("shard", "v", F.coalesce("seq", F.lit("")).alias("seq"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("int").alias("ow"))
    return places, materialise(own.unionByName(linked), "shard-graph")


def refuse(vertices: DataFrame, arcs: DataFrame) -> None:
    """Raises for vertices without sequence, and overlaps that cover their whole target."""
    if not vertices.where("seq is null").isEmpty():
        raise ValueError("a reachable segment has no sequence")
    if not arcs.join(vertices.select(F.col("v").alias("w"), F.octet_length("seq").alias("__n")), "w").where(F.col("ow") >= F.col("__n")).isEmpty():
        raise ValueError("an overlap covers its whole target vertex")


def _flat(rows: pa.Table, end: int | None) -> tuple[kernel.Flat, np.ndarray]:
    """A shard as arrays, and the vertices' numbers: its own in order, then those that arcs lead to outside."""
    is_arc = np.asarray(rows["w"].is_valid())
    own, links = rows.filter(pa.array(~is_arc)).sort_by("v"), rows.filter(pa.array(is_arc))
    ids, w = np.asarray(own["v"]), np.asarray(links["w"])
    outside = np.setdiff1d(w, ids)
    names = np.concatenate([ids, outside])
    order = np.argsort(names, kind="stable")
    at = lambda x: order[np.searchsorted(names, x, sorter=order)]
    table = np.stack([at(np.asarray(links["v"])), at(w), np.asarray(links["ow"]).astype(np.int64)], 1)
    last = None if end is None else int(np.searchsorted(ids, end)) if end in ids else -1
    return kernel.Flat([t.as_py().encode() for t in own["seq"]], table, 0, last), names


def _superstep(most: int, end: int | None):
    def run(entered: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if entered.num_rows and rows.num_rows:
            graph, names = _flat(rows, end)
            own = names[: len(graph.length)]
            for at in range(0, entered.num_rows, kernel.TOGETHER):
                batch = entered.slice(at, kernel.TOGETHER)
                reads = np.asarray(batch["read_idx"])
                states = batch["states"].combine_chunks()
                flat = states.flatten()
                v, d, k, score = (np.asarray(flat.field(c)).astype(np.int64) for c in ("v", "d", "k", "score"))
                r = np.repeat(np.arange(len(reads)), np.asarray(states.value_lengths()))
                found, cut, left = kernel.propagate(graph, [q.as_py().encode() for q in batch["q"]], r, np.searchsorted(own, v), d, k, score, most)
                out_r, out_v, out_d, out_k, out_score = left
                told = np.flatnonzero(found >= 0)
                stopped = np.flatnonzero(cut)
                fill = np.zeros(len(told) + len(stopped), np.int64)
                parts.append((
                    np.concatenate([reads[out_r], reads[told], reads[stopped]]),
                    np.concatenate([names[out_v], np.full(len(told), _SCORE), np.full(len(stopped), _CUT)]),
                    np.concatenate([out_d, fill]), np.concatenate([out_k, fill]),
                    np.concatenate([out_score, found[told], np.zeros(len(stopped), np.int64)]),
                ))
        columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [()] * 5)]
        return pa.table({n: pa.array(c.astype(np.int64 if n != "score" else np.int32)) for n, c in zip(("read_idx", "v", "d", "k", "score"), columns, strict=True)})

    return run


def _phase(queries: DataFrame, open_reads: DataFrame, places: DataFrame, graph: DataFrame, start: int, end: int | None, most: int) -> tuple[DataFrame, DataFrame]:
    """read_idx, score of the open reads that score at most so much; and read_idx of those that the limit stopped."""
    state = ["read_idx", "v", "d", "k"]
    entering = materialise(open_reads.select("read_idx", F.lit(start).cast("long").alias("v"), F.lit(0).cast("long").alias("d"), F.lit(-1).cast("long").alias("k"), F.lit(0).alias("score")), "shard-entering")
    known, told = entering, []
    while True:
        states = F.collect_list(F.struct("v", "d", "k", "score")).alias("states")
        met = entering.join(places, "v").groupBy("shard", "read_idx").agg(states)
        met = materialise(met, "shard-met")
        shares = materialise(met.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / READS).cast("int").alias("shares")), "shard-shares")
        dealt = met.join(shares, "shard").withColumn("share", F.pmod(F.xxhash64("read_idx"), F.col("shares")).cast("int")).join(queries, "read_idx").select("shard", "share", "read_idx", "q", "states")
        lent = graph.join(shares, "shard").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("shard", "share", "v", "seq", "w", "ow")
        step = dealt.groupBy("shard", "share").cogroup(lent.groupBy("shard", "share")).applyInArrow(_superstep(most, end), _OUT)
        step = materialise(step, "shard-step")
        discard(met)
        told.append(materialise(step.where("v < 0").groupBy("read_idx", "v").agg(F.min("score").alias("score")), "shard-told"))
        offers = step.where("v >= 0").groupBy(*state).agg(F.min("score").alias("score"))
        best = known.withColumnRenamed("score", "__best")
        # A read that has a score is not looked at for more than that.
        scored = told[0]
        for part in told[1:]:
            scored = scored.unionByName(part)
        bound = scored.where(F.col("v") == _SCORE).groupBy("read_idx").agg(F.min("score").alias("__bound"))
        fresh = offers.join(best, state, "left").where("__best is null or score < __best").join(bound, "read_idx", "left").where("__bound is null or score < __bound")
        entering = materialise(fresh.select(*state, "score"), "shard-entering")
        if entering.isEmpty():
            break
        known = materialise(known.unionByName(entering).groupBy(*state).agg(F.min("score").alias("score")), "shard-known")
        discard(step)
    found = scored.where(F.col("v") == _SCORE).groupBy("read_idx").agg(F.min("score").alias("score"))
    found = materialise(found, "shard-found")
    stopped = scored.where(F.col("v") == _CUT).select("read_idx").distinct().join(found, "read_idx", "left_anti")
    return found, materialise(stopped, "shard-open")


def score(reads: DataFrame, vertices: DataFrame, arcs: DataFrame, start: int, end: int | None = None, bases: int = SHARD) -> DataFrame:
    """read_idx, score of reads (read_idx, seq) against vertices (v, seq) and arcs (v, w, ow), all reachable from start.

    With end, walks must end at the end of that vertex; -1 where none does. read_idx must not repeat; a null read is
    empty. Same results as align.score_reads.
    """
    refuse(vertices, arcs)
    queries = materialise(reads.select(F.col("read_idx").cast("long").alias("read_idx"), F.coalesce("seq", F.lit("")).alias("q")), "shard-reads")
    places, graph = sharded(vertices, arcs, bases)
    open_reads, most, parts = queries.select("read_idx"), FIRST, []
    while not open_reads.isEmpty():
        found, open_reads = _phase(queries, open_reads, places, graph, start, end, most)
        parts.append(found)
        most *= 2
    scores = queries.select("read_idx", F.lit(None).cast("int").alias("score")).limit(0)
    for part in parts:
        scores = scores.unionByName(part)
    return queries.select("read_idx").join(scores, "read_idx", "left").select("read_idx", F.coalesce("score", F.lit(-1)).cast("int").alias("score"))
