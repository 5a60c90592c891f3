"""The wavefront as relations: one row for each read, vertex and diagonal with its furthest offset.

A state (v, d, k) has matched the query up to d + k and the vertex up to k. One
score level is: extend along matches, cross to the next vertices at no cost,
then mismatch, insertion and deletion. Each step is a join, an aggregation or a
projection; align() loops over levels and writes the frontier each time.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import scan
from ..functions.sequences import common_extension
from ..sources.storage import materialise


def furthest(states: DataFrame, keys: list[str]) -> DataFrame:
    """Of each diagonal the state that reaches furthest."""
    return states.groupBy(*keys).agg(F.max("k").alias("k"))


def runs(states: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive diagonals: first, last, n."""
    numbered = scan(states, keys, ["d"], "sum", F.lit(1).cast("long"), "__n")
    marked = numbered.withColumn("__run", F.col("d") - F.coalesce("__n", F.lit(0)))
    return marked.groupBy(*keys, "__run").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def stencil(states: DataFrame, keys: list[str]) -> DataFrame:
    """The next level's k on each diagonal: insertion from d - 1, mismatch on d, deletion from d + 1."""
    moved = F.explode(F.array(F.struct((F.col("d") + 1).alias("d"), F.col("k")), F.struct("d", (F.col("k") + 1).alias("k")), F.struct((F.col("d") - 1).alias("d"), (F.col("k") + 1).alias("k"))))
    return furthest(states.select(*keys, moved.alias("m")).select(*keys, "m.d", "m.k"), [*keys, "d"])


def bounded(states: DataFrame, query_length: str, vertex_length: str) -> DataFrame:
    """States inside query and vertex."""
    return states.where((F.col("d") + F.col("k") < F.col(query_length)) & (F.col("k") < F.col(vertex_length)))


def kind(query_length: str, vertex_length: str) -> F.Column:
    """query_end, vertex_end or inside."""
    return F.when(F.col("d") + F.col("k") == F.col(query_length) - 1, "query_end").when(F.col("k") == F.col(vertex_length) - 1, "vertex_end").otherwise("inside")


def expand(states: DataFrame, arcs: DataFrame) -> DataFrame:
    """States at vertex ends along the arcs: they enter w behind its overlap, at the same place in the query."""
    out = states.join(arcs.select(F.col("v").alias("__v"), "w", "ow"), F.col("v") == F.col("__v"))
    place = F.col("d") + F.col("k")
    return out.select(*[c for c in states.columns if c not in ("v", "d", "k")], F.col("w").alias("v"), (place - F.col("ow") + 1).alias("d"), (F.col("ow") - 1).alias("k"))


def _extended(states: DataFrame) -> DataFrame:
    """Rows with q and t: k moved along matching characters."""
    more = common_extension(F.substr("t", F.col("k") + 2), F.substr("q", F.col("d") + F.col("k") + 2))
    return states.withColumn("k", F.col("k") + more)


def align(reads: DataFrame, vertices: DataFrame, arcs: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """read_idx, score of reads (read_idx, seq) against vertices (v, seq) and arcs (v, w, ow), by levels.

    For graphs too large to send about, and as a cross-check of the batched kernel: each level costs a few shuffles of
    the frontier, and there are as many as the largest distance. With end, walks must end at the end of that vertex; -1
    where none does.
    """
    queries = materialise(reads.select("read_idx", F.coalesce("seq", F.lit("")).alias("q")), "wavefront-reads")
    texts = vertices.select("v", F.col("seq").alias("t"))
    at_once = F.lit(end is None) & (F.col("q") == "")
    done = [materialise(queries.where(at_once).select("read_idx", F.lit(0).alias("score")), "wavefront-done")]
    frontier = queries.where(~at_once).select("read_idx", F.lit(start).cast("long").alias("v"), F.lit(0).alias("d"), F.lit(-1).alias("k"))
    keys = ["read_idx", "v", "d"]
    exhausted = None
    for score in itertools.count():
        level = None
        while not (frontier := materialise(frontier, "wavefront-new")).isEmpty():
            reached = materialise(_extended(frontier.join(queries, "read_idx").join(texts, "v")).select(*keys, "k", kind_of(end).alias("kind")), "wavefront-level")
            level = materialise(reached, "wavefront-all") if level is None else materialise(level.unionByName(reached), "wavefront-all", level)
            ends = reached.where("kind = 'vertex_end'")
            if exhausted is not None:
                ends = ends.join(exhausted, keys, "left_anti")
            ends = materialise(ends.select(*keys, "k").distinct(), "wavefront-ends")
            gone = ends.select(*keys)
            exhausted = materialise(gone, "wavefront-exhausted") if exhausted is None else materialise(exhausted.unionByName(gone), "wavefront-exhausted", exhausted)
            frontier = furthest(expand(ends, arcs), keys)
        if level is None:
            break
        finished = materialise(level.where("kind = 'query_end'").select("read_idx").distinct().withColumn("score", F.lit(score)), "wavefront-done")
        done.append(finished)
        open_states = furthest(level.join(finished, "read_idx", "left_anti"), keys)
        following = stencil(open_states, ["read_idx", "v"]).join(queries, "read_idx").join(texts, "v")
        frontier = following.where((F.col("k") < F.length("t")) & (F.col("d") + F.col("k") < F.length("q"))).select(*keys, "k")
        if exhausted is not None:
            # What stands at the end of a vertex goes on by insertions; what fell back behind one that was there is settled.
            frontier = frontier.join(exhausted.withColumn("__gone", F.lit(True)), keys, "left").where("__gone is null").select(*keys, "k")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    score = F.col("score") if end is None else F.coalesce("score", F.lit(-1))
    return queries.select("read_idx").join(found, "read_idx", "left").select("read_idx", score.alias("score"))


def kind_of(end: int | None = None) -> F.Column:
    """kind() for rows with texts q and t; with end, a query ends there only, at the vertex's end."""
    done = F.col("d") + F.col("k") == F.length("q") - 1
    if end is not None:
        done &= (F.col("v") == end) & (F.col("k") == F.length("t") - 1)
    return F.when(done, "query_end").when(F.col("k") == F.length("t") - 1, "vertex_end").otherwise("inside")
