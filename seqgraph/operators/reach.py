"""Reachability, distances and topological order from a start vertex.

A round relaxes the arcs of all vertices that have come nearer: a join and an
aggregation, whose result is written, so a lost executor costs one round at most.
Searches of a few rounds end so. Longer ones go through a contracted graph first,
so that rounds follow branching and not length:

- a vertex that has one predecessor and at most one successor adds nothing to the
  search but its own distance. Pointer doubling along predecessors finds for all
  such vertices at once the nearest one before them that stays, and the length to
  there, in as many rounds as the longest chain's length has binary digits;
- arcs are redrawn between the vertices that stay, of parallel ones the shortest.
  A bubble's two branches become one arc so, and its ends inner vertices of a longer
  chain: contraction goes on until few vertices vanish.

What is left is searched; distances of what vanished follow by one join for each
contraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, materialise

#: Rounds after which what they wrote is put together.
TOGETHER = 32
#: Rounds of a search before the graph is contracted.
PLAIN = 8
#: A contraction is worth its rounds if so large a share of the vertices vanishes.
SHARE = 0.1


def _union(parts: list[DataFrame]) -> DataFrame:
    """The rows of written parts: one scan of all their files, so a long chain of rounds stays one flat plan."""
    folders = sorted({f.rsplit("/", 1)[0] for p in parts for f in p.inputFiles()})
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*folders) if folders else parts[0]


def _compact(parts: list[DataFrame]) -> list[DataFrame]:
    """The same rows in one part when there are TOGETHER; the last one stays, it is the next frontier."""
    if len(parts) < TOGETHER:
        return parts
    return [materialise(_union(parts[:-1]).coalesce(8), "reach-parts"), parts[-1]]


def _search(arcs: DataFrame, start: DataFrame, most: int, rounds: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """v, dist over arcs (v, w, n), written ones, None if it takes more rounds than given; and the arcs that count.

    A round writes only what came nearer; the least of a vertex's rows is its distance so far. Once a round meets no new
    vertex, and none is known that lies too far, all that can be reached is known: of a search with given rounds, arcs from
    elsewhere are left out from then on, so what follows doesn't grow with them.
    """
    changed = materialise(start.select("v", F.lit(0).cast("long").alias("dist"), F.lit(True).alias("fresh")), "reach-best")
    parts, done, closed, beyond = [changed], 0, rounds is None, False
    while True:
        offers = changed.where(F.col("dist") <= most).join(arcs, "v").select(F.col("w").alias("v"), (F.col("dist") + F.col("n")).alias("offer"))
        offers = offers.groupBy("v").agg(F.min("offer").alias("offer"))
        best = _union(parts).groupBy("v").agg(F.min("dist").alias("dist"))
        nearer = offers.join(best, "v", "left").where("dist is null or offer < dist")
        changed = materialise(nearer.select("v", F.col("offer").alias("dist"), F.col("dist").isNull().alias("fresh")), "reach-changed")
        told = changed.agg(F.min("dist").alias("least"), F.max("dist").alias("most"), F.max("fresh").alias("fresh")).first()
        if told["least"] is None or told["least"] > most:
            return _union(parts).groupBy("v").agg(F.min("dist").alias("dist")).where(F.col("dist") <= most), arcs
        done += 1
        beyond |= told["most"] > most
        if not closed and not told["fresh"] and not beyond:
            closed = True
            arcs = materialise(arcs.join(_union(parts).select("v").distinct(), "v", "left_semi"), "reach-arcs", arcs)
        if rounds is not None and done >= rounds:
            return None, arcs
        parts = _compact([*parts, changed])


def doubled(links: DataFrame) -> DataFrame:
    """links: v, p (its predecessor), n (the length from there), a row for each v. For each v the first p on its way back
    that has no row itself (v, p, n with the length from there), written; vertices on or behind a cycle are left out.

    Each round looks from where a pointer points as far again, so rounds are logarithmic in the longest way. A round writes
    what it moved. While a way is left that ends, a round ends one; when none ended, all that go on lie on or behind a cycle.
    """
    ends = links.select(F.col("v").alias("p"), F.lit(True).alias("more"))
    last = materialise(links.join(ends, "p", "left").select("v", "p", "n", F.coalesce("more", F.lit(False)).alias("more")), "reach-ways")
    parts = [last]
    while not last.where("more").isEmpty():
        going = last.where("more")
        known = _union(parts).where("not more").unionByName(going)
        ahead = known.select(F.col("v").alias("p"), F.col("p").alias("__p"), F.col("n").alias("__n"), F.col("more").alias("__more"))
        # Only ways that go on are joined: of each vertex that they point to there is one row.
        further = going.drop("more").join(ahead, "p").select("v", F.col("__p").alias("p"), (F.col("n") + F.col("__n")).alias("n"), F.col("__more").alias("more"))
        last = materialise(further, "reach-ways")
        parts.append(last)
        if last.where("not more").isEmpty():
            break
    return _union(parts).where("not more").select("v", "p", "n")


def contract(arcs: DataFrame, start: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Written arcs (v, w, n) to fewer with the same distances from start (v) among the vertices that stay, and tables of
    those that vanished, in this order: v, p (a vertex that stayed then), n (its length from there)."""
    vanished = []
    while True:
        into = arcs.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("before"), F.min("v").alias("p"), F.min("n").alias("n"))
        out = arcs.groupBy("v").agg(F.count(F.lit(1)).alias("after"))
        both = materialise(into.join(out, "v", "full").join(start.select("v", F.lit(True).alias("first")), "v", "left"), "reach-degrees")
        inner = both.where("before = 1 and coalesce(after, 0) <= 1 and first is null")
        # What nothing leads to is never reached.
        unreached = both.where("before is null and first is null").select("v")
        sizes = both.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.expr("(before = 1 and coalesce(after, 0) <= 1 or before is null) and first is null")).alias("gone")).first()
        if sizes["gone"] < max(1, SHARE * sizes["all"]):
            discard(both)
            return arcs, vanished
        ways = doubled(materialise(inner.select("v", "p", "n"), "reach-inner"))
        kept = arcs.join(unreached, "v", "left_anti").join(inner.select(F.col("v").alias("w")), "w", "left_anti")
        moved = kept.join(ways.select("v", F.col("p").alias("__p"), F.col("n").alias("__n")), "v", "left").select(F.coalesce("__p", "v").alias("v"), "w", (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"))
        # An inner vertex that no way leads to lies on or behind a cycle of such vertices, which nothing enters.
        moved = moved.join(inner.select("v"), "v", "left_anti")
        arcs = materialise(moved.where("v <> w").groupBy("v", "w").agg(F.min("n").alias("n")), "reach-arcs", arcs)
        vanished.append(ways)
        discard(both)


def distances(arcs: DataFrame, start: DataFrame, length: str, most: int = 1 << 30) -> DataFrame:
    """v, dist: shortest sum of arc lengths (column length, none below 0) from start (v), up to most."""
    first = materialise(start.select("v").distinct(), "reach-start")
    step = materialise(arcs.where("v <> w").groupBy("v", "w").agg(F.min(F.col(length).cast("long")).alias("n")), "reach-arcs")
    found, step = _search(step, first, most, PLAIN)
    if found is not None:
        discard(step)
        return found
    step, vanished = contract(step, first)
    found, _ = _search(step, first, most)
    for ways in reversed(vanished):
        more = ways.join(found.select(F.col("v").alias("p"), "dist"), "p").select("v", (F.col("dist") + F.col("n")).alias("dist")).where(F.col("dist") <= most)
        found = materialise(found.unionByName(more), "reach-found")
    discard(step)
    return found


def levels(arcs: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """v, hops: vertices reachable from start (v), with the fewest arcs on the way; with most, up to so many arcs."""
    found = distances(arcs.select("v", "w", F.lit(1).alias("n")), start, "n", (1 << 62) if most is None else most)
    return found.select("v", F.col("dist").cast("int").alias("hops"))


def subgraph(arcs: DataFrame, reached: DataFrame) -> DataFrame:
    """Arcs with both ends among reached (v)."""
    kept = reached.select("v").distinct()
    return arcs.join(kept, "v", "left_semi").join(kept.withColumnRenamed("v", "w"), "w", "left_semi")


def topological(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, layer: the longest number of arcs on a way to v; null for vertices on or behind a cycle.

    Peels all vertices without open incoming arcs at once, so the rounds are as many as layers.
    """
    left = materialise(arcs.select("v", "w").distinct(), "topological-arcs")
    waiting = materialise(vertices.select("v").distinct(), "topological-waiting")
    done, layer = [], 0
    while True:
        free = materialise(waiting.join(left.select(F.col("w").alias("v")).distinct(), "v", "left_anti").withColumn("layer", F.lit(layer)), "topological-layer")
        if free.isEmpty():
            break
        done.append(free)
        waiting = materialise(waiting.join(free, "v", "left_anti"), "topological-waiting", waiting)
        left = materialise(left.join(free.select("v"), "v", "left_anti"), "topological-arcs", left)
        layer += 1
    rest = waiting.withColumn("layer", F.lit(None).cast("int"))
    return _union(done).unionByName(rest) if done else rest
