"""Superbubbles: pairs of vertices between which the graph forks and comes together again, and nothing else enters or leaves.

All entrances are tried at once. From each a front moves on, as rows of entrance and
vertex: a vertex joins it when all that lead to it have been passed. When the front
is one vertex and nothing else has been seen that is not passed, that vertex is the
exit, and the nearest one. An entrance is given up where the front meets an end or
the entrance again, or where it can't move because something leads in from outside.

A bubble takes as many rounds as its longest way has arcs. Entrances that are not told
after some rounds go on, however large their bubbles are, but in a smaller graph:

- bubbles lie inside each other or apart, and no front ends inside one, so each that is
  found becomes one arc, which says how many vertices it stands for. What lies inside
  needs no more rounds than the bubble itself and is found by then;
- vertices with one way in and one way on vanish into arcs by pointer doubling, and
  parallel arcs become one. An arc that is the only one from its first vertex and the
  only one to its second is all that lies between them: a bubble if the first one forks.
  A vertex that vanishes and is no such entrance has an arc from elsewhere where its ways
  meet, so it is none at all.

Then twice as many rounds are tried, and so on until all entrances are told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, materialise
from .reach import SHARE, _compact, _union, doubled

#: Rounds before the graph is contracted for the first time.
ROUNDS = 32


def superbubbles(arcs: DataFrame, most: int | None = None) -> DataFrame:
    """entrance, exit, n (vertices between them) of all bubbles by arcs (v, w) whose entrance has two ways on at least; with
    most, of those with up to so many vertices, the entrance included and the exit not."""
    given = materialise(arcs.select("v", "w").distinct(), "bubble-given")
    left = given.where("v <> w").groupBy(F.col("v").alias("s")).agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("s")
    step, rounds, found = given.withColumn("n", F.lit(0).cast("long")), ROUNDS, []
    while True:
        # With each arc how many lead where it leads, so that a round joins no other large table.
        step = materialise(step.join(step.groupBy("w").agg(F.count(F.lit(1)).alias("needed")), "w").select("v", "w", "n", "needed"), "bubble-arcs")
        told, inside, left = _fronts(step, left, rounds)
        found.append(told)
        if left is None:
            break
        shorter = _replaced(step, told, inside)
        discard(step)
        step, left, more = _contracted(shorter, left)
        found, rounds = [*found, *more], 2 * rounds
    discard(step)
    # The exit must not lead back to the entrance.
    closed = given.select(F.col("v").alias("exit"), F.col("w").alias("entrance"))
    every = materialise(_union(found).join(closed, ["exit", "entrance"], "left_anti").select("entrance", "exit", "n"), "bubbles")
    discard(given)
    return every if most is None else every.where(F.col("n") < most)


def _fronts(step: DataFrame, entrances: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """entrance, exit, n of the bubbles with these entrances (s) that so many rounds tell; parts of what fronts have passed (s,
    v); and the entrances that are not told yet, None if all are."""
    live = materialise(entrances.select("s", F.col("s").alias("v"), F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("needed")), "bubble-seen")
    going = live.select("s", F.lit(0).cast("long").alias("passed"), F.lit(1).cast("long").alias("open"))
    trail, states = [], []
    for _ in range(rounds):
        moved = live.where("met = needed").select("s", "v").join(step, "v", "left")
        moved = materialise(moved.select("s", "v", "w", "n", "needed"), "bubble-moves")
        trail = _compact([*trail, moved.select("s", "v")])
        reached = moved.where("w is not null").select("s", F.col("w").alias("v"), F.lit(1).cast("long").alias("met"), "needed")
        seen = reached.unionByName(live.where("met < needed")).groupBy("s", "v").agg(F.sum("met").alias("met"), F.max("needed").alias("needed"))
        seen = materialise(seen, "bubble-seen")
        # Of each entrance: vertices passed, whether the front ran into an end or a circle, vertices that can be passed next and
        # all that were seen, and one of the former.
        none, zero, ready = F.lit(None).cast(step.schema["v"].dataType), F.lit(0).cast("long"), F.col("met") == F.col("needed")
        lost = F.col("w").isNull() | (F.col("w") == F.col("s"))
        counts = going.select("s", (F.col("passed") + F.col("open")).alias("passed"), F.lit(False).alias("lost"), zero.alias("open"), zero.alias("all"), none.alias("t"))
        counts = counts.unionByName(moved.select("s", F.coalesce("n", zero).alias("passed"), lost.alias("lost"), zero.alias("open"), zero.alias("all"), none.alias("t")))
        counts = counts.unionByName(seen.select("s", zero.alias("passed"), F.lit(False).alias("lost"), ready.cast("long").alias("open"), F.lit(1).cast("long").alias("all"), F.when(ready, F.col("v")).alias("t")))
        state = counts.groupBy("s").agg(F.sum("passed").alias("passed"), F.bool_or("lost").alias("lost"), F.sum("open").alias("open"), F.sum("all").alias("all"), F.max("t").alias("t"))
        state = materialise(state.where("not lost and open > 0").drop("lost"), "bubble-state")
        states, going = _compact([*states, state]), state.where("all > 1")
        if going.isEmpty():
            going = None
            break
        live = seen.join(going.select("s"), "s", "left_semi")
        going = going.select("s", "passed", "open")
    told = _union(states).where("open = 1 and all = 1").select(F.col("s").alias("entrance"), F.col("t").alias("exit"), (F.col("passed") - 1).alias("n"))
    return materialise(told, "bubbles"), trail, None if going is None else going.select("s")


def _replaced(step: DataFrame, told: DataFrame, trail: list[DataFrame]) -> DataFrame:
    """The arcs (v, w, n) with one arc in place of each bubble that lies in no other."""
    passed = _union(trail).join(told.select(F.col("entrance").alias("s")), "s", "left_semi")
    passed = materialise(passed.distinct(), "bubble-passed")
    # All that leads on from a bubble's entrance, or from inside, lies in the bubble.
    outside = step.select("v", "w", "n").join(passed.select("v").distinct(), "v", "left_anti")
    outer = told.join(passed.where("s <> v").select(F.col("v").alias("entrance")).distinct(), "entrance", "left_anti")
    return materialise(outside.unionByName(outer.select(F.col("entrance").alias("v"), F.col("exit").alias("w"), "n")), "bubble-arcs")


def _contracted(step: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Written arcs (v, w, n) to fewer, without vertices that have one way in and one way on; of the entrances left (s) those
    that are not told by that; and parts with the bubbles that are (entrance, exit, n)."""
    told = []
    while True:
        into = step.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("before"), F.min("v").alias("p"), F.min("n").alias("n"))
        out = step.groupBy("v").agg(F.count(F.lit(1)).alias("after"), F.min("w").alias("w"))
        both = materialise(into.join(out, "v", "full"), "bubble-degrees")
        # An only arc from its first vertex and to its second.
        sole = both.where("before = 1 and p <> v").select(F.col("p").alias("entrance"), F.col("v").alias("exit"), "n")
        sole = sole.join(both.where("after = 1").select(F.col("v").alias("entrance")), "entrance", "left_semi")
        told.append(materialise(sole.join(left.select(F.col("s").alias("entrance")), "entrance", "left_semi").select("entrance", "exit", "n"), "bubbles"))
        left = materialise(left.join(both.where("after > 1").select(F.col("v").alias("s")), "s", "left_semi"), "bubble-left")
        inner = both.where("before = 1 and after = 1 and p <> v")
        sizes = both.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.expr("before = 1 and after = 1 and p <> v")).alias("gone")).first()
        if sizes["gone"] < max(1, SHARE * sizes["all"]):
            discard(both)
            return step, left, told
        # A vertex's length from the one before is what the arc between them stands for, and itself.
        ways = doubled(materialise(inner.select("v", "p", (F.col("n") + 1).alias("n")), "bubble-inner"))
        moved = step.join(inner.select(F.col("v").alias("w")), "w", "left_anti").join(inner.select("v", F.lit(True).alias("inner")), "v", "left")
        moved = moved.join(ways.select("v", F.col("p").alias("__p"), F.col("n").alias("__n")), "v", "left")
        # Inner vertices that no way leads to are rings, which nothing enters or leaves.
        moved = moved.where("inner is null or __p is not null").select(F.coalesce("__p", "v").alias("v"), "w", (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"))
        step = materialise(moved.groupBy("v", "w").agg(F.sum("n").alias("n")), "bubble-arcs", step)
        discard(both)
