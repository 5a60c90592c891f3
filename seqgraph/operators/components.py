"""Strongly connected components: chains contracted, then forward and backward colouring.

A vertex with one predecessor and one successor is in the component of the vertex
before its chain exactly if the vertices before and behind the chain are in one, so
chains are contracted by pointer doubling first, and told afterwards. Of what is
left, vertices without a way in or out are components of their own. All others get
the largest vertex that reaches them as a colour; those of its colour that reach
that vertex back are its component. They leave, and the rest goes on. A round of
colouring works on all components at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, materialise
from .assembly import cycle_heads
from .reach import _compact, _union, doubled


def _coloured(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, colour: the largest vertex that reaches v."""
    changed = materialise(vertices.select("v", F.col("v").alias("colour")), "scc-colours")
    parts = [changed]  # the largest of a vertex's rows is its colour so far
    while True:
        best = _union(parts).groupBy("v").agg(F.max("colour").alias("colour"))
        offers = changed.join(arcs, "v").groupBy(F.col("w").alias("v")).agg(F.max("colour").alias("offer"))
        raised = materialise(offers.join(best, "v").where("offer > colour").select("v", F.col("offer").alias("colour")), "scc-raised")
        if raised.isEmpty():
            return best
        changed = raised
        parts = _compact([*parts, changed])


def _back(arcs: DataFrame, colours: DataFrame) -> DataFrame:
    """v, colour of those from which the vertex of their colour is reached within it."""
    a, b = colours.select("v", F.col("colour").alias("__a")), colours.select(F.col("v").alias("w"), F.col("colour").alias("__b"))
    own = materialise(arcs.join(a, "v").join(b, "w").where("__a = __b").select("v", "w"), "scc-inside")
    frontier = materialise(colours.where("v = colour"), "scc-back")
    parts = [frontier]
    while True:
        found = _union(parts)
        into = frontier.select(F.col("v").alias("w"), "colour").join(own, "w").select("v", "colour").distinct()
        frontier = materialise(into.join(found.select("v"), "v", "left_anti"), "scc-frontier")
        if frontier.isEmpty():
            discard(own)
            return found
        parts = _compact([*parts, frontier])


def _core(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, component (any name) by colouring; written."""
    live, left, parts = arcs, vertices, []
    while True:
        out, into = live.select("v").distinct(), live.select(F.col("w").alias("v")).distinct()
        inside = materialise(left.join(out, "v", "left_semi").join(into, "v", "left_semi"), "scc-left")
        parts.append(materialise(left.join(inside, "v", "left_anti").select("v", F.col("v").alias("component")), "scc-alone"))
        if inside.isEmpty():
            break
        live = materialise(live.join(inside, "v", "left_semi").join(inside.withColumnRenamed("v", "w"), "w", "left_semi"), "scc-arcs")
        found = _back(live, _coloured(live, inside))
        parts.append(found.withColumnRenamed("colour", "component"))
        left = materialise(inside.join(found, "v", "left_anti"), "scc-left")
        live = materialise(live.join(left, "v", "left_semi").join(left.withColumnRenamed("v", "w"), "w", "left_semi"), "scc-arcs")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return materialise(whole, "scc-core")


def strong(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, component of vertices (v) by arcs (v, w): the smallest vertex that v reaches and that reaches v, v itself if no
    other does. Ends of arcs are vertices whether given or not."""
    step = materialise(arcs.select("v", "w").where("v <> w").distinct(), "scc-step")
    every = materialise(vertices.select("v").unionByName(step.select("v")).unionByName(step.select(F.col("w").alias("v"))).distinct(), "scc-vertices")
    out = step.groupBy("v").agg(F.count(F.lit(1)).alias("after"), F.min("w").alias("s"))
    into = step.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("before"), F.min("v").alias("p"))
    inner = materialise(out.join(into, "v").where("before = 1 and after = 1").select("v", "p", "s"), "scc-inner")
    one = F.lit(1).cast("long").alias("n")
    before = doubled(inner.select("v", "p", one)).select("v", F.col("p").alias("a"))
    behind = doubled(inner.select("v", F.col("s").alias("p"), one)).select("v", F.col("p").alias("b"))
    # Chains that close are components; nothing else enters them.
    rings = cycle_heads(inner.join(before, "v", "left_anti").select("v", "p"))
    chains = materialise(inner.select("v", "s").join(before, "v").join(behind, "v"), "scc-chains")
    core = step.join(inner.select("v"), "v", "left_anti").join(inner.select(F.col("v").alias("w")), "w", "left_anti").select("v", "w")
    core = materialise(core.unionByName(chains.select(F.col("a").alias("v"), F.col("b").alias("w"))).where("v <> w").distinct(), "scc-core-arcs")
    found = _core(core, every.join(inner.select("v"), "v", "left_anti"))
    at = lambda c: found.select(F.col("v").alias(c), F.col("component").alias(f"__{c}"))
    inside = chains.join(at("a"), "a").join(at("b"), "b").select("v", F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("v")).alias("component"))
    named = found.unionByName(inside).unionByName(rings.select("v", F.col("head").alias("component")))
    named = materialise(named, "scc-named")
    least = named.groupBy("component").agg(F.min("v").alias("least"))
    return named.join(least, "component").select("v", F.col("least").alias("component"))
