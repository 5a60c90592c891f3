"""Normalising and inspecting sequence graphs with joins and aggregations.

Arcs are rows v, w (oriented vertices), ov, ow (overlap on each side, null if
unknown), rank, link_id, comp (true for the complement that was added).
Segments are rows seg_id, name, seq, len.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.blocks import blocks, told
from ..functions.numbering import numbered, running
from ..functions.sequences import complement, reverse_complement, segment_of, vertex
from ..sources import gfa


@dataclass
class SequenceGraph:
    segments: DataFrame
    arcs: DataFrame

    def finalize(self) -> SequenceGraph:
        """Drop what has no segment, repair one-sided overlaps, close under complement, clamp overlaps."""
        arcs = live_arcs(self.arcs, self.segments)
        arcs = close_complement(fill_overlaps(arcs))
        return SequenceGraph(live_segments(self.segments), clamp_overlaps(arcs, self.segments))


def from_lines(rows: DataFrame) -> SequenceGraph:
    """GFA lines (line_no, value) to a graph as read, before finalize()."""
    segments, links = gfa.segment_lines(rows), gfa.link_lines(rows)
    ids = gfa.first_mentions(segments, links)
    implied = implied_lengths(links)
    known = ids.join(segments.drop("line_no"), "name", "left").join(implied, "name", "left")
    known = known.withColumn("len", F.greatest(F.coalesce("len", F.lit(0)), F.coalesce("implied", F.lit(0)))).drop("implied")
    return SequenceGraph(known, number_links(links, ids))


def read_gfa(spark, path: str) -> SequenceGraph:
    return from_lines(gfa.lines(spark, path)).finalize()


def implied_lengths(links: DataFrame) -> DataFrame:
    """name, implied: the longest length that L1 and L2 tags imply (overlap and what lies beyond it)."""
    side = lambda name, over, rest: F.struct(F.col(name).alias("name"), (F.col(over) + F.col(rest)).alias("n"))
    # Each line is parsed once. What implies nothing goes behind the maximum: before, its test would parse lines again.
    both = links.select(F.inline(F.array(side("v_name", "ov", "l1"), side("w_name", "ow", "l2"))))
    return both.groupBy("name").agg(F.max("n").alias("implied")).where("implied is not null")


def number_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links by name to arcs by vertex; link_id counts them in line order."""
    v, w = ids.toDF("v_name", "v_id"), ids.toDF("w_name", "w_id")
    found = numbered(links.join(v, "v_name").join(w, "w_name"), ["line_no"], "link_id")
    return found.select(vertex("v_id", "v_ori").alias("v"), vertex("w_id", "w_ori").alias("w"), "ov", "ow", "rank", "link_id", F.lit(False).alias("comp"))


def live_segments(segments: DataFrame) -> DataFrame:
    return segments.where("len > 0")


def missing_segments(segments: DataFrame) -> DataFrame:
    """Named by a link but never given, or empty."""
    return segments.where(F.coalesce("len", F.lit(0)) == 0)


def live_arcs(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Arcs whose both segments have a length."""
    live = live_segments(segments).select("seg_id")
    head, tail = live.withColumnRenamed("seg_id", "a"), live.withColumnRenamed("seg_id", "b")
    return arcs.join(head, segment_of("v") == F.col("a"), "left_semi").join(tail, segment_of("w") == F.col("b"), "left_semi")


def fill_overlaps(arcs: DataFrame) -> DataFrame:
    """A missing overlap is that of the arc's complement if there is exactly one; arcs that stay without go."""
    other = arcs.groupBy(complement("w").alias("v"), complement("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ow").alias("c_ov"), F.max("ov").alias("c_ow"))
    met = arcs.join(other, ["v", "w"], "left")
    one = lambda c: F.when(F.col("n") == 1, F.col(c))
    filled = met.withColumn("ov", F.coalesce("ov", one("c_ov"))).withColumn("ow", F.coalesce("ow", one("c_ow")))
    return filled.where("ov is not null and ow is not null").select(*arcs.columns)


def close_complement(arcs: DataFrame) -> DataFrame:
    """With each arc v to w the arc from w's complement to v's, its overlaps swapped, where there is none."""
    mirrored = arcs.select(*[{"v": complement("w"), "w": complement("v"), "ov": F.col("ow"), "ow": F.col("ov"), "comp": F.lit(True)}.get(c, F.col(c)).alias(c) for c in arcs.columns])
    keys = ["v", "w", "ov", "ow"]
    rest = [c for c in arcs.columns if c not in keys]
    # Of arcs alike in keys, the complement of the one with the lowest link_id is added.
    lone = mirrored.groupBy(*keys).agg(*([F.min(F.struct("link_id", *[c for c in rest if c != "link_id"])).alias("x")] if "link_id" in rest else [F.min(F.struct(*rest)).alias("x")] if rest else []))
    lone = lone.select(*[f"x.{c}" if c in rest else c for c in arcs.columns])
    return arcs.unionByName(lone.join(arcs.select(*keys).distinct(), keys, "left_anti"))


def clamp_overlaps(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlaps no longer than their segments."""
    length = segments.select("seg_id", "len")
    met = arcs.join(length.toDF("a", "v_len"), segment_of("v") == F.col("a")).join(length.toDF("b", "w_len"), segment_of("w") == F.col("b"))
    return met.withColumn("ov", F.least("ov", "v_len")).withColumn("ow", F.least("ow", "w_len")).select(*arcs.columns)


def delete_segments(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs that touch none of gone (seg_id), on either strand."""
    kept = arcs.join(gone.select(F.col("seg_id").alias("a")), segment_of("v") == F.col("a"), "left_anti")
    return kept.join(gone.select(F.col("seg_id").alias("b")), segment_of("w") == F.col("b"), "left_anti")


def delete_arcs(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs but for all from v to w of gone (v, w); their complements are arcs of their own."""
    return arcs.join(gone.select("v", "w").distinct(), ["v", "w"], "left_anti")


def find_arcs(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """For each pair v, w: its arc's link_id, -1 if there is none, -2 if there are several."""
    counted = arcs.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n"), F.min("link_id").alias("link_id"))
    met = pairs.join(counted, ["v", "w"], "left")
    return met.select("v", "w", F.when(F.col("n").isNull(), -1).when(F.col("n") > 1, -2).otherwise(F.col("link_id")).alias("found"))


def degrees(arcs: DataFrame) -> DataFrame:
    """v, n, start: how many arcs leave each vertex, and where they start in arcs sorted by vertex."""
    return running(arcs.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], F.col("n"), "start")


def surplus_arcs(arcs: DataFrame) -> DataFrame:
    """v, w, surplus of the pairs that have more than one arc."""
    return arcs.groupBy("v", "w").agg((F.count(F.lit(1)) - 1).alias("surplus")).where("surplus > 0")


def best_parallel(arcs: DataFrame) -> DataFrame:
    """Of parallel arcs one stays: the first by longest overlap if it has no rank, else the one of the lowest rank, of
    equal ones again the first; of these orders link_id breaks ties. Complements of the others go too: of two arcs'
    worth of mirrored groups the one at the lower vertex decides, if it has several arcs. Arcs from a vertex to its own
    complement all stay.
    """
    first = F.col("v") < complement("w")
    mirrored = arcs.withColumn("__own", first).withColumn("__v", F.when(first, F.col("v")).otherwise(complement("w"))).withColumn("__w", F.when(first, F.col("w")).otherwise(complement("v")))
    place = F.struct((-F.col("ov")).alias("o"), F.col("link_id").alias("i"))
    ranked = F.when(F.col("rank") >= 0, F.struct(F.col("rank").alias("r"), place.alias("p")))
    sides = mirrored.where(F.col("w") != complement("v")).groupBy("__v", "__w", "__own").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("link_id", "rank"), place).alias("head"), F.min_by("link_id", ranked).alias("best")
    )
    winner = F.when(F.coalesce(F.col("head.rank"), F.lit(-1)) < 0, F.col("head.link_id")).otherwise(F.col("best"))
    winners = sides.where("n > 1").groupBy("__v", "__w").agg(F.max_by(winner, "__own").alias("__winner"))
    kept = mirrored.join(winners, ["__v", "__w"], "left").where((F.col("w") == complement("v")) | F.col("__winner").isNull() | (F.col("__winner") == F.col("link_id")))
    return kept.select(*arcs.columns)


def stable_ranges(segments: DataFrame) -> DataFrame:
    """Of each stable sequence: least start, greatest end, rank, and whether the ranks agree."""
    rows = segments.where("sn is not null")
    return rows.groupBy("sn").agg(F.min("so").alias("start"), F.max(F.col("so") + F.col("len")).alias("end"), F.min("sr").alias("rank"), (F.min("sr") == F.max("sr")).alias("ranks_agree"))


def max_rank(segments: DataFrame) -> DataFrame:
    return segments.agg(F.max("sr").alias("max_rank"))


def degree_profile(arcs: DataFrame) -> DataFrame:
    """How many vertices have how many arcs."""
    return arcs.groupBy("v").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def spell(steps: DataFrame, segments: DataFrame, arcs: DataFrame | None = None) -> DataFrame:
    """path, seq of path steps (path, step, name, strand). With arcs (v, w, ow) what a step shares with the one before is
    told once: the least overlap of the arcs between them, none where there is no arc."""
    if arcs is None:
        met = steps.join(segments.select("name", "seq"), "name").withColumn("ow", F.lit(0))
    else:
        placed = steps.join(segments.select("name", "seq", "seg_id"), "name").withColumn("v", vertex("seg_id", "strand"))
        before = placed.select("path", (F.col("step") + 1).alias("step"), F.col("v").alias("__before"))
        over = arcs.groupBy(F.col("v").alias("__before"), F.col("w").alias("v")).agg(F.min("ow").alias("ow"))
        met = placed.join(before, ["path", "step"], "left").join(over, ["__before", "v"], "left")
    return spelled_steps(met, "path").select("path", "seq")


def spelled_steps(steps: DataFrame, key: str) -> DataFrame:
    """key, seq, n: what ways spell. steps: key, step, seq, strand, ow (characters shared with the vertex before, null as 0)."""
    text = F.when(F.col("strand") == 1, reverse_complement("seq")).otherwise(F.col("seq"))
    parts = F.array_sort(F.collect_list(F.struct("step", F.substr(text, F.coalesce("ow", F.lit(0)) + 1).alias("t"))))
    return steps.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("seq"), F.count(F.lit(1)).alias("n"))


def in_regions(segments: DataFrame, regions: DataFrame, width: int = 1_000, most: int = 100_000, together: int = 300) -> DataFrame:
    """region, seg_id, start, end: the part of each region (region, sn, start, end) that a segment (seg_id, sn, so, len)
    covers on its stable sequence. Ends are not included; empty regions and segments meet nothing.

    Segments at one place are one interval with a block of them, up to about together, and regions likewise, so what is
    compared are intervals. Both sides are cut into bins of width, and meet in a bin once: in the first that they share.
    The intervals of a bin that holds more than most are dealt over shares, to each of which its regions go. Blocks that
    met are dealt evenly before they are told apart. width should be near the length of what is many; a long interval
    has a row for each of its bins.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    a, b = F.col("so").cast("long"), (F.col("so") + F.col("len")).cast("long")
    held = segments.where("sn is not null and so is not null and len > 0").select("seg_id", "sn", a.alias("__a"), b.alias("__b"))
    held = blocks(held, ["sn", "__a", "__b"], "__segments", together).withColumn("__bin", bins(F.col("__a"), F.col("__b")))
    shares = held.groupBy("sn", "__bin").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__shares")).where("__shares > 1")
    held = held.join(shares, ["sn", "__bin"], "left").withColumn("__share", F.pmod(F.xxhash64("__a", "__b", "__segments"), F.coalesce("__shares", F.lit(1))).cast("int")).drop("__shares")
    asked = blocks(regions.where(F.col("start") < F.col("end")).select("region", "sn", "start", "end"), ["sn", "start", "end"], "__regions", together)
    asked = asked.withColumn("__bin", bins(F.col("start"), F.col("end")))
    asked = asked.join(shares, ["sn", "__bin"], "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
    met = asked.join(held, ["sn", "__bin", "__share"]).where((F.col("__a") < F.col("end")) & (F.col("start") < F.col("__b")))
    met = met.where(F.col("__bin") == F.greatest(F.floor(F.col("__a") / width), F.floor(F.col("start") / width)))
    met = met.select("__regions", "__segments", F.greatest("__a", "start").alias("start"), F.least("__b", "end").alias("end"))
    return told(met, "__regions", "__segments").select("region", "seg_id", "start", "end")


def read_batches(reads: DataFrame, limit: int) -> DataFrame:
    """read_idx, batch: reads in order, packed into batches of about limit characters."""
    sized = reads.select("read_idx", F.length("seq").cast("long").alias("n"))
    return running(sized, ["read_idx"], F.col("n"), "before").select("read_idx", "n", F.floor(F.col("before") / limit).alias("batch"))


def read_statistics(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.max(F.length("seq")).alias("longest"))


def rank_in(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """row_number within keys."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
