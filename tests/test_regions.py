"""Regions on stable sequences, spelled paths, dealt regions of reads, shared beginnings."""

import random

import pytest
from pyspark.sql import functions as F

from seqgraph.functions import sequences as S
from seqgraph.operators import graph as G
from seqgraph.operators import likelihood
from seqgraph.sources import gfa, storage


@pytest.mark.parametrize("most", [100_000, 3])
def test_segments_of_regions(spark, most):
    rng = random.Random(4)
    segments = [(i, rng.choice("ab"), rng.randint(0, 60), rng.randint(0, 25)) for i in range(60)] + [(98, None, 1, 5), (99, "a", None, 5), (97, "a", 0, 500)]
    regions = [(i, rng.choice("abc"), a := rng.randint(0, 80), a + rng.randint(-1, 30)) for i in range(40)] + [(50, "a", 0, 1000)]
    own = spark.createDataFrame(segments, "seg_id long, sn string, so int, len int")
    found = G.in_regions(own, spark.createDataFrame(regions, "region long, sn string, start long, end long"), width=7, most=most)
    expected = [(r, i, max(a, so), min(b, so + n)) for r, sn, a, b in regions for i, s, so, n in segments if s == sn and so is not None and n > 0 and so < b and a < so + n and a < b]
    assert sorted(tuple(x) for x in found.collect()) == sorted(expected) and len(expected) > 100


def test_paths_with_overlaps(spark):
    texts = ["S\ta\tACGTT", "S\tb\tAACG", "S\tc\tCGA", "L\ta\t+\tb\t-\t2M", "L\tb\t-\tc\t+\t1M", "L\tb\t-\tc\t+\t2M", "P\tp\ta+,b-,c+,c+\t*", "W\ts\t1\tchr\t0\t4\t<c>b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_no long, value string")
    own = G.from_lines(rows)
    found = {r.path: r.seq for r in G.spell(gfa.path_steps(rows), own.segments, own.finalize().arcs).collect()}
    # b backwards is CGTT, of which two are a's; c follows with one overlap, and again without an arc; <c>b is the complement of an arc.
    assert found == {"p": "ACGTT" + "TT" + "GA" + "CGA", "s#1#chr": "TCG" + "ACG"}


def test_reads_of_a_hot_region_are_dealt(spark):
    reads = spark.createDataFrame([("x" if i % 3 else "y", i) for i in range(40)], "region string, read_idx int")
    haps = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("z", 0)], "region string, hap_idx int")
    plain = sorted(tuple(r) for r in reads.join(haps, "region").collect())
    for most in (10_000, 5):
        found = likelihood.pairs(reads, haps, most)
        assert found.columns == ["region", "read_idx", "hap_idx"] and sorted(tuple(r) for r in found.collect()) == plain


def largest_share(df):
    """The share of df's rows that its largest task has."""
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return max(sizes) / sum(sizes)


def test_pairs_of_one_region_are_dealt_evenly(spark):
    reads = spark.createDataFrame([("x", i) for i in range(400)], "region string, read_idx int")
    haps = spark.createDataFrame([("x", i) for i in range(300)], "region string, hap_idx int")
    found = likelihood.pairs(reads, haps, 20)
    assert found.count() == found.distinct().count() == 120_000 and largest_share(found) < 0.5


@pytest.mark.parametrize("columns", ["hap_idx int", "hap_idx int, hap string"])
def test_reads_meet_blocks_of_haplotypes(spark, columns):
    """A block is one row in the join and told apart behind it; nothing is lost that is null or comes twice."""
    reads = spark.createDataFrame([("x", i, None if i % 3 else "r") for i in range(30)] * 2 + [(None, 1, "r")], "region string, read_idx int, read string")
    haps = spark.createDataFrame([("x", i if i % 4 else None, "h") for i in range(20)] * 2 + [(None, 1, "h")], "region string, hap_idx int, hap string").select(*["region", "hap_idx", "hap"][: 2 + columns.count(",")])
    found = likelihood.pairs(reads, haps, 7)
    plain = reads.join(haps, "region")
    assert found.columns == plain.columns and found.count() == 60 * 40
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("(__block") < plan.find("Join Inner")
    # Rows are dealt before they are copied, and again to meet.
    assert plan.count("RepartitionByExpression") == 4


def test_regions_of_one_place_are_dealt_evenly(spark):
    own = spark.range(400).select(F.col("id").alias("seg_id"), F.lit("a").alias("sn"), F.lit(3).alias("so"), F.lit(4).alias("len"))
    asked = spark.range(300).select(F.col("id").alias("region"), F.lit("a").alias("sn"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("end"))
    found = G.in_regions(own, asked, width=20, together=50)
    assert found.count() == found.distinct().count() == 120_000 and largest_share(found) < 0.5
    assert found.select("start", "end").distinct().collect() == [(3, 5)]


def test_links_imply_lengths_with_each_line_parsed_once(spark):
    lines = ["L\ta\t+\tb\t-\t2:3\tL1:i:4\tL2:i:5\tL1:i:9", "L\tb\t+\tc\t-\t1:1\tL1:Z:7\tL2:i:x\tL2:i:8\tL1:i:6", "L\td\t+\te\t+\t*", "L\td\t?\ta\t+\t1:1\tL2:i:99", "S\ta\tACGT\tL1:i:99", "L\t"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    links = gfa.link_lines(rows)
    # Of a tag that comes twice the first well-formed one counts, and only if it is a number.
    assert sorted(tuple(r) for r in links.select("v_name", "ov", "ow", "l1", "l2").collect()) == [("a", 2, 3, 4, 5), ("b", 1, 1, None, 8), ("d", 0, 0, None, None)]
    assert {r.v_name: {k: tuple(x) for k, x in r.tags.items()} for r in links.collect()}["b"] == {"L1": ("Z", "7"), "L2": ("i", "8")}
    found = G.implied_lengths(links)
    assert {tuple(r) for r in found.collect()} == {("a", 6), ("b", 8), ("c", 9)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("a", "", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("abc", "abcd", 3), ("xbc", "abc", 0), ("é日x", "é日y", 2), (None, "a", None)])
def test_common_extension(spark, a, b, n):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(S.common_extension("a", "b"), S.common_extension(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (n, n)


def test_scratch_of_two_threads(spark):
    """Each deletes its own tables and leaves the other's."""
    from concurrent.futures import ThreadPoolExecutor

    with storage.scratch(spark):
        outer = storage.materialise(spark.range(3), "outer")

        def other():
            with storage.scratch(spark):
                inner = storage.materialise(spark.range(4), "inner")
                return inner.count()

        with ThreadPoolExecutor(2) as pool:
            assert list(pool.map(lambda _: other(), range(2))) == [4, 4]
        assert outer.count() == 3
