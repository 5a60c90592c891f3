"""Reading and writing graphs and reads: literal edge cases."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from seqgraph.functions import sequences as S
from seqgraph.operators import graph as G
from seqgraph.operators import likelihood
from seqgraph.sources import fastx, gfa, sinks


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no long, value string")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("*", (0, 0)), ("5M", (5, 5)), ("3M2D4I", (5, 7)), ("4:6", (4, 6)), (":6", (None, 6)), ("4:", (4, 0)), ("7", (0, 0)), ("abc", (0, 0)), (None, (0, 0)), ("2N3S", (2, 3))],
)
def test_overlap_forms(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(S.overlap("t").alias("o")).first().o
    assert (row.ov, row.ow) == expected


def test_reverse_complement_keeps_case_and_codes(spark):
    row = spark.createDataFrame([("AcGTNmrU-",)], "s string").select(S.reverse_complement("s")).first()
    assert row[0] == "-AykNACgT"


def test_vertices_and_diagonals(spark):
    df = spark.createDataFrame([(5, 1, -7)], "seg long, ori int, d int").withColumn("v", S.vertex("seg", "ori"))
    row = df.select("v", S.segment_of("v"), S.strand_of("v"), S.complement("v"), S.diagonal_of(S.pack_diagonal("v", "d"))).first()
    assert tuple(row) == (11, 5, 1, 10, -7)


def test_tags(spark):
    fields = ["AA:A:x", "II:i:-3", "FF:f:1.5e2", "ZZ:Z:a b", "BI:B:i,1,2", "BF:B:f,1.5", "BQ:B:q,1", "bad", "X:i:1", "NN:i:x", "II:i:9"]
    row = spark.createDataFrame([(fields,)], "f array<string>").withColumn("t", S.tags(F.col("f"))).select("t", S.tag_int("t", "II"), S.tag_string("t", "ZZ"), S.tag_int("t", "ZZ"), S.tags_text("t")).first()
    assert sorted(row.t) == ["AA", "BF", "BI", "FF", "II", "ZZ"]
    assert tuple(row)[1:4] == (-3, "a b", None)
    assert row[4].split("\t")[0] == "AA:A:x"


def test_numbers_follow_the_first_mention(spark):
    rows = lines(spark, "H\tVN:Z:1.0", "L\tb\t+\ta\t-\t*", "S\ta\tACGT", "S\tc\tGG", "P\tp\ta+,b+", "x", "S\tb\tTT", "S\tc\tGGG\tSN:Z:chr\tSO:i:4\tSR:i:0")
    own = G.from_lines(rows)
    assert {r.name: (r.seg_id, r.seq) for r in own.segments.collect()} == {"b": (0, "TT"), "a": (1, "ACGT"), "c": (2, "GGG")}
    arc = own.arcs.first()
    assert (arc.v, arc.w, arc.ov, arc.ow) == (0, 3, 0, 0)
    stable = G.stable_ranges(own.segments).first()
    assert (stable.start, stable.end, stable["rank"], stable.ranks_agree) == (4, 7, 0, True)


def test_lengths(spark):
    rows = lines(spark, "S\ta\t*\tLN:i:9", "S\tb\tACG\tLN:i:7", "L\ta\t+\td\t+\t2:3\tL1:i:20\tL2:i:5", "S\te\t*")
    own = G.from_lines(rows)
    assert {r.name: r.len for r in own.segments.collect()} == {"a": 22, "b": 3, "d": 8, "e": 0}
    assert [r.name for r in gfa.segment_lines(rows).where("length_differs").collect()] == ["b"]


def test_finalize(spark):
    rows = lines(spark, "S\ta\tACGT", "S\tb\tGG", "S\tc\tT", "L\ta\t+\tb\t-\t9:1", "L\ta\t+\tgone\t+\t*", "L\tb\t+\tc\t+\t:1", "L\tc\t-\tb\t-\t1:1", "L\ta\t?\tb\t+\t*", "L\ta\t+\ta\t+\t0M", "L\ta\t+\ta\t-\t0M")
    own = G.from_lines(rows).finalize()
    ids = {r.name: r.seg_id for r in own.segments.collect()}
    a, b, c = (ids[x] * 2 for x in "abc")
    found = {(r.v, r.w, r.ov, r.ow) for r in own.arcs.collect()}
    assert (a, b + 1, 4, 1) in found and (b, a + 1, 1, 4) in found  # complement, clamped
    assert (b, c, 1, 1) in found and (c + 1, b + 1, 1, 1) in found  # filled from the only complement
    assert (a, a, 0, 0) in found and (a + 1, a + 1, 0, 0) in found and (a, a + 1, 0, 0) in found
    assert "gone" not in ids and len(found) == 7


def test_ambiguous_complements_fill_nothing(spark):
    rows = lines(spark, "S\tb\tGG", "S\tc\tT", "L\tb\t+\tc\t+\t:1", "L\tc\t-\tb\t-\t1:1", "L\tc\t-\tb\t-\t1:2")
    assert G.fill_overlaps(G.from_lines(rows).arcs).count() == 2


def test_parallel_arcs_and_lookup(spark):
    arcs = spark.createDataFrame([(0, 2, 0, 0, 3, 1), (0, 2, 0, 0, 1, 2), (0, 2, 0, 0, None, 3), (2, 4, 0, 0, None, 4)], "v long, w long, ov int, ow int, rank int, link_id long")
    assert [tuple(r) for r in G.surplus_arcs(arcs).collect()] == [(0, 2, 2)]
    assert sorted(r.link_id for r in G.best_parallel(arcs).collect()) == [2, 4]
    pairs = spark.createDataFrame([(0, 2), (2, 4), (4, 0)], "v long, w long")
    assert sorted(tuple(r) for r in G.find_arcs(pairs, arcs).collect()) == [(0, 2, -2), (2, 4, 4), (4, 0, -1)]
    assert G.delete_segments(arcs, spark.createDataFrame([(2,)], "seg_id long")).count() == 3


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "g.gfa.gz", "wt", newline="") as f:
        f.write("S\ta\tACGT\r\nS\tb\tGG\r\nL\ta\t+\tb\t+\t0M\r\n")
    own = G.read_gfa(spark, f"file://{tmp_path}/g.gfa.gz")
    assert sorted(r.seq for r in own.segments.collect()) == ["ACGT", "GG"] and own.arcs.count() == 2
    text = sinks.segment_text(own.segments.select("name", "seq", "len")).unionByName(sinks.arc_text(own.arcs.where("not comp"), own.segments))
    sinks.write_lines(text, f"file://{tmp_path}/out")
    again = G.read_gfa(spark, f"file://{tmp_path}/out")
    assert sorted(r.seq for r in again.segments.collect()) == ["ACGT", "GG"] and again.arcs.count() == 2


def test_fasta_graph(spark):
    rows = spark.createDataFrame([("f", 0, "skipped"), ("f", 1, ">one first"), ("f", 2, "AC"), ("f", 3, "GT"), ("f", 4, ">two"), ("g", 0, ">three"), ("g", 1, "A")], "file string, line_no long, value string")
    assert sorted((r.name, r.sn, r.seq) for r in gfa.fasta_segments(rows).collect()) == [("s1", "one", "ACGT"), ("s2", "two", ""), ("s3", "three", "A")]


def test_fasta_and_graph_lines_in_one_file(spark):
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate([">one", "AC", "S\tx\tGG", "ignored", ">two", "T"])], "file string, line_no long, value string")
    assert sorted((r.sn, r.seq) for r in gfa.fasta_segments(rows).collect()) == [("one", "AC"), ("two", "T")]


def test_paths(spark):
    rows = lines(spark, "S\ta\tAC", "S\tb\tGT", "P\tp\ta+,b-,a+\t*", "W\ts\t1\tchr\t0\t4\t>a<b")
    steps = gfa.path_steps(rows)
    assert {r.path: r.seq for r in G.spell(steps, gfa.segment_lines(rows)).collect()} == {"p": "ACACAC", "s#1#chr": "ACAC"}


def test_setting_tags(spark):
    df = spark.createDataFrame([(["AA:i:1", "BB:Z:x"],)], "f array<string>").select(S.tags(F.col("f")).alias("t"))
    row = df.select(S.tags_text(S.with_tag("t", "AA", "f", F.lit(2.5))), S.tags_text(S.without_tag("t", "BB"))).first()
    assert tuple(row) == ("AA:f:2.5\tBB:Z:x", "AA:i:1")


def test_reads(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 some words\nAC\nGT\n>r2\n\n")
    (tmp_path / "b.fq").write_text("@q1\nACG\n+\nIII\n@q2 x\nAC\nGT\n+q2\nII\n")
    found = [(r.read_idx, r.name, r.comment, r.seq, r.valid) for r in gfa.read_reads(spark, f"file://{tmp_path}/*").orderBy("read_idx").collect()]
    assert found == [(0, "r1", "some words", "ACGT", True), (1, "r2", "", "", True), (2, "q1", "", "ACG", True), (3, "q2", "x", "ACGT", False)]


def test_reads_whose_qualities_span_lines(spark, tmp_path):
    text = "@q1 x\r\nACGT\r\nACGTAC\r\n+\r\n@III\r\nIIII\r\n+I\r\n@q2\nAC\n+\nI\n@q3\nACG\n+q3\n@+>\n\n@q4\n\n+\n\n"
    (tmp_path / "a.fq").write_bytes(text.encode())
    found = [(r.name, r.seq, r.qual, r.valid) for r in gfa.read_reads(spark, f"file://{tmp_path}/a.fq").orderBy("read_idx").collect()]
    assert found == [("q1", "ACGTACGTAC", "@IIIIIII+I", True), ("q2", "AC", "I", False), ("q3", "ACG", "@+>", True), ("q4", "", "", True)]


def test_reads_of_one_file_in_many_splits(spark, tmp_path):
    want = [(f"r{i}", "ACGT" * (i % 7 + 1), "@II+" * (i % 7 + 1)) for i in range(400)]
    cut = lambda s: "\n".join(s[k : k + 8] for k in range(0, len(s), 8))
    (tmp_path / "a.fq").write_text("".join(f"@{n}\n{cut(s)}\n+\n{cut(q)}\n" for n, s, q in want))
    rows = gfa.read_reads(spark, f"file://{tmp_path}/a.fq", bytes="1000").orderBy("read_idx").collect()
    assert [(r.name, r.seq, r.qual) for r in rows] == want and all(r.valid for r in rows)


def test_regions_and_likelihoods(spark):
    text = "2 2\nACGT IIII NNNN NNNN\nAC II NN NN\nACGTA\nTTTTT\n1 1\nG I N N\nGG\n"
    reads, haps = likelihood.regions(spark.createDataFrame([("f", text)], "file string, text string"))
    assert reads.count() == 3 and haps.count() == 3 and likelihood.pairs(reads, haps).count() == 5
    found = {(r.region, r.read_idx, r.hap_idx): r.log10_likelihood for r in likelihood.likelihoods(reads, haps).collect()}
    assert found["f:1", 0, 0] > found["f:1", 0, 1] and all(v < 0 for v in found.values())
    rate = spark.createDataFrame([("I!",)], "q string").select(likelihood.error_rate(F.col("q"))).first()[0]
    assert rate == pytest.approx([1e-4, 1.0])


def test_regions_by_lines(spark):
    lines = ["stray", "", "1 0\r", "AC II NN NN\r", "", "0 2", "GG", "", "TT", "0 0", "2 1", "A I N N", "C I N N", "G", None]
    rows = [(f, i, v) for f in ("a", "b") for i, v in enumerate(lines)]
    reads, haps = likelihood.line_regions(spark.createDataFrame(rows, "file string, line_no long, value string").repartition(5))
    assert sorted((r.region, r.read_idx, r.read, r.q_del) for r in reads.collect()) == [(f"{f}:{k}", i, x, q) for f in "ab" for k, i, x, q in ((1, 0, "AC", "NN"), (4, 0, "A", "N"), (4, 1, "C", "N"))]
    assert sorted((r.region, r.hap_idx, r.hap) for r in haps.collect()) == [(f"{f}:{k}", i, x) for f in "ab" for k, i, x in ((2, 0, "GG"), (2, 1, "TT"), (4, 0, "G"))]
    empty = likelihood.line_regions(spark.createDataFrame([], "file string, line_no long, value string"))
    assert [x.count() for x in empty] == [0, 0]


def pair_by_definition(read, hap, q_base, q_ins, q_del, c=0.1):
    rate = lambda q: [10 ** ((33 - ord(x)) / 10) for x in q]
    base, ins, dele, n = rate(q_base), rate(q_ins), rate(q_del), len(hap)
    m, x, y = [0.0] * (n + 1), [0.0] * (n + 1), [1 / n] * (n + 1)
    for i, a in enumerate(read):
        nm, nx, ny = [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            hit = 1 - base[i] if a == hap[j - 1] or "N" in (a, hap[j - 1]) else base[i] / 3
            nm[j] = hit * (max(1e-12, 1 - ins[i] - dele[i]) * m[j - 1] + (1 - c) * (x[j - 1] + y[j - 1]))
            nx[j] = ins[i] * m[j] + c * x[j]
            ny[j] = dele[i] * nm[j - 1] + c * ny[j - 1]
        m, x, y = nm, nx, ny
    return math.log10(sum(m[1:]) + sum(x[1:]))


def test_likelihoods_by_definition(monkeypatch):
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        n = rng.randint(1, 30)
        rows.append(("".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 40))), *("".join(rng.choice("+5?IN") for _ in range(n)) for _ in range(3))))
    for cells in (50, 1_000_000):
        monkeypatch.setattr(likelihood, "CELLS", cells)
        found = likelihood.log10_likelihoods(*map(list, zip(*rows, strict=True)))
        assert found == pytest.approx([pair_by_definition(*r) for r in rows], abs=1e-9)
    assert likelihood.log10_likelihood("", "A", "", "", "") == float("-inf")


def test_parallel_arcs(spark):
    rows = [
        (0, 2, 5, 5, None, 1), (0, 2, 3, 3, 0, 2),  # the first by overlap has no rank: it stays
        (0, 4, 1, 1, 2, 3), (0, 4, 0, 0, 1, 4), (0, 4, 0, 0, 1, 5),  # the lowest rank, then the lowest link_id
        (5, 1, 1, 1, 2, 3), (5, 1, 0, 0, 1, 4), (5, 1, 0, 0, 1, 5),  # their complements follow
        (6, 7, 1, 1, 0, 6), (6, 7, 2, 2, 0, 7),  # a vertex and its own complement: all stay
        (8, 9, 0, 0, 0, 8), (0, 6, 0, 0, None, 9),
    ]
    arcs = spark.createDataFrame(rows, "v long, w long, ov int, ow int, rank int, link_id long")
    kept = sorted((r.v, r.w, r.link_id) for r in G.best_parallel(arcs).collect())
    assert kept == [(0, 2, 1), (0, 4, 4), (0, 6, 9), (5, 1, 4), (6, 7, 6), (6, 7, 7), (8, 9, 8)]
    left = G.delete_arcs(arcs, spark.createDataFrame([(0, 4), (0, 4), (1, 5)], "v long, w long"))
    assert sorted({(r.v, r.w) for r in left.collect()}) == [(0, 2), (0, 6), (5, 1), (6, 7), (8, 9)]


def test_written_tags(spark):
    rows = lines(spark, "S\ta\tACGT\tSN:Z:chr\tSO:i:4\tSR:i:0\tXX:Z:y", "S\tb\tGG", "L\ta\t+\tb\t-\t2:1\tSR:i:1\tZZ:A:q")
    own = G.from_lines(rows)
    ids = own.segments.select("seg_id", "name", "len")
    links = gfa.link_lines(rows)
    arcs = own.arcs.crossJoin(links.select("tags"))
    written = [r.line for r in sinks.segment_text(own.segments).collect()] + [r.line for r in sinks.arc_text(arcs, ids, True, True).collect()]
    assert sorted(written) == ["L\ta\t+\tb\t-\t2:1\tSR:i:1\tL1:i:2\tL2:i:1\tZZ:A:q", "S\ta\tACGT\tLN:i:4\tSN:Z:chr\tSO:i:4\tSR:i:0\tXX:Z:y", "S\tb\tGG\tLN:i:2"]
    again = G.from_lines(spark.createDataFrame(list(enumerate(sorted(written, reverse=True))), "line_no long, value string"))
    assert {r.name: (r.seq, r.sn, r.so, r.sr) for r in again.segments.collect()} == {"a": ("ACGT", "chr", 4, 0), "b": ("GG", None, None, None)}
    assert sinks.arc_text(G.close_complement(own.arcs), ids).count() == 1


def test_whole_files_with_crlf_and_wrapped_qualities(spark):
    texts = [("a", "@r1 x\r\nAC\r\nGT\r\n+\r\nII\r\n@I\r\n@r2\nA\n+\nII\n@r3\nAC\n+r3\n@@"), ("b", ">s one\r\nAC\r\n\r\nG\n>t\n"), ("c", "")]
    found = fastx.whole_texts(spark.createDataFrame(texts, "file string, text string")).collect()
    assert sorted((r.file, r.name, r.comment, r.seq, r.qual, r.valid) for r in found if r.file == "a") == [("a", "r1", "x", "ACGT", "II@I", True), ("a", "r2", "", "A", "II", False), ("a", "r3", "", "AC", "@@", True)]
    assert sorted((r.name, r.seq, r.qual, r.valid) for r in found if r.file == "b") == [("s", "ACG", None, True), ("t", "", None, True)]


def test_scores_are_written(spark, tmp_path):
    sinks.write_scores(spark.createDataFrame([(1, "b", 3), (0, "a", -1)], "read_idx long, name string, score int"), f"file://{tmp_path}/scores")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/scores").collect()] == ["0\ta\t-1", "1\tb\t3"]
