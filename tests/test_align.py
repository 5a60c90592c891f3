"""Alignment: batched kernel, relational wavefront and an independent shortest path."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from seqgraph.operators import align as A
from seqgraph.operators import graph as G
from seqgraph.operators import intervals, reach, wavefront
from seqgraph.streaming import scoring

BUBBLE = ([b"ACGT", b"GG", b"T", b"CCA"], [(0, 1, 0), (0, 2, 0), (1, 3, 0), (2, 3, 0)])
GOLDEN = {"ACGT": 0, "ACGTTCCA": 0, "ACGTGGCCA": 0, "ACGTGCCA": 1, "ACGTCCA": 1, "CGT": 1, "TTTT": 3, "ACGTTCCAGG": 2, "": 0, "A": 0, "acgt": 4}


def shortest(texts, arcs, start, q, end=None):
    done, todo, out = set(), [(0, start, -1, 0)], {}
    for a, b, o in arcs:
        out.setdefault(a, []).append((b, o))
    while todo:
        c, v, k, i = heapq.heappop(todo)
        if i == len(q) and (end is None or v == end and k == len(texts[v]) - 1):
            return c
        if (v, k, i) in done:
            continue
        done.add((v, k, i))
        if i < len(q):
            heapq.heappush(todo, (c + 1, v, k, i + 1))
        if k + 1 < len(texts[v]):
            if i < len(q):
                heapq.heappush(todo, (c + (texts[v][k + 1] != q[i]), v, k + 1, i + 1))
            heapq.heappush(todo, (c + 1, v, k + 1, i))
        else:
            for w, o in out.get(v, []):
                heapq.heappush(todo, (c, w, o - 1, i))
    return None


def random_case(rng, n_queries=6):
    n = rng.randint(1, 7)
    texts = ["".join(rng.choice("ACG") for _ in range(rng.randint(1, 6))).encode() for _ in range(n)]
    ends = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 10))}
    arcs = [(a, b, rng.randint(0, min(2, len(texts[b]) - 1))) for a, b in sorted(ends)]
    return texts, arcs, ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 12))).encode() for _ in range(n_queries)]


def test_literal_bubble():
    assert A.scores(A.Flat(*BUBBLE, 0), [q.encode() for q in GOLDEN]).tolist() == list(GOLDEN.values())


def test_kernel_is_the_shortest_path():
    rng = random.Random(5)
    for _ in range(150):
        texts, arcs, queries = random_case(rng)
        assert A.scores(A.Flat(texts, arcs, 0), queries).tolist() == [shortest(texts, arcs, 0, q) for q in queries]


def test_kernel_with_a_fixed_end():
    rng = random.Random(6)
    for _ in range(150):
        texts, arcs, queries = random_case(rng)
        end = rng.randrange(len(texts))
        expected = [shortest(texts, arcs, 0, q, end) for q in queries]
        assert A.scores(A.Flat(texts, arcs, 0, end), queries).tolist() == [-1 if x is None else x for x in expected]


def test_kernel_on_mutated_walks():
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    texts = [base[i : i + 70].encode() for i in range(0, 3000, 70)]
    own = A.Flat(texts, [(i, i + 1, 0) for i in range(len(texts) - 1)], 0)
    assert A.scores(own, [base[:n].encode() for n in (1, 31, 32, 64, 65, 3000)]).tolist() == [0] * 6
    gone = base[:900] + base[901:1500] + "A" + base[1500:2000]
    assert A.scores(own, [gone.encode()])[0] <= 2


def frames(spark, texts, arcs):
    vertices = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "v long, seq string")
    return vertices, spark.createDataFrame(arcs, "v long, w long, ow int")


def test_relational_wavefront_agrees(spark):
    rng = random.Random(21)
    for _ in range(1):
        texts, arcs, queries = random_case(rng, 4)
        reads = spark.createDataFrame([(i, q.decode()) for i, q in enumerate(queries)], "read_idx long, seq string")
        found = {r.read_idx: r.score for r in wavefront.align(reads, *frames(spark, texts, arcs), 0).collect()}
        assert found == dict(enumerate(A.scores(A.Flat(texts, arcs, 0), queries).tolist()))


def test_relational_wavefront_with_a_fixed_end(spark):
    reads = spark.createDataFrame([(0, "ACGTCCA"), (1, ""), (2, "ACGTT")], "read_idx long, seq string")
    vertices, arcs = frames(spark, *BUBBLE)
    for end in (3, 2):
        found = {r.read_idx: r.score for r in wavefront.align(reads, vertices, arcs, 0, end).collect()}
        assert found == {i: shortest(*BUBBLE, 0, q, end) for i, q in enumerate([b"ACGTCCA", b"", b"ACGTT"])}
    lone = spark.createDataFrame([(0, "A"), (9, "C")], "v long, seq string")
    assert [r.score for r in wavefront.align(reads.where("read_idx = 2"), lone, arcs.where("v < 0"), 0, 9).collect()] == [-1]


def test_a_large_graph_is_scored_by_relations(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_BASES", 5)
    rows = spark.createDataFrame(list(enumerate(["S\ta\tACGT", "S\tb\tGG", "L\ta\t+\tb\t+\t0M"])), "line_no long, value string")
    reads = spark.createDataFrame([(0, "ACGTG"), (1, "ACGTGG")], "read_idx long, seq string")
    own = G.from_lines(rows).finalize()
    assert sorted(tuple(r) for r in A.graph_edit_distance(reads, own).collect()) == [(0, 0), (1, 0)]
    assert sorted(tuple(r) for r in A.graph_edit_distance(reads, own, end="b").collect()) == [(0, 1), (1, 0)]


def graph_of(spark, texts, arcs):
    rows = [f"S\ts{i}\t{t.decode()}" for i, t in enumerate(texts)] + [f"L\ts{a}\t+\ts{b}\t+\t{o}:{o}" for a, b, o in arcs]
    return G.from_lines(spark.createDataFrame(list(enumerate(rows)), "line_no long, value string"))


@pytest.mark.parametrize("seed", [3, 4])
def test_what_reads_can_reach_is_enough(spark, monkeypatch, seed):
    monkeypatch.setattr(A, "small_flat", lambda *a: None)
    rng = random.Random(seed)
    texts, arcs, queries = random_case(rng, 8)
    reads = spark.createDataFrame([(i, q.decode()) for i, q in enumerate(queries)], "read_idx long, seq string")
    own = graph_of(spark, texts, arcs)
    assert {r.read_idx: r.score for r in A.graph_edit_distance(reads, own, start="s0").collect()} == {i: shortest(texts, arcs, 0, q) for i, q in enumerate(queries)}
    end = len(texts) - 1
    expected = {i: shortest(texts, arcs, 0, q, end) for i, q in enumerate(queries)}
    assert {r.read_idx: r.score for r in A.graph_edit_distance(reads, own, start="s0", end=f"s{end}").collect()} == {i: -1 if x is None else x for i, x in expected.items()}


def test_a_graph_of_any_size_is_cut_first(spark, monkeypatch):
    """3,000 segments are beyond the bound, what reads of twelve bases reach is not; the relational way is not taken."""
    monkeypatch.setattr(A, "MOST_BASES", 1000)
    monkeypatch.setattr(wavefront, "align", None)
    segments = spark.range(3_000).selectExpr("id as seg_id", "concat('s', id) as name", "repeat(substr('ACGT', cast(id % 4 + 1 as int), 1), 5) as seq")
    arcs = spark.range(2_999).selectExpr("id * 2 as v", "id * 2 + 2 as w", "cast(1 as int) as ow")
    reads = spark.createDataFrame([(0, "AAAAACCCCGGG"), (1, "AAAACCCC"), (2, "T"), (3, None)], "read_idx long, seq string")
    own = G.SequenceGraph(segments, arcs)
    assert {r.read_idx: r.score for r in A.graph_edit_distance(reads, own, start="s0").collect()} == {0: 0, 1: 1, 2: 1, 3: 0}
    reached = A.within(arcs, segments, 0, 24)
    # The first spells five characters, each further one four: the sixth is entered when 21 are spelled.
    assert sorted(r.v for r in reached.collect()) == [0, 2, 4, 6, 8, 10]
    assert [r.v for r in A.within(arcs, segments, 0, 5).collect()] == [0]
    assert A.projection(own, "s0", radius=9).count() == 2 + 1
    with pytest.raises(ValueError, match="too large"):
        A.score_reads(reads, A.small_flat(own, 0))


def test_whole_query(spark):
    rows = spark.createDataFrame(list(enumerate(["S\ta\tACGT", "S\tb\tGG", "S\tc\tT", "S\td\tCCA", "L\ta\t+\tb\t+\t0M", "L\ta\t+\tc\t+\t0M", "L\tb\t+\td\t+\t0M", "L\tc\t+\td\t+\t0M"])), "line_no long, value string")
    own = G.from_lines(rows).finalize()
    reads = spark.createDataFrame(list(enumerate(GOLDEN)), "read_idx long, seq string")
    assert [r.score for r in A.graph_edit_distance(reads, own).orderBy("read_idx").collect()] == list(GOLDEN.values())
    back = A.graph_edit_distance(spark.createDataFrame([(0, "TGGAACGT")], "read_idx long, seq string"), own, start="d", strand=1)
    assert back.first().score == 0
    with pytest.raises(ValueError):
        A.find_start(own, "nowhere")
    assert sorted(r.line for r in A.projection(own).collect())[0] == "L\t0\t+\t1\t+\t0M"


def test_overlap_over_a_whole_vertex_is_refused():
    with pytest.raises(ValueError):
        A.Flat([b"AC", b"G"], [(0, 1, 1)], 0)


def test_reachability_and_layers(spark):
    arcs = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (0, 2, 9), (2, 0, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)], "v long, w long, n long")
    start = spark.createDataFrame([(0,)], "v long")
    assert {r.v: r.hops for r in reach.levels(arcs, start).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r.v: r.dist for r in reach.distances(arcs, start, "n").collect()} == {0: 0, 1: 2, 2: 4}
    found = reach.topological(arcs, spark.range(6).withColumnRenamed("id", "v")).collect()
    assert {r.v: r.layer for r in found} == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 2}


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 20), (1, 8, 9), (1, 30, 30), (2, 0, 1)], "v long, vd0 long, vd1 long")
    assert sorted(tuple(r) for r in intervals.coalesce(rows, ["v"]).collect()) == [(1, 1, 5), (1, 7, 20), (2, 0, 1)]
    points = spark.createDataFrame([(1, x) for x in (0, 1, 4, 5, 19, 20, 30)] + [(3, 1)], "v long, vd long")
    assert sorted(tuple(r) for r in intervals.outside(points, rows, ["v"]).collect()) == [(1, 0), (1, 5), (1, 20), (1, 30), (3, 1)]


def test_streams(spark, tmp_path):
    reads = spark.createDataFrame(list(enumerate(GOLDEN)), "read_idx long, seq string")
    reads.repartition(3).write.parquet(f"file://{tmp_path}/reads")
    stream = spark.readStream.schema(reads.schema).parquet(f"file://{tmp_path}/reads")
    query = scoring.write(scoring.scored(stream, A.Flat(*BUBBLE, 0)), f"file://{tmp_path}/scores", f"file://{tmp_path}/state")
    query.awaitTermination(60)
    found = {r.read_idx: r.score for r in spark.read.parquet(f"file://{tmp_path}/scores").collect()}
    assert found == dict(enumerate(GOLDEN.values()))


def test_windows_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.floor("value").cast("int").alias("score"))
    events.write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events")
    query = scoring.scores_by_window(stream, "ts", "1 hour", "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_equal_reads_are_scored_once(spark):
    graph = A.Flat(*BUBBLE, 0)
    reads = spark.createDataFrame([(i, q) for i, q in enumerate([*GOLDEN] * 20 + [None, ""])], "read_idx long, seq string")
    found = A.score_reads(reads, graph)
    assert [r.score for r in found.orderBy("read_idx").collect()] == [*GOLDEN.values()] * 20 + [0, 0]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("MapInArrow") :]  # distinct texts go into the kernel
