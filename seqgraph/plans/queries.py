"""Registered queries on the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.numbering import numbered
from ..operators import align, assembly, augment, bubbles, components, graph, intervals, likelihood, reach, shards, wavefront
from ..sources import fastx, gfa, sinks
from ..sources.storage import shared_dir, table
from . import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Scalar functions


@query(f"SELECT doc_id, reverse(translate({D.bases_sql('text')}, 'ACGT', 'TGCA')) AS rc FROM documents")
def revcomp_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.reverse_complement(D.bases("text")).alias("rc"))


@query("""SELECT p_partkey, p_partkey * 2 + p_size % 2 AS vid, p_partkey AS seg, p_size % 2 AS ori, xor(p_partkey * 2 + p_size % 2, 1) AS comp,
          (p_partkey * 2 + p_size % 2) * 4294967296 + (p_size - 25) + 1073741824 AS packed, p_size - 25 AS d FROM part""")
def vertex_pack(spark, sf):
    own = table(spark, sf, "part").withColumn("vid", S.vertex("p_partkey", F.col("p_size") % 2))
    packed = S.pack_diagonal("vid", F.col("p_size") - 25)
    return own.select("p_partkey", "vid", S.segment_of("vid").alias("seg"), S.strand_of("vid").alias("ori"), S.complement("vid").alias("comp"), packed.alias("packed"), S.diagonal_of(packed).alias("d"))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) % 8 AS kind FROM lineitem)
          SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q,
                 CASE kind WHEN 1 THEN q WHEN 2 THEN q + l_linenumber WHEN 3 THEN q WHEN 4 THEN NULL WHEN 5 THEN q ELSE 0 END AS ov,
                 CASE kind WHEN 1 THEN q WHEN 2 THEN q + q + 1 WHEN 3 THEN l_linenumber WHEN 4 THEN l_linenumber ELSE 0 END AS ow FROM x""")
def overlap_fields(spark, sf):
    q, n = F.col("q").cast("string"), F.col("l_linenumber").cast("string")
    own = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    forms = {
        0: F.lit("*"), 1: F.concat(q, F.lit("M")), 2: F.concat(q, F.lit("M"), n, F.lit("D"), (F.col("q") + 1).cast("string"), F.lit("I")), 3: F.concat_ws(":", q, n),
        4: F.concat(F.lit(":"), n), 5: F.concat(q, F.lit(":")), 6: q, 7: F.lit("abc"),
    }
    text = F.coalesce(*(F.when(F.col("q") % 8 == k, t) for k, t in forms.items()))
    return own.withColumn("o", S.overlap(text)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q", "o.ov", "o.ow")


@query("SELECT a.p_partkey, CAST(len(list_filter(range(1, least(length(a.p_name), length(b.p_name)) + 1), lambda n: a.p_name[1:n] = b.p_name[1:n])) AS INT) AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def common_extension(spark, sf):
    part = table(spark, sf, "part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return part.join(following, "p_partkey").select("p_partkey", S.common_extension("p_name", "b").alias("n"))


@query("""SELECT event_id, event_type AS kind, CAST(floor(value) AS INT) AS n,
          'KD:Z:' || event_type || chr(9) || 'NR:i:' || CAST(floor(value) AS INT) || chr(9) || 'XB:B:i,1,' || event_id AS text FROM events""")
def tag_fields(spark, sf):
    number = F.floor("value").cast("int").cast("string")
    fields = F.array(F.concat(F.lit("NR:i:"), number), F.concat(F.lit("KD:Z:"), F.col("event_type")), F.lit("bad"), F.lit("X:i:1"), F.lit("XQ:B:q,1"), F.concat(F.lit("XB:B:i,1,"), F.col("event_id").cast("string")), F.lit("NR:i:x"))
    own = table(spark, sf, "events").withColumn("tags", S.tags(fields))
    return own.select("event_id", S.tag_string("tags", "KD").alias("kind"), S.tag_int("tags", "NR").alias("n"), S.tags_text("tags").alias("text"))


@query("""SELECT event_id, 'KD:Z:' || event_type || chr(9) || 'NR:i:' || (event_id % 7) || chr(9) || CASE WHEN event_id % 3 = 0 THEN 'XF:f:0.5' || chr(9) ELSE '' END || 'XU:A:' || substr(event_type, 1, 1) AS text FROM events""")
def tag_updates(spark, sf):
    """A tag replaced, one added, one deleted; the others stay."""
    fields = F.array(F.lit("NR:i:1"), F.concat(F.lit("KD:Z:"), F.col("event_type")), F.when(F.col("event_id") % 3 == 0, "XF:f:0.5").otherwise("bad"), F.lit("XB:B:i,1,2"))
    own = S.without_tag(S.with_tag(S.tags(fields), "NR", "i", F.col("event_id") % 7), "XB")
    return table(spark, sf, "events").select("event_id", S.tags_text(S.with_tag(own, "XU", "A", F.substr("event_type", F.lit(1), F.lit(1)))).alias("text"))


def _written(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""{D.GRAPH_SQL} SELECT 'S' AS kind, name AS a, seq AS b, CAST(len AS INT) AS n FROM segments
           UNION ALL SELECT 'L', 's' || (v >> 1), 's' || (w >> 1), CAST(least(ov, ow) AS INT) FROM whole""")
def gfa_files(spark, sf):
    """Segments and links written as GFA with CRLF line ends, compressed, among lines of other kinds, and read back."""
    own, path = D.segments(spark, sf), _written(spark, "gfa")
    lines = sinks.segment_text(own.select("name", "seq", "len")).unionByName(sinks.arc_text(D.whole_arcs(spark, sf), own))
    other = own.where("seg_id % 5 = 0").select(F.explode(F.array(F.lit("H\tVN:Z:1.0"), F.lit(""), F.lit("S"), F.concat(F.lit("#\t"), "name"))).alias("line"))
    lines.unionByName(other).select(F.concat("line", F.lit("\r"))).write.option("compression", "gzip").text(path)
    back = gfa.lines(spark, path)
    segments = gfa.segment_lines(back).select(F.lit("S").alias("kind"), F.col("name").alias("a"), F.col("seq").alias("b"), F.col("len").cast("int").alias("n"))
    return segments.unionByName(gfa.link_lines(back).select(F.lit("L").alias("kind"), F.col("v_name").alias("a"), F.col("w_name").alias("b"), F.col("ov").cast("int").alias("n")))


# Sources and sinks


@query(f"WITH {D.SEGMENTS_SQL} SELECT name, seq, CAST(len AS INT) AS len, sn, so, sr FROM segments")
def gfa_segments(spark, sf):
    own = D.segments(spark, sf)
    extra = F.concat_ws("\t", F.concat(F.lit("SN:Z:"), F.col("sn")), F.concat(F.lit("SO:i:"), F.col("so")), F.concat(F.lit("SR:i:"), F.col("sr")))
    lines = own.select(F.col("seg_id").alias("line_no"), F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), extra).alias("value"))
    headers = own.select(F.lit(0).cast("long").alias("line_no"), F.lit("H\tVN:Z:1.0").alias("value")).limit(1)
    return gfa.segment_lines(lines.unionByName(headers)).select("name", "seq", "len", "sn", "so", "sr")


@query(f"{D.GRAPH_SQL} SELECT link_id AS line_no, 's' || (v >> 1) AS v_name, CAST(v & 1 AS INT) AS v_ori, 's' || (w >> 1) AS w_name, CAST(w & 1 AS INT) AS w_ori, ov, ow, rank FROM whole")
def gfa_links(spark, sf):
    name = lambda c: F.concat(F.lit("s"), S.segment_of(c))
    strand = lambda c: F.when(S.strand_of(c) == 1, "-").otherwise("+")
    own = D.whole_arcs(spark, sf)
    lines = own.select(F.col("link_id").alias("line_no"), F.concat_ws("\t", F.lit("L"), name("v"), strand("v"), name("w"), strand("w"), F.concat_ws(":", "ov", "ow"), F.concat(F.lit("SR:i:"), F.col("rank"))).alias("value"))
    return gfa.link_lines(lines).select("line_no", "v_name", "v_ori", "w_name", "w_ori", "ov", "ow", "rank")


@query(f"""{D.GRAPH_SQL} SELECT 'S' || chr(9) || name || chr(9) || coalesce(seq, '*') || chr(9) || 'LN:i:' || len AS line FROM segments
           UNION ALL SELECT concat_ws(chr(9), 'L', 's' || (v >> 1), CASE WHEN v & 1 = 1 THEN '-' ELSE '+' END, 's' || (w >> 1), CASE WHEN w & 1 = 1 THEN '-' ELSE '+' END, least(ov, ow) || 'M') FROM whole""")
def gfa_text(spark, sf):
    own = D.segments(spark, sf)
    return sinks.segment_text(own.select("name", "seq", "len")).unionByName(sinks.arc_text(D.whole_arcs(spark, sf), own))


@query("""WITH f AS (SELECT l_partkey AS name, min(struct_pack(a := l_orderkey, b := l_linenumber)) AS first FROM lineitem GROUP BY l_partkey)
          SELECT name, row_number() OVER (ORDER BY first, name) - 1 AS seg_id FROM f""")
def dict_encode_names(spark, sf):
    return gfa.dictionary(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), "l_orderkey", "l_linenumber"), "name", [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""SELECT 's' || row_number() OVER (ORDER BY conv_id, turn) AS name, role AS sn, replace(text, chr(10), '') AS seq, CAST(length(replace(text, chr(10), '')) AS INT) AS len FROM conversations""")
def fasta_segments(spark, sf):
    turns = table(spark, sf, "conversations")
    lines = F.concat(F.array(F.concat(F.lit(">"), F.col("role"), F.lit(" said"))), F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "^>", "")))
    own = turns.select(F.col("conv_id").alias("file"), "turn", F.posexplode(lines).alias("at", "value"))
    own = own.select("file", (F.col("turn") * 1_000_000 + F.col("at")).alias("line_no"), "value")
    return gfa.fasta_segments(own).select("name", "sn", "seq", "len")


@query(f"""WITH x AS (SELECT doc_id, {D.bases_sql("text")} AS seq FROM documents)
           SELECT doc_id, 'doc' || doc_id AS name, source AS comment, seq, doc_id % 10 <> 0 AS valid FROM x JOIN documents USING (doc_id)""")
def fastq_reads(spark, sf):
    """CRLF line ends; sequences and qualities span lines, and a line of quality begins with @.

    Some texts begin with empty lines or with lines that are no record, some records begin with > and have a quality,
    some begin with @ and have none.
    """
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), D.fastq_text("text", "doc_id", "source").alias("text"))
    return fastx.whole_texts(own).select(F.col("file").alias("doc_id"), "name", "comment", "seq", "valid")


@query(f"""WITH x AS (SELECT doc_id, {D.bases_sql("text")} AS seq FROM documents)
           SELECT row_number() OVER (ORDER BY doc_id) - 1 AS read_idx, 'doc' || doc_id AS name, source AS comment, seq, doc_id % 10 <> 0 AS valid FROM x JOIN documents USING (doc_id)""")
def fastx_files(spark, sf):
    """The same records written as files in order of doc_id, and read by the data source in parts of 64 kB."""
    docs = table(spark, sf, "documents")
    text = F.regexp_replace(D.fastq_text("text", "doc_id", "source"), r"\n\z", "")  # each value ends with a line feed of its own
    path = f"{shared_dir(spark)}/fastx-{uuid.uuid4().hex}"
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(text.alias("value")).write.text(path)
    return gfa.read_reads(spark, path, bytes="65536").select("read_idx", "name", "comment", "seq", "valid")


# Normalising and inspecting the graph


@query(f"{D.GRAPH_SQL} SELECT link_id, v, w FROM arcs WHERE (v >> 1) IN (SELECT seg_id FROM segments WHERE len > 0) AND (w >> 1) IN (SELECT seg_id FROM segments WHERE len > 0)")
def missing_segments(spark, sf):
    return graph.live_arcs(D.arcs(spark, sf), D.segments(spark, sf)).select("link_id", "v", "w")


_MIXED = """mixed AS (SELECT v, w, ov, ow, link_id FROM arcs UNION ALL SELECT xor(w, 1), xor(v, 1), ov + 1, ov, -link_id FROM arcs WHERE rank % 2 = 0)"""


def _mixed(spark, sf):
    """The arcs, and complements of some of them."""
    own = D.arcs(spark, sf)
    other = own.where("rank % 2 = 0").select(S.complement("w").alias("v"), S.complement("v").alias("w"), (F.col("ov") + 1).alias("ov"), F.col("ov").alias("ow"), (-F.col("link_id")).alias("link_id"))
    return own.select("v", "w", "ov", "ow", "link_id").unionByName(other)


@query(f"""{D.GRAPH_SQL}, {_MIXED}, c AS (SELECT xor(w, 1) AS v, xor(v, 1) AS w, count(*) AS n, max(ow) AS c_ov, max(ov) AS c_ow FROM mixed GROUP BY ALL),
           m AS (SELECT mixed.v, mixed.w, link_id, coalesce(ov, CASE WHEN n = 1 THEN c_ov END) AS ov, coalesce(ow, CASE WHEN n = 1 THEN c_ow END) AS ow FROM mixed LEFT JOIN c ON mixed.v = c.v AND mixed.w = c.w)
           SELECT * FROM m WHERE ov IS NOT NULL AND ow IS NOT NULL""")
def semi_arc_fill(spark, sf):
    return graph.fill_overlaps(_mixed(spark, sf)).select("v", "w", "link_id", "ov", "ow")


@query(f"""{D.GRAPH_SQL} SELECT v, w, ov, ow, false AS comp FROM whole UNION ALL
           SELECT DISTINCT xor(w, 1), xor(v, 1), ow, ov, true FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.v = xor(a.w, 1) AND b.w = xor(a.v, 1) AND b.ov = a.ow AND b.ow = a.ov)""")
def complement_closure(spark, sf):
    return graph.close_complement(D.whole_arcs(spark, sf)).select("v", "w", "ov", "ow", "comp")


@query(f"""{D.GRAPH_SQL} SELECT link_id, CAST(least(ov * 5, a.len) AS INT) AS ov, CAST(least(ow * 5, b.len) AS INT) AS ow FROM whole JOIN segments a ON a.seg_id = v >> 1 JOIN segments b ON b.seg_id = w >> 1""")
def arc_clamp(spark, sf):
    own = D.whole_arcs(spark, sf).withColumn("ov", F.col("ov") * 5).withColumn("ow", F.col("ow") * 5)
    return graph.clamp_overlaps(own, D.segments(spark, sf)).select("link_id", "ov", "ow")


@query(f"{D.GRAPH_SQL} SELECT v, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM arcs GROUP BY v")
def degree_index(spark, sf):
    return graph.degrees(D.arcs(spark, sf)).select("v", "n", "start")


@query(f"{D.GRAPH_SQL} SELECT degree, count(*) AS vertices FROM (SELECT v, count(*) AS degree FROM arcs GROUP BY v) GROUP BY degree")
def degree_profile(spark, sf):
    return graph.degree_profile(D.arcs(spark, sf))


@query(f"{D.GRAPH_SQL} SELECT v, w, count(*) - 1 AS surplus FROM arcs GROUP BY v, w HAVING count(*) > 1")
def multi_arc_count(spark, sf):
    return graph.surplus_arcs(D.arcs(spark, sf))


@query(f"""{D.GRAPH_SQL}, a AS (SELECT *, v < xor(w, 1) AS own, least(v, xor(w, 1)) AS cv, CASE WHEN v < xor(w, 1) THEN w ELSE xor(v, 1) END AS cw FROM arcs WHERE w <> xor(v, 1)),
           s AS (SELECT cv, cw, max(own) AS own FROM (SELECT cv, cw, own FROM a GROUP BY ALL HAVING count(*) > 1) GROUP BY cv, cw),
           k AS (SELECT cv, cw, link_id AS winner FROM (SELECT a.*, row_number() OVER (PARTITION BY cv, cw ORDER BY rank, ov DESC, link_id) AS rn FROM a JOIN s USING (cv, cw, own)) WHERE rn = 1)
           SELECT v, w, link_id FROM a LEFT JOIN k USING (cv, cw) WHERE winner IS NULL OR link_id = winner UNION ALL SELECT v, w, link_id FROM arcs WHERE w = xor(v, 1)""")
def multi_arc_best(spark, sf):
    return graph.best_parallel(D.arcs(spark, sf)).select("v", "w", "link_id")


@query(f"{D.GRAPH_SQL} SELECT sn, min(so) AS start, CAST(max(so + len) AS INT) AS end, min(sr) AS rank, min(sr) = max(sr) AS ranks_agree FROM segments GROUP BY sn")
def stable_seq_ranges(spark, sf):
    return graph.stable_ranges(D.segments(spark, sf))


@query(f"""WITH {D.SEGMENTS_SQL}, r AS (SELECT c_custkey AS region, 'Brand#' || (1 + c_custkey % 5) || (1 + c_nationkey % 5) AS sn, c_custkey % 500 AS a, c_custkey % 500 + c_nationkey AS b FROM customer)
           SELECT region, seg_id, CAST(greatest(a, so) AS BIGINT) AS start, CAST(least(b, so + len) AS BIGINT) AS end FROM r JOIN segments USING (sn) WHERE so < b AND a < so + len AND a < b AND len > 0""")
def segments_in_regions(spark, sf):
    """A region for each customer, on one of the brands' sequences."""
    start = F.col("c_custkey") % 500
    sn = F.concat(F.lit("Brand#"), (1 + F.col("c_custkey") % 5).cast("string"), (1 + F.col("c_nationkey") % 5).cast("string"))
    regions = table(spark, sf, "customer").select(F.col("c_custkey").alias("region"), sn.alias("sn"), start.alias("start"), (start + F.col("c_nationkey")).alias("end"))
    return graph.in_regions(D.segments(spark, sf), regions, width=20)


@query(f"""WITH {D.ORDERS_SQL}, st AS (SELECT 'c' || c AS path, v, lag(v) OVER o AS p, row_number() OVER o AS step FROM (SELECT orows.*, o_orderdate FROM orows JOIN orders ON o_orderkey = k) WINDOW o AS (PARTITION BY c ORDER BY o_orderdate, k)),
           a AS (SELECT v, w, min(ow) AS ow FROM oarc GROUP BY v, w)
           SELECT path, string_agg(substr(t, 1 + coalesce(a.ow, 0)), '' ORDER BY step) AS seq FROM st JOIN overt ON overt.v = st.v LEFT JOIN a ON a.v = st.p AND a.w = st.v GROUP BY path""")
def path_spellings(spark, sf):
    """A P line for each customer's orders, read and spelled."""
    key = F.col("o_orderkey")
    step = F.struct("o_orderdate", key, F.concat(F.lit("o"), key.cast("string"), F.when(key % 5 == 0, "-").otherwise("+")).alias("t"))
    ways = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(step)).alias("x"))
    lines = ways.select(F.col("o_custkey").cast("long").alias("line_no"), F.concat_ws("\t", F.lit("P"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.array_join(F.transform("x", lambda x: x["t"]), ","), F.lit("*")).alias("value"))
    return graph.spell(gfa.path_steps(lines), D.order_segments(spark, sf), D.order_arcs(spark, sf))


@query(f"{D.GRAPH_SQL} SELECT link_id, v, w FROM arcs WHERE (v >> 1) NOT IN (SELECT seg_id FROM segments WHERE sr = 0) AND (w >> 1) NOT IN (SELECT seg_id FROM segments WHERE sr = 0)")
def delete_segments(spark, sf):
    return graph.delete_segments(D.arcs(spark, sf), D.segments(spark, sf).where("sr = 0").select("seg_id")).select("link_id", "v", "w")


@query(f"{D.GRAPH_SQL} SELECT link_id, v, w FROM arcs a WHERE NOT EXISTS (SELECT 1 FROM arcs b WHERE b.v = a.w AND b.w = a.v)")
def delete_arcs(spark, sf):
    """Arcs without those that another one runs against."""
    own = D.arcs(spark, sf)
    return graph.delete_arcs(own, own.select(F.col("w").alias("v"), F.col("v").alias("w"))).select("link_id", "v", "w")


@query(f"""{D.GRAPH_SQL}, x AS (SELECT 's' || (v >> 1) AS name, ov + rank AS n FROM whole UNION ALL SELECT 's' || (w >> 1), ow + 2 * rank FROM whole)
           SELECT name, CAST(max(n) AS INT) AS implied FROM x GROUP BY name""")
def implied_lengths(spark, sf):
    own = D.whole_arcs(spark, sf)
    name = lambda c: F.concat(F.lit("s"), S.segment_of(c))
    strand = lambda c: F.when(S.strand_of(c) == 1, "-").otherwise("+")
    beyond = [F.concat(F.lit("L1:i:"), F.col("rank")), F.concat(F.lit("L2:i:"), F.col("rank") * 2)]
    lines = own.select(F.col("link_id").alias("line_no"), F.concat_ws("\t", F.lit("L"), name("v"), strand("v"), name("w"), strand("w"), F.concat_ws(":", "ov", "ow"), *beyond).alias("value"))
    return graph.implied_lengths(gfa.link_lines(lines))


@query("SELECT max(p_size % 5) AS max_rank FROM part")
def max_rank(spark, sf):
    return graph.max_rank(D.segments(spark, sf))


@query(f"""{D.GRAPH_SQL} SELECT concat_ws(chr(9), 'S', name, coalesce(seq, '*'), 'LN:i:' || len, 'SN:Z:' || sn, 'SO:i:' || so, 'SR:i:' || sr) AS line FROM segments
           UNION ALL SELECT concat_ws(chr(9), 'L', 's' || (v >> 1), CASE WHEN v & 1 = 1 THEN '-' ELSE '+' END, 's' || (w >> 1), CASE WHEN w & 1 = 1 THEN '-' ELSE '+' END,
               CASE WHEN ov = ow THEN ov || 'M' ELSE ov || ':' || ow END, 'SR:i:' || rank, 'L1:i:' || (a.len - ov), 'L2:i:' || (b.len - ow), 'li:i:' || link_id)
           FROM whole JOIN segments a ON a.seg_id = v >> 1 JOIN segments b ON b.seg_id = w >> 1""")
def gfa_text_tagged(spark, sf):
    own = D.segments(spark, sf)
    kind = F.struct(F.lit("i").alias("type"), F.col("link_id").cast("string").alias("value"))
    arcs = D.whole_arcs(spark, sf).withColumn("tags", F.create_map(F.lit("li"), kind))
    return sinks.segment_text(own).unionByName(sinks.arc_text(arcs, own, both_lengths=True, with_tags=True))


@query(f"""{D.GRAPH_SQL}, p AS (SELECT DISTINCT w AS v, v AS w FROM arcs), c AS (SELECT v, w, count(*) AS n, min(link_id) AS link_id FROM arcs GROUP BY v, w)
           SELECT p.v, p.w, CASE WHEN n IS NULL THEN -1 WHEN n > 1 THEN -2 ELSE link_id END AS found FROM p LEFT JOIN c ON p.v = c.v AND p.w = c.w""")
def find_arcs(spark, sf):
    own = D.arcs(spark, sf)
    return graph.find_arcs(own.select(F.col("w").alias("v"), F.col("v").alias("w")).distinct(), own)


# Reachability


def _start(spark, sf):
    return D.arcs(spark, sf).agg(F.min("v").alias("v"))


@query(f"""WITH RECURSIVE {D.SEGMENTS_SQL}, {D.ARCS_SQL}, e AS (SELECT DISTINCT v, w FROM arcs),
           r(v, hops) AS (SELECT min(v), 0 FROM arcs UNION SELECT e.w, hops + 1 FROM r JOIN e ON e.v = r.v WHERE hops < 30)
           SELECT v, min(hops) AS hops FROM r GROUP BY v""")
def reachable_from(spark, sf):
    return reach.levels(D.arcs(spark, sf), _start(spark, sf))


@query(f"""WITH RECURSIVE {D.SEGMENTS_SQL}, {D.ARCS_SQL},
           e AS (SELECT v, w, min(greatest(len - ow, 0)) AS n FROM whole JOIN segments ON seg_id = w >> 1 GROUP BY v, w),
           r(v, dist) AS (SELECT min(v), 0 FROM arcs UNION SELECT e.w, dist + n FROM r JOIN e ON e.v = r.v WHERE dist + n <= 40)
           SELECT v, CAST(min(dist) AS BIGINT) AS dist FROM r GROUP BY v""")
def shortest_reach(spark, sf):
    own = D.whole_arcs(spark, sf).join(D.segments(spark, sf).select("seg_id", "len"), S.segment_of("w") == F.col("seg_id"))
    return reach.distances(own.withColumn("n", S.beyond("len", "ow")), _start(spark, sf), "n")


@query(f"""{D.GRAPH_SQL}, a AS (SELECT min(v) AS v FROM arcs), b AS (SELECT v FROM a UNION SELECT w FROM arcs WHERE v IN (SELECT v FROM a)),
           c AS (SELECT v FROM b UNION SELECT w FROM arcs WHERE v IN (SELECT v FROM b)) SELECT link_id, v, w FROM arcs WHERE v IN (SELECT v FROM c) AND w IN (SELECT v FROM c)""")
def subgraph_arcs(spark, sf):
    own = D.arcs(spark, sf)
    return reach.subgraph(own, reach.levels(own, _start(spark, sf), most=2)).select("link_id", "v", "w")


@query(f"""WITH RECURSIVE {D.SEGMENTS_SQL}, {D.ARCS_SQL}, e AS (SELECT DISTINCT v, w FROM arcs),
           r(v) AS (SELECT min(v) FROM arcs UNION SELECT e.w FROM r JOIN e ON e.v = r.v)
           SELECT link_id, v, w FROM arcs WHERE v IN (SELECT v FROM r) AND w IN (SELECT v FROM r)""")
def reachable_subgraph(spark, sf):
    own = D.arcs(spark, sf)
    return reach.subgraph(own, reach.levels(own, _start(spark, sf))).select("link_id", "v", "w")


@query("""SELECT 'r' || r_regionkey AS v, 0 AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
          UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 3 ELSE 1 END FROM orders
          UNION ALL SELECT DISTINCT 'c' || o_custkey, 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def topological_layers(spark, sf):
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    arcs = table(spark, sf, "nation").select(key("r", "n_regionkey").alias("v"), key("n", "n_nationkey").alias("w"))
    arcs = arcs.unionByName(table(spark, sf, "customer").select(key("n", "c_nationkey").alias("v"), key("c", "c_custkey").alias("w")))
    arcs = arcs.unionByName(table(spark, sf, "orders").select(key("c", "o_custkey").alias("v"), key("o", "o_orderkey").alias("w")))
    regions = table(spark, sf, "region").select(key("r", "r_regionkey").alias("v"))
    return reach.topological(arcs, arcs.select("v").unionByName(arcs.select(F.col("w").alias("v"))).unionByName(regions))


# Components and assembly graphs


def _orders(spark, sf):
    """Arcs and vertices of the graph of orders."""
    vertices = D.order_segments(spark, sf).select(F.explode(F.array(F.col("seg_id") * 2, F.col("seg_id") * 2 + 1)).alias("v"))
    return D.order_arcs(spark, sf), vertices


@query(f"""WITH RECURSIVE {D.ORDERS_SQL}, r(v, x) AS (SELECT v, v FROM overt UNION SELECT r.v, oarc.w FROM r JOIN oarc ON oarc.v = r.x)
           SELECT a.v, min(a.x) AS component FROM r a JOIN r b ON a.v = b.x AND a.x = b.v GROUP BY a.v""")
def strong_components(spark, sf):
    return components.strong(*_orders(spark, sf))


_UNITIGS_SQL = f"""{D.ORDERS_SQL}, s AS (SELECT v, w, ow FROM (SELECT *, count(*) OVER (PARTITION BY v) AS a, count(*) OVER (PARTITION BY w) AS b FROM oarc) WHERE a = 1 AND b = 1 AND w <> xor(v, 1)),
    lin(u, v, step) AS (SELECT v, v, 0 FROM overt WHERE v NOT IN (SELECT w FROM s) UNION ALL SELECT u, s.w, step + 1 FROM lin JOIN s ON s.v = lin.v),
    cyc(v, x) AS (SELECT w, w FROM s WHERE w NOT IN (SELECT v FROM lin) UNION SELECT cyc.v, s.w FROM cyc JOIN s ON s.v = cyc.x),
    ch AS (SELECT v, min(x) AS head FROM cyc GROUP BY v),
    rnd(u, v, step) AS (SELECT head, head, 0 FROM ch WHERE v = head UNION ALL SELECT u, s.w, step + 1 FROM rnd JOIN s ON s.v = rnd.v WHERE s.w <> u),
    steps AS (SELECT u, v, step, false AS circular FROM lin UNION ALL SELECT u, v, step, true FROM rnd),
    kept AS (SELECT u FROM (SELECT u, circular, arg_max(v, step) AS last, min(xor(v, 1)) AS least FROM steps GROUP BY u, circular) WHERE u < CASE WHEN circular THEN least ELSE xor(last, 1) END),
    u AS (SELECT steps.*, s.ow FROM steps JOIN kept USING (u) LEFT JOIN s ON s.w = steps.v)"""


@query(f"""WITH RECURSIVE {_UNITIGS_SQL} SELECT u AS unitig, string_agg(substr(t, 1 + coalesce(ow, 0)), '' ORDER BY step) AS seq, count(*) AS n, any_value(circular) AS circular FROM u JOIN overt USING (v) GROUP BY u""")
def unitigs(spark, sf):
    return assembly.unitig_graph(D.order_arcs(spark, sf), D.order_segments(spark, sf))[0]


@query(f"""WITH RECURSIVE {_UNITIGS_SQL}, p AS (SELECT v, u * 2 AS u FROM u UNION ALL SELECT xor(v, 1), u * 2 + 1 FROM u)
           SELECT a.u AS v, b.u AS w, ov, ow FROM oarc JOIN p a ON a.v = oarc.v JOIN p b ON b.v = oarc.w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.v = oarc.v AND s.w = oarc.w)""")
def unitig_arcs(spark, sf):
    return assembly.unitig_graph(D.order_arcs(spark, sf), D.order_segments(spark, sf))[1]


@query(f"""{D.GRAPH_SQL}, n AS (SELECT v, w, min(len - ov) AS n FROM whole JOIN segments ON seg_id = v >> 1 GROUP BY v, w),
           g AS (SELECT a.v, b.w FROM n a JOIN n b ON b.v = a.w JOIN n c ON c.v = a.v AND c.w = b.w WHERE a.n + b.n <= c.n + 20 AND greatest(a.n, b.n) < c.n)
           SELECT v, w FROM g UNION SELECT xor(w, 1), xor(v, 1) FROM g""")
def transitive_arcs(spark, sf):
    return assembly.transitive_arcs(D.whole_arcs(spark, sf), D.segments(spark, sf), fuzz=20)


@query()
def superbubbles(spark, sf):
    """Bubbles of the graph of orders; against their definition in the tests."""
    return bubbles.superbubbles(D.order_arcs(spark, sf))


@query()
def drop_tips(spark, sf):
    """The graph of orders without tips of up to three orders and 60 bases; against brute force in the tests."""
    sized = D.order_segments(spark, sf).select(F.explode(F.array(F.col("seg_id") * 2, F.col("seg_id") * 2 + 1)).alias("v"), "len")
    return assembly.drop_tips(D.order_links(spark, sf), sized, most_steps=3, most_length=60)


# Insertions into the graph of orders, its arcs taken without overlaps


def _augmented(spark, sf):
    segments, arcs = D.order_segments(spark, sf), D.order_arcs(spark, sf).select("v", "w", F.lit(0).alias("ov"), F.lit(0).alias("ow")).distinct()
    return augment.augment(graph.SequenceGraph(segments, arcs), D.order_insertions(spark, sf))[0]


_AUGMENTED_SQL = f"""{D.ORDERS_SQL}, {D.INSERTIONS_SQL},
    told AS (SELECT min(name) AS name, v, v_at, w, w_at, seq FROM (SELECT *, CASE WHEN v % 2 = 1 THEN vn - v_off ELSE v_off END AS v_at, CASE WHEN w % 2 = 1 THEN wn - w_off ELSE w_off END AS w_at FROM ins) GROUP BY v, v_at, w, w_at, seq),
    cuts AS (SELECT seg_id, 0 AS a FROM oseg UNION SELECT v >> 1, v_at FROM told JOIN oseg ON seg_id = v >> 1 WHERE v_at < length(oseg.seq)
             UNION SELECT w >> 1, w_at FROM told JOIN oseg ON seg_id = w >> 1 WHERE w_at < length(oseg.seq)),
    spans AS (SELECT seg_id, name, seq, length(seq) AS n, a, lead(a, 1, length(seq)) OVER (PARTITION BY seg_id ORDER BY a) AS b FROM cuts JOIN oseg USING (seg_id)),
    piece AS (SELECT seg_id, n, a, b, CASE WHEN b - a = n THEN name ELSE name || ':' || a || '-' || b END AS name, substr(seq, a + 1, b - a) AS seq FROM spans),
    side AS (SELECT seg_id * 2 AS v, a AS enters, b AS leaves, a = 0 AS first, b = n AS last, name, 0 AS s FROM piece UNION ALL SELECT seg_id * 2 + 1, b, a, b = n, a = 0, name, 1 FROM piece)"""


@query(f"WITH {_AUGMENTED_SQL} SELECT name, seq, length(seq) AS len FROM piece UNION ALL SELECT name, seq, length(seq) FROM told WHERE seq <> ''")
def augmented_segments(spark, sf):
    return _augmented(spark, sf).segments.select("name", "seq", "len")


@query(f"""WITH {_AUGMENTED_SQL},
    one AS (SELECT a.name AS x, a.s AS p, b.name AS y, b.s AS q FROM oarc JOIN side a ON a.v = oarc.v AND a.last JOIN side b ON b.v = oarc.w AND b.first
            UNION SELECT a.name, a.s, b.name, b.s FROM side a JOIN side b ON a.v = b.v AND a.leaves = b.enters
            UNION SELECT a.name, a.s, b.name, b.s FROM told JOIN side a ON a.v = told.v AND a.leaves = v_at JOIN side b ON b.v = told.w AND b.enters = w_at WHERE told.seq = ''
            UNION SELECT a.name, a.s, told.name, 0 FROM told JOIN side a ON a.v = told.v AND a.leaves = v_at WHERE told.seq <> ''
            UNION SELECT told.name, 0, b.name, b.s FROM told JOIN side b ON b.v = told.w AND b.enters = w_at WHERE told.seq <> '')
    SELECT x AS v_name, p AS v_ori, y AS w_name, q AS w_ori FROM one UNION SELECT y, 1 - q, x, 1 - p FROM one""")
def augmented_arcs(spark, sf):
    own = _augmented(spark, sf)
    of = lambda p: own.segments.select(F.col("seg_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    # Of an arc and its complement one is named, and gives both.
    half = own.arcs.select("v", "w").where(F.col("v") <= S.complement("w"))
    met = half.join(of("v"), S.segment_of("v") == F.col("v_id")).join(of("w"), S.segment_of("w") == F.col("w_id"))
    v, w = S.strand_of("v").cast("int"), S.strand_of("w").cast("int")
    side = lambda a, p, b, q: F.struct(F.col(a).alias("v_name"), p.alias("v_ori"), F.col(b).alias("w_name"), q.alias("w_ori"))
    there, back = side("v_name", v, "w_name", w), side("w_name", 1 - w, "v_name", 1 - v)
    return met.select(F.inline(F.when(F.col("v") == S.complement("w"), F.array(there)).otherwise(F.array(there, back))))


# Wavefront steps and intervals


@query(f"WITH {D.DIAGONALS_SQL} SELECT v, d, max(k) AS k FROM states GROUP BY v, d")
def diag_dedup_maxk(spark, sf):
    return wavefront.furthest(D.diagonals(spark, sf), ["v", "d"])


@query(f"""WITH {D.DIAGONALS_SQL}, x AS (SELECT DISTINCT v, d FROM states), y AS (SELECT v, d, d - row_number() OVER (PARTITION BY v ORDER BY d) AS run FROM x)
           SELECT v, min(d) AS first, max(d) AS last, count(*) AS n FROM y GROUP BY v, run""")
def diag_runs(spark, sf):
    return wavefront.runs(D.diagonals(spark, sf).select("v", "d").distinct(), ["v"])


@query(f"""WITH {D.DIAGONALS_SQL}, x AS (SELECT v, d, max(k) AS k FROM states GROUP BY v, d),
           y AS (SELECT v, d + 1 AS d, k FROM x UNION ALL SELECT v, d, k + 1 FROM x UNION ALL SELECT v, d - 1, k + 1 FROM x) SELECT v, d, max(k) AS k FROM y GROUP BY v, d""")
def wavefront_stencil(spark, sf):
    return wavefront.stencil(wavefront.furthest(D.diagonals(spark, sf), ["v", "d"]), ["v"])


@query(f"""WITH {D.DIAGONALS_SQL}, x AS (SELECT v, d, k, 1500 AS ql, 1000 AS vl FROM states)
           SELECT v, d, k, CASE WHEN d + k = ql - 1 THEN 'query_end' WHEN k = vl - 1 THEN 'vertex_end' ELSE 'inside' END AS kind FROM x WHERE d + k < ql AND k < vl""")
def wavefront_bounds(spark, sf):
    own = D.diagonals(spark, sf).withColumn("ql", F.lit(1500)).withColumn("vl", F.lit(1000))
    return wavefront.bounded(own, "ql", "vl").select("v", "d", "k", wavefront.kind("ql", "vl").alias("kind"))


@query(f"{D.GRAPH_SQL} SELECT seg_id AS read_idx, whole.w AS v, CAST(sr + len - 1 - ow + 1 AS INT) AS d, ow - 1 AS k FROM segments JOIN whole ON whole.v = seg_id * 2 WHERE len > 0")
def arc_expand(spark, sf):
    states = D.segments(spark, sf).where("len > 0").select(F.col("seg_id").alias("read_idx"), (F.col("seg_id") * 2).alias("v"), F.col("sr").alias("d"), (F.col("len") - 1).alias("k"))
    return wavefront.expand(states, D.whole_arcs(spark, sf))


@query(f"WITH {D.SPANS_SQL} {D.coalesce_sql('spans')}")
def interval_coalesce(spark, sf):
    return intervals.coalesce(D.spans(spark, sf), ["v"])


@query(f"WITH {D.SPANS_SQL}, u AS (SELECT * FROM spans WHERE event_type IN ('click', 'error')) {D.coalesce_sql('u')}")
def interval_union(spark, sf):
    own = D.spans(spark, sf)
    return intervals.union(own.where("event_type = 'click'"), own.where("event_type = 'error'"), ["v"])


@query(f"""WITH {D.SPANS_SQL} SELECT event_id, v, vd0 AS vd FROM spans p WHERE event_type <> 'error'
           AND NOT EXISTS (SELECT 1 FROM spans i WHERE i.event_type = 'error' AND i.v = p.v AND p.vd0 >= i.vd0 AND p.vd0 < i.vd1)""")
def forbidden_filter(spark, sf):
    own = D.spans(spark, sf)
    return intervals.outside(own.where("event_type <> 'error'").select("event_id", "v", F.col("vd0").alias("vd")), own.where("event_type = 'error'"), ["v"])


# Alignment

_SCORES = "x AS (SELECT DISTINCT upper(p_name) AS q FROM part), s AS (SELECT q, min(levenshtein(q, t[1:n])) AS score FROM x, {walks}, range(0, 40) AS l(n) WHERE n <= length(t) GROUP BY q)"


@query("""WITH x AS (SELECT DISTINCT upper(p_name) AS q FROM part),
          t AS (SELECT string_agg(upper(r.r_name), '' ORDER BY r.r_regionkey) || upper(n_name) AS t FROM nation JOIN region r ON r.r_regionkey <= n_regionkey WHERE n_nationkey = 24 GROUP BY n_name)
          SELECT p_partkey AS read_idx, CAST(levenshtein(upper(p_name), t) AS INT) AS score FROM part, t""")
def fixed_end_align(spark, sf):
    """Reads against the walks that end at the end of one nation."""
    vertices, arcs = D.nations(spark, sf)
    return align.score_reads(D.part_reads(spark, sf), align.flat(vertices, arcs, 0, 124))


@query(f"WITH {D.WALKS_SQL}, {_SCORES.format(walks='walks')} SELECT p_partkey AS read_idx, CAST(score AS INT) AS score FROM part JOIN s ON q = upper(p_name)")
def lines_to_scores(spark, sf):
    """From GFA lines, with links on either strand, to a finished graph to scores."""
    own = graph.from_lines(D.nation_lines(spark, sf)).finalize()
    return align.graph_edit_distance(D.part_reads(spark, sf), own)


@query("""WITH s AS (SELECT r_regionkey AS id, upper(r_name) AS seq FROM region UNION ALL SELECT 5 + n_nationkey, upper(n_name) FROM nation),
          a AS (SELECT r_regionkey AS a, r_regionkey + 1 AS b FROM region WHERE r_regionkey < 4 UNION ALL SELECT n_regionkey, 5 + n_nationkey FROM nation)
          SELECT concat_ws(chr(9), 'S', id, seq, 'LN:i:' || length(seq)) AS line FROM s UNION ALL SELECT concat_ws(chr(9), 'L', a, '+', b, '+', '0M') FROM a""")
def projection_lines(spark, sf):
    return align.projection(graph.from_lines(D.nation_lines(spark, sf)).finalize())


@query(f"WITH walks AS (SELECT string_agg(upper(r_name), '' ORDER BY r_regionkey) AS t FROM region), {_SCORES.format(walks='walks')} SELECT p_partkey AS read_idx, CAST(score AS INT) AS score FROM part JOIN s ON q = upper(p_name)")
def linear_align(spark, sf):
    vertices, arcs = D.nations(spark, sf)
    chain = arcs.where("w < 100")
    return align.score_reads(D.part_reads(spark, sf), align.flat(vertices.where("v < 100"), chain, 0))


@query(f"WITH {D.WALKS_SQL}, {_SCORES.format(walks='walks')} SELECT p_partkey AS read_idx, CAST(score AS INT) AS score FROM part JOIN s ON q = upper(p_name)")
def bubble_align(spark, sf):
    vertices, arcs = D.nations(spark, sf)
    return align.score_reads(D.part_reads(spark, sf), align.flat(vertices, arcs, 0))


@query(f"WITH {D.WALKS_SQL}, {_SCORES.format(walks='walks')} SELECT CAST(score AS INT) AS score, count(*) AS n FROM part JOIN s ON q = upper(p_name) GROUP BY score")
def scores_summary(spark, sf):
    return bubble_align(spark, sf).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


# What is spelled from the first order on, by its customer's chain, up to twice the longest read.
@query(f"""WITH RECURSIVE {D.ORDERS_SQL}, p AS (SELECT p_partkey, {D.bases_sql("p_name")} AS q FROM part), far AS (SELECT 2 * max(length(q)) AS n FROM p),
           r(v, t) AS (SELECT v, t FROM overt WHERE v = (SELECT min(seg_id) * 2 FROM oseg) UNION SELECT o.v, r.t || substr(o.t, 1 + a.ow) FROM r JOIN oarc a ON a.v = r.v JOIN overt o ON o.v = a.w WHERE length(r.t) < (SELECT n FROM far)),
           pre AS (SELECT DISTINCT t[1:l.n] AS t FROM r, range(0, 200) AS l(n) WHERE l.n <= length(t) AND l.n <= (SELECT n FROM far)), d AS (SELECT DISTINCT q FROM p),
           s AS (SELECT q, min(levenshtein(q, t)) AS score FROM d, pre GROUP BY q)
           SELECT p_partkey AS read_idx, CAST(score AS INT) AS score FROM p JOIN s USING (q)""")
def shard_align(spark, sf):
    """Parts' names as reads, against the graph of orders in shards: what the reads can reach from the first order."""
    own = graph.SequenceGraph(D.order_segments(spark, sf), D.order_arcs(spark, sf))
    reads = table(spark, sf, "part").select(F.col("p_partkey").alias("read_idx"), D.bases("p_name").alias("seq"))
    start = align.find_start(own)
    vertices, arcs = align.oriented(own, start, align.needed_radius(reads, own, start))
    return shards.score(reads, vertices, arcs, start, bases=100)


@query(f"WITH {D.WALKS_SQL}, {_SCORES.format(walks='walks')} SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey AS read_idx, p_name AS name, CAST(score AS INT) AS score FROM part JOIN s ON q = upper(p_name)")
def score_file(spark, sf):
    """Scores written to files and read back: place is the line's, over all files."""
    names, path = table(spark, sf, "part").select(F.col("p_partkey").alias("read_idx"), F.col("p_name").alias("name")), _written(spark, "scores")
    sinks.write_scores(bubble_align(spark, sf).join(names, "read_idx"), path)
    back = spark.read.schema("read_idx long, name string, score int").csv(path, sep="\t")
    rows = back.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return numbered(rows, ["file", "line"], "place").select("place", "read_idx", "name", "score")


@query(f"""WITH t AS (SELECT reverse(translate(string_agg(upper(r.r_name), '' ORDER BY r.r_regionkey) || upper(n_name), '{S.BASES}', '{S.PAIRED}')) AS t
           FROM nation JOIN region r ON r.r_regionkey <= n_regionkey WHERE n_nationkey = 7 GROUP BY n_name), {_SCORES.format(walks='t')}
           SELECT p_partkey AS read_idx, CAST(score AS INT) AS score FROM part JOIN s ON q = upper(p_name)""")
def strand_align(spark, sf):
    """From a named segment, on its other strand, with a radius as far as these reads can tell a difference."""
    own = graph.from_lines(D.nation_lines(spark, sf)).finalize()
    return align.graph_edit_distance(D.part_reads(spark, sf), own, start="n7", strand=1, radius=200)


@query("SELECT c_custkey, s_suppkey, c_nationkey AS region FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def region_pairs(spark, sf):
    reads = table(spark, sf, "customer").select(F.col("c_nationkey").alias("region"), "c_custkey")
    haps = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("region"), "s_suppkey")
    return likelihood.pairs(reads, haps)


@query("""WITH n AS (SELECT n_nationkey, n_regionkey || ':' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS region FROM nation)
          SELECT region, 'read' AS kind, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS INT) AS idx, 'C' || c_custkey AS seq, repeat('I', length('C' || c_custkey)) AS q_base
          FROM customer JOIN n ON n_nationkey = c_nationkey
          UNION ALL SELECT region, 'hap', CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS INT), 'S' || s_suppkey, NULL FROM supplier JOIN n ON n_nationkey = s_nationkey""")
def region_lines(spark, sf):
    """A file for each region, in it a header, reads and haplotypes for each nation."""
    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    n_reads = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_reads"))
    n_haps = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_haps"))
    of = F.col("n_regionkey").alias("file")
    place = lambda kind, key: ((F.col("n_nationkey").cast("long") * 3 + kind) * 10**12 + key).alias("line_no")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    heads = nation.join(n_reads, "n_nationkey", "left").join(n_haps, "n_nationkey", "left").select(of, place(0, F.lit(0)), F.concat_ws(" ", count("n_reads"), count("n_haps")).alias("value"))
    read = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    quality = lambda c: F.repeat(F.lit(c), F.length(read))
    reads = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(of, place(1, F.col("c_custkey")), F.concat_ws(" ", read, quality("I"), quality("N"), quality("N")).alias("value"))
    haps = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(of, place(2, F.col("s_suppkey")), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("\r")).alias("value"))
    reads, haps = likelihood.line_regions(heads.unionByName(reads).unionByName(haps))
    reads = reads.select("region", F.lit("read").alias("kind"), F.col("read_idx").alias("idx"), F.col("read").alias("seq"), "q_base")
    return reads.unionByName(haps.select("region", F.lit("hap").alias("kind"), F.col("hap_idx").alias("idx"), F.col("hap").alias("seq"), F.lit(None).cast("string").alias("q_base")))


@query()
def pair_likelihoods(spark, sf):
    """Each part's name as a read, its region's name as the haplotype."""
    part = table(spark, sf, "part").where(F.length(D.bases("p_name")) > 0)
    seq = D.bases("p_name")
    quality = lambda c: F.repeat(F.lit(c), F.length(seq))
    reads = part.select((F.col("p_size") % 5).alias("region"), F.col("p_partkey").alias("read_idx"), seq.alias("read"), quality("I").alias("q_base"), quality("N").alias("q_ins"), quality("N").alias("q_del"))
    haps = table(spark, sf, "region").select(F.col("r_regionkey").alias("region"), F.lit(0).alias("hap_idx"), D.bases("r_name").alias("hap"))
    return likelihood.likelihoods(reads, haps)


#: The forward recurrence, a read's base at a time, in plain probabilities; qualities are those of pair_likelihoods.
_FORWARD_SQL = f"""RECURSIVE p AS (SELECT p_partkey, p_size % 5 AS region, {D.bases_sql("p_name")} AS q FROM part WHERE length({D.bases_sql("p_name")}) > 0),
    h AS (SELECT r_regionkey AS region, {D.bases_sql("r_name")} AS h FROM region),
    pairs AS (SELECT DISTINCT region, q, h, length(h) AS n FROM p JOIN h USING (region)),
    f(region, q, h, n, i, m, x, y) AS (
        SELECT region, q, h, n, 0, list_transform(range(0, n + 1), lambda j: 0.0::DOUBLE), list_transform(range(0, n + 1), lambda j: 0.0::DOUBLE), list_transform(range(0, n + 1), lambda j: 1.0::DOUBLE / n) FROM pairs
        UNION ALL
        SELECT region, q, h, n, i + 1, nm, nx, list_transform(range(0, n + 1), lambda j: coalesce(list_sum(list_transform(range(0, j), lambda l: power(10, -4.5) * nm[l + 1] * power(0.1, j - 1 - l))), 0.0))
        FROM (SELECT *,
                list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 0.0 ELSE (CASE WHEN h[j] = q[i + 1] THEN 1 - power(10, -4) ELSE power(10, -4) / 3 END)
                    * ((1 - 2 * power(10, -4.5)) * m[j] + 0.9::DOUBLE * (x[j] + y[j])) END) AS nm,
                list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 0.0 ELSE power(10, -4.5) * m[j + 1] + 0.1::DOUBLE * x[j + 1] END) AS nx
              FROM f WHERE i < length(q)))"""


@query(f"""WITH {_FORWARD_SQL}, s AS (SELECT region, q, round(log10(list_sum(m[2:]) + list_sum(x[2:])), 4) AS score FROM f WHERE i = length(q))
           SELECT region, p_partkey AS read_idx, score FROM p JOIN s USING (region, q)""")
def pair_scores(spark, sf):
    """pair_likelihoods to four decimals."""
    return pair_likelihoods(spark, sf).select("region", "read_idx", F.round("log10_likelihood", 4).alias("score"))


@query(f"WITH x AS (SELECT {D.bases_sql('text')} AS seq FROM documents) SELECT count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(max(length(seq)) AS INT) AS longest FROM x")
def read_statistics(spark, sf):
    return graph.read_statistics(table(spark, sf, "documents").select(D.bases("text").alias("seq")))


@query(f"""WITH x AS (SELECT doc_id AS read_idx, length({D.bases_sql('text')}) AS n FROM documents)
           SELECT read_idx, n, CAST(floor(coalesce(sum(n) OVER (ORDER BY read_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000) AS BIGINT) AS batch FROM x""")
def read_batches(spark, sf):
    return graph.read_batches(table(spark, sf, "documents").select(F.col("doc_id").alias("read_idx"), D.bases("text").alias("seq")), 100_000)
