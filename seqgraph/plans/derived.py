"""Graphs and reads derived from the given tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.storage import table

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def bases(text: Column | str) -> Column:
    """A text's letters, as bases."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def bases_sql(text: str) -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"


def fastq_text(text: str, doc_id: str, comment: str) -> Column:
    """A document's bases as a FASTA or FASTQ record of one form or another, by its number."""
    seq, number = bases(text), F.col(doc_id)
    half = F.ceil(F.length(seq) / 2).cast("int")
    head, tail = F.substr(seq, F.lit(1), half), F.substr(seq, half + 1)
    # One too many for every tenth record: on the last line that has a quality, else the lines before are long enough.
    odd = lambda own: F.when((number % 10 == 0) & own, "!").otherwise("")
    quality = F.concat(F.repeat(F.lit("I"), half), odd(tail == ""), F.lit("\r\n"), F.overlay(F.repeat(F.lit("+"), F.length(tail)), F.substr(F.lit("@"), F.lit(1), F.least(F.length(tail), F.lit(1))), F.lit(1)))
    quality = F.concat(F.lit("+\r\n"), quality, odd(tail != ""), F.lit("\r\n"))
    has_quality = lambda n: (n % 10 == 0) | (n % 4 != 3)
    # A line that is no record would be sequence behind one without quality.
    before = F.when(number % 7 == 1, "\r\n").when((number % 7 == 2) & has_quality(number - 1), "no record\n\n").otherwise("")
    mark = F.when(number % 6 == 1, ">").otherwise("@")
    return F.concat(before, mark, F.lit("doc"), number.cast("string"), F.lit(" "), F.col(comment), F.lit("\r\n"), head, F.lit("\r\n"), tail, F.lit("\r\n"), F.when(has_quality(number), quality).otherwise(""))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each part; those of a size that 10 divides have no sequence."""
    part = table(spark, sf_dir, "part")
    seq = F.when(F.col("p_size") % 10 != 0, bases("p_name"))
    return part.select(
        F.col("p_partkey").alias("seg_id"), F.concat(F.lit("s"), F.col("p_partkey")).alias("name"), seq.alias("seq"), F.coalesce(F.length(seq), F.lit(0)).alias("len"),
        F.col("p_brand").alias("sn"), (F.col("p_size") * 10).alias("so"), (F.col("p_size") % 5).alias("sr"),
    )


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arc for each two consecutive lines of an order; about one in seven lacks ow."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_shipdate", "l_extendedprice")
    v, quantity = F.col("l_partkey") * 2 + F.col("p_size") % 2, F.col("l_quantity").cast("int")
    rows = line.select(
        v.alias("v"), F.lead(v).over(own).alias("w"), (quantity % 4).alias("ov"), F.lead(quantity % 4).over(own).alias("next_ov"), (quantity % 7 == 0).alias("half"),
        F.col("l_linenumber").alias("rank"), (F.col("l_orderkey") * 1000 + F.row_number().over(own)).alias("link_id"),
    )
    return rows.where("w is not null").select("v", "w", "ov", F.when(~F.col("half"), F.col("next_ov")).alias("ow"), "rank", "link_id", F.lit(False).alias("comp"))


def whole_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs, with 0 for an overlap that lacks."""
    return arcs(spark, sf_dir).withColumn("ow", F.coalesce("ow", F.lit(0)))


SEGMENTS_SQL = f"""segments AS (
    SELECT p_partkey AS seg_id, 's' || p_partkey AS name, CASE WHEN p_size % 10 <> 0 THEN {bases_sql("p_name")} END AS seq,
           CASE WHEN p_size % 10 <> 0 THEN length({bases_sql("p_name")}) ELSE 0 END AS len, p_brand AS sn, p_size * 10 AS so, p_size % 5 AS sr FROM part)"""

ARCS_SQL = """arcs AS (
    SELECT v, w, ov, CASE WHEN NOT half THEN next_ov END AS ow, rank, link_id FROM (
        SELECT l_partkey * 2 + p_size % 2 AS v, lead(l_partkey * 2 + p_size % 2) OVER o AS w, CAST(l_quantity AS INT) % 4 AS ov,
               lead(CAST(l_quantity AS INT) % 4) OVER o AS next_ov, CAST(l_quantity AS INT) % 7 = 0 AS half,
               l_linenumber AS rank, l_orderkey * 1000 + row_number() OVER o AS link_id
        FROM lineitem JOIN part ON l_partkey = p_partkey
        WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_shipdate, l_extendedprice))
    WHERE w IS NOT NULL),
whole AS (SELECT v, w, ov, coalesce(ow, 0) AS ow, rank, link_id FROM arcs)"""

GRAPH_SQL = f"WITH {SEGMENTS_SQL},\n{ARCS_SQL}"


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each order."""
    orders = table(spark, sf_dir, "orders")
    seq = F.concat(F.translate(F.col("o_orderkey").cast("string"), "0123456789", "ACGTACGTAC"), bases("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("seg_id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"), seq.alias("seq"), F.length(seq).alias("len"))


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from each order to its customer's next, some to the one after that, some of a customer's last to the first;
    some chains are broken. Of complements one is given, and arcs that are alike stay."""
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key, v = F.col("o_orderkey"), F.col("o_orderkey") * 2 + (F.col("o_orderkey") % 5 == 0).cast("long")
    rows = table(spark, sf_dir, "orders").select(key, "o_custkey", v.alias("v"), F.lead(v, 1).over(own).alias("w1"), F.lead(v, 2).over(own).alias("w2"), F.first(v).over(own).alias("w0"))
    arc = lambda w, k: F.when(k & F.col(w).isNotNull(), F.struct("v", F.col(w).alias("w"), (key % 4).cast("int").alias("ov"), (key % 4).cast("int").alias("ow")))
    some = F.filter(F.array(arc("w1", key % 13 != 0), arc("w2", key % 11 == 0), arc("w0", F.col("w1").isNull() & (F.col("o_custkey") % 7 == 0))), lambda x: x.isNotNull())
    return rows.select(F.explode(some).alias("a")).select("a.v", "a.w", "a.ov", "a.ow")


def order_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arcs, each once, with complements."""
    other = F.struct(F.col("w").bitwiseXOR(1).alias("v"), F.col("v").bitwiseXOR(1).alias("w"), F.col("ow").alias("ov"), F.col("ov").alias("ow"))
    return order_links(spark, sf_dir).select(F.inline(F.array(F.struct("v", "w", "ov", "ow"), other))).distinct()


ORDERS_SQL = f"""oseg AS (SELECT o_orderkey AS seg_id, 'o' || o_orderkey AS name, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ACGTACGTAC') || {bases_sql("o_orderpriority")} AS seq FROM orders),
overt AS (SELECT seg_id * 2 AS v, seq AS t FROM oseg UNION ALL SELECT seg_id * 2 + 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM oseg),
orows AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey * 2 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM orders),
ow AS (SELECT k, c, v, lead(v, 1) OVER o AS w1, lead(v, 2) OVER o AS w2, first_value(v) OVER o AS w0 FROM (SELECT orows.*, o_orderdate FROM orows JOIN orders ON o_orderkey = k)
       WINDOW o AS (PARTITION BY c ORDER BY o_orderdate, k)),
o1 AS (SELECT v, w1 AS w, CAST(k % 4 AS INT) AS o FROM ow WHERE w1 IS NOT NULL AND k % 13 <> 0 UNION SELECT v, w2, CAST(k % 4 AS INT) FROM ow WHERE w2 IS NOT NULL AND k % 11 = 0
       UNION SELECT v, w0, CAST(k % 4 AS INT) FROM ow WHERE w1 IS NULL AND c % 7 = 0),
oarc AS (SELECT v, w, o AS ov, o AS ow FROM o1 UNION SELECT xor(w, 1), xor(v, 1), o, o FROM o1)"""


def order_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From inside every third order to inside its customer's first: some without text, some that are alike."""
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key, size = F.col("o_orderkey"), F.length(F.concat(F.col("o_orderkey").cast("string"), bases("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").select(key, "o_orderpriority", size.cast("long").alias("n"), F.first(key).over(own).alias("f"), F.first(size.cast("long")).over(own).alias("m"))
    ways = rows.where(key % 3 == 0).select(
        F.concat(F.lit("i"), key).alias("name"), (key * 2 + key % 2).alias("v"), (1 + key % F.col("n")).alias("v_off"), (F.col("f") * 2 + (key % 5 == 0).cast("long")).alias("w"), (key % F.col("m")).alias("w_off"),
        F.when(key % 4 == 0, "").otherwise(bases("o_orderpriority")).alias("seq"),
    )
    return ways.unionByName(ways.where("v % 7 = 0").withColumn("name", F.concat("name", F.lit("again"))))


INSERTIONS_SQL = f"""irow AS (SELECT o_orderkey AS k, {bases_sql("o_orderpriority")} AS p, length(oseg.seq) AS vn, first_value(o_orderkey) OVER c AS f, first_value(length(oseg.seq)) OVER c AS wn
    FROM orders JOIN oseg ON seg_id = o_orderkey WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
ins AS (SELECT 'i' || k AS name, k * 2 + k % 2 AS v, 1 + k % vn AS v_off, vn, f * 2 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS w, k % wn AS w_off, wn, CASE WHEN k % 4 = 0 THEN '' ELSE p END AS seq FROM irow WHERE k % 3 = 0)"""


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, seq) and arcs (v, w, ow): the regions' names one after another, each with branches to its nations."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    r = F.col("r_regionkey").cast("long")
    chain = region.select(r.alias("v"), F.upper("r_name").alias("seq"))
    leaf = nation.select((F.col("n_nationkey") + 100).cast("long").alias("v"), F.upper("n_name").alias("seq"))
    forward = region.select(r.alias("v"), (r + 1).alias("w")).join(chain.select(F.col("v").alias("w")), "w", "left_semi").select("v", "w")
    branch = nation.select(F.col("n_regionkey").cast("long").alias("v"), (F.col("n_nationkey") + 100).cast("long").alias("w"))
    return chain.unionByName(leaf), forward.unionByName(branch).withColumn("ow", F.lit(0))


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph as GFA lines (line_no, value): regions and nations by name; branches are given from the other strand."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    line = lambda at, *fields: [at.cast("long").alias("line_no"), F.concat_ws("\t", *fields).alias("value")]
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    segments = region.select(*line(r, F.lit("S"), name("r", r), F.upper("r_name"))).unionByName(nation.select(*line(n + 100, F.lit("S"), name("n", n), F.upper("n_name"))))
    following = region.select((r - 1).alias("r_regionkey")).join(region.select("r_regionkey"), "r_regionkey")
    chain = following.select(*line(r + 200, F.lit("L"), name("r", r), F.lit("+"), name("r", r + 1), F.lit("+"), F.lit("0M")))
    branch = nation.select(*line(n + 300, F.lit("L"), name("n", n), F.lit("-"), name("r", F.col("n_regionkey")), F.lit("-"), F.lit("*")))
    return segments.unionByName(chain).unionByName(branch)


WALKS_SQL = """walks AS (
    SELECT string_agg(upper(r.r_name), '' ORDER BY r.r_regionkey) || upper(n_name) AS t
    FROM nation JOIN region r ON r.r_regionkey <= n_regionkey GROUP BY n_nationkey, n_name
    UNION ALL SELECT string_agg(upper(r_name), '' ORDER BY r_regionkey) FROM region)"""


def part_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("read_idx"), F.upper("p_name").alias("seq"))


def diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as states: user as vertex, the value's whole part as diagonal."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("v"), F.floor("value").cast("int").alias("d"), F.col("event_id").alias("k"))


DIAGONALS_SQL = "states AS (SELECT user_id AS v, CAST(floor(value) AS INT) AS d, event_id AS k FROM events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals within their user."""
    start = F.floor(F.col("value") * 10).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("v"), "event_id", "event_type", start.alias("vd0"), (start + F.col("event_id") % 40).alias("vd1"))


SPANS_SQL = "spans AS (SELECT user_id AS v, event_id, event_type, CAST(floor(value * 10) AS BIGINT) AS vd0, CAST(floor(value * 10) AS BIGINT) + event_id % 40 AS vd1 FROM events)"


def coalesce_sql(source: str) -> str:
    return f"""SELECT v, min(vd0) AS vd0, max(vd1) AS vd1 FROM (
        SELECT v, vd0, vd1, sum(CASE WHEN reach IS NULL OR vd0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY vd0, vd1 ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT v, vd0, vd1, max(vd1) OVER (PARTITION BY v ORDER BY vd0, vd1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE vd1 > vd0))
        GROUP BY v, run"""
