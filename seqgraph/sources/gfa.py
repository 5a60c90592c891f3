"""Reading sequence graphs: GFA lines, or FASTA records as segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered, placed, scan
from ..functions.sequences import field_int, overlap, tag_int, tag_string, tags
from . import fastx


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a text file or folder; gzip by its suffix. Numbers grow along each file."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("line_no"))
    return rows.select("line_no", F.regexp_replace("value", r"\r$", "").alias("value"))


def _records(rows: DataFrame, kind: str) -> DataFrame:
    """Lines of that record kind, split at tabs; others (headers, paths, short lines) are passed over."""
    own = rows.where(F.col("value").startswith(f"{kind}\t") & (F.length("value") >= 3))
    # Out of an array of one: filters on the fields stay behind it, so a line is split once and not again for each.
    return own.select("line_no", F.explode(F.array(F.split("value", "\t", -1))).alias("f"))


def segment_lines(rows: DataFrame) -> DataFrame:
    """name, seq, len, stable name, start and rank, tags; of a name that comes twice the last line counts."""
    f = F.col("f")
    found = _records(rows, "S").where(F.size("f") >= 3)
    found = found.select("line_no", F.get(f, F.lit(1)).alias("name"), F.nullif(F.get(f, F.lit(2)), F.lit("*")).alias("seq"), tags(F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0)))).alias("tags"))
    last = found.groupBy("name").agg(F.max(F.struct("line_no", "seq", F.map_entries("tags").alias("t"))).alias("x"))
    row = last.select("name", F.col("x.line_no").alias("line_no"), F.col("x.seq").alias("seq"), F.map_from_entries("x.t").alias("tags"))
    return row.select(
        "name", "line_no", "seq",
        F.coalesce(F.length("seq"), tag_int("tags", "LN"), F.lit(0)).alias("len"),
        (F.length("seq") != tag_int("tags", "LN")).alias("length_differs"),
        tag_string("tags", "SN").alias("sn"), tag_int("tags", "SO").alias("so"), tag_int("tags", "SR").alias("sr"), "tags",
    )


def link_lines(rows: DataFrame) -> DataFrame:
    """v_name, v_ori, w_name, w_ori, ov, ow, rank, l1, l2, tags; lines with another strand than + or - go."""
    f = F.col("f")
    found = _records(rows, "L").where((F.size("f") >= 5) & F.get(f, F.lit(2)).isin("+", "-") & F.get(f, F.lit(4)).isin("+", "-"))
    strand = lambda c: F.when(c == "-", 1).otherwise(0)
    over, rest = overlap(F.get(f, F.lit(5))), F.slice(f, 7, F.greatest(F.size(f) - 6, F.lit(0)))
    row = found.select(
        "line_no", F.get(f, F.lit(1)).alias("v_name"), strand(F.get(f, F.lit(2))).alias("v_ori"), F.get(f, F.lit(3)).alias("w_name"), strand(F.get(f, F.lit(4))).alias("w_ori"),
        over.alias("o"), field_int(rest, "SR").alias("rank"), field_int(rest, "L1").alias("l1"), field_int(rest, "L2").alias("l2"), tags(rest).alias("tags"),
    )
    return row.select("line_no", "v_name", "v_ori", "w_name", "w_ori", "o.ov", "o.ow", "rank", "l1", "l2", "tags")


def first_mentions(segments: DataFrame, links: DataFrame) -> DataFrame:
    """name, seg_id: dense numbers in the order in which S and L lines first name a segment."""
    named = segments.select("name", "line_no", F.lit(0).alias("k"))
    named = named.unionByName(links.select(F.col("v_name").alias("name"), "line_no", F.lit(0).alias("k")))
    named = named.unionByName(links.select(F.col("w_name").alias("name"), "line_no", F.lit(1).alias("k")))
    return dictionary(named, "name", [F.col("line_no"), F.col("k")])


def dictionary(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """name, seg_id: dense numbers by first occurrence in order."""
    first = df.groupBy(name).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(first, ["first", name], "seg_id").select(name, "seg_id")


def fasta_segments(rows: DataFrame, name: str = "file") -> DataFrame:
    """FASTA lines (file, line_no, value) to segments: name s1, s2..., sn (the header's first word), seq, len.

    A tab at the second place ends a record: what follows are graph lines, up to the next header. A record is named by
    its header's line; one file spreads over many tasks.
    """
    tabbed = (F.length("value") >= 3) & (F.substring("value", 2, 1) == "\t")
    # Twice the number of the last line that is a header or a graph line, and 1 if it is a header.
    mark = F.when(F.col("value").startswith(">"), F.col("line_no") * 2 + 1).when(tabbed, F.col("line_no") * 2)
    marked = scan(rows.select(name, "line_no", "value"), [name], ["line_no"], "max", mark, "before").withColumn("mark", F.coalesce(mark, "before"))
    marked = marked.where("mark % 2 = 1").withColumn("record", F.expr("mark div 2"))
    part = F.when(~F.col("value").startswith(">"), F.struct("line_no", "value"))
    head = F.max(F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))).alias("sn")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["value"]), "").alias("seq")
    found = marked.groupBy(name, "record").agg(head, body)
    found = numbered(found, [name, "record"], "n")
    return found.select(F.concat(F.lit("s"), F.col("n") + 1).alias("name"), "sn", F.lit(0).alias("so"), F.lit(0).alias("sr"), "seq", F.length("seq").alias("len"), name, "record")


def path_steps(rows: DataFrame) -> DataFrame:
    """path, step, name, strand of P and W lines: an extension, paths play no part in scoring."""
    f = F.col("f")
    at = lambda i: F.get(f, F.lit(i))
    p = _records(rows, "P").select(at(1).alias("path"), F.filter(F.split(at(2), ","), lambda x: x != "").alias("steps"))
    p = p.select("path", F.transform("steps", lambda x: F.struct(F.regexp_replace(x, "[+-]$", "").alias("name"), F.when(x.endswith("-"), 1).otherwise(0).alias("strand"))).alias("steps"))
    w = _records(rows, "W").select(F.concat_ws("#", at(1), at(2), at(3)).alias("path"), F.regexp_extract_all(at(6), F.lit("([<>][^<>]+)"), F.lit(1)).alias("steps"))
    w = w.select("path", F.transform("steps", lambda x: F.struct(F.substr(x, F.lit(2)).alias("name"), F.when(x.startswith("<"), 1).otherwise(0).alias("strand"))).alias("steps"))
    return p.unionByName(w).select("path", F.posexplode("steps").alias("step", "s")).select("path", "step", "s.name", "s.strand")


def read_reads(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Reads of FASTA or FASTQ files, numbered in order: read_idx, file_path, record, name, comment, seq, qual, valid.

    options: those of the data source, fastx.
    """
    fastx.register(spark)
    rows = spark.read.format("fastx").options(**options).load(path)
    # Its partitions are stretches of files in order of paths and places, with their records in order.
    return placed(rows.withColumnRenamed("file", "file_path"), "read_idx")
