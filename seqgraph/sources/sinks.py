"""Writing graphs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import segment_of, strand_of, tags_text


def _tab(*parts) -> F.Column:
    return F.concat_ws("\t", *parts)


def _tag(name: str, kind: str, value, known=None) -> F.Column:
    """A tag's text, null without a value; concat_ws passes over it then."""
    return F.when(value.isNotNull() if known is None else known, F.concat(F.lit(f"{name}:{kind}:"), value.cast("string")))


def _other_tags(df: DataFrame, *own: str) -> list:
    return [F.nullif(tags_text(F.map_filter("tags", lambda k, v: ~k.isin(*own))), F.lit(""))] if "tags" in df.columns else []


def segment_text(segments: DataFrame, with_seq: bool = True) -> DataFrame:
    """S lines of segments name, seq, len: line. Stable name and start (sn, so), rank (sr) and tags follow where given."""
    seq = F.coalesce(F.col("seq"), F.lit("*")) if with_seq else F.lit("*")
    extra = []
    if {"sn", "so"} <= set(segments.columns):
        stable = F.col("sn").isNotNull() & (F.col("so") >= 0)
        extra += [_tag("SN", "Z", F.col("sn"), stable), _tag("SO", "i", F.col("so"), stable)]
    if "sr" in segments.columns:
        extra.append(_tag("SR", "i", F.col("sr"), F.col("sr") >= 0))
    extra += _other_tags(segments, "LN", *(["SN", "SO", "SR"] if extra else []))
    return segments.select(_tab(F.lit("S"), "name", seq, F.concat(F.lit("LN:i:"), F.col("len")), *extra).alias("line"))


def arc_text(arcs: DataFrame, segments: DataFrame, both_lengths: bool = False, with_tags: bool = False) -> DataFrame:
    """L lines of arcs v, w, ov, ow: the shorter overlap as a match, or both lengths where they differ.

    Complements that were added (comp) are left out. With with_tags the rank follows, with what lies beyond the
    overlap on each side (L1, L2) and with the arcs' tags.
    """
    match = F.concat(F.least("ov", "ow"), F.lit("M"))
    over = F.when(F.col("ov") == F.col("ow"), match).otherwise(F.concat_ws(":", F.col("ov"), F.col("ow"))) if both_lengths else match
    arcs = arcs.where(~F.col("comp")) if "comp" in arcs.columns else arcs
    extra = []
    if with_tags:
        met = {"v": "__v_len", "w": "__w_len"}
        for end, length in met.items():
            own = segments.select(F.col("seg_id").alias(f"__{end}"), F.col("len").alias(length))
            arcs = arcs.join(own, segment_of(end) == F.col(f"__{end}"))
        extra = [_tag("SR", "i", F.col("rank"), F.col("rank") >= 0), _tag("L1", "i", F.col("__v_len") - F.col("ov")), _tag("L2", "i", F.col("__w_len") - F.col("ow")), *_other_tags(arcs, "SR", "L1", "L2")]
    name = segments.select("seg_id", "name")
    strand = lambda c: F.when(strand_of(c) == 1, "-").otherwise("+")
    rows = arcs.join(name.toDF("v_id", "v_name"), segment_of("v") == F.col("v_id")).join(name.toDF("w_id", "w_name"), segment_of("w") == F.col("w_id"))
    return rows.select(_tab(F.lit("L"), "v_name", strand("v"), "w_name", strand("w"), over, *extra).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """One row for each read, in order."""
    scores.select("read_idx", "name", "score").orderBy("read_idx").write.csv(path, sep="\t")
