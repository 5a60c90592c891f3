"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import delete, discard, materialise, scratch, shared_dir, table

__all__ = ["chunks", "delete", "discard", "fold", "in_fold", "labelled", "materialise", "row_key", "scratch", "shared_dir", "slices", "table"]

#: Rows of an Arrow batch that become Python objects at once; Spark bounds a batch's bytes.
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in short slices: a batch stays in Arrow's compact form, and only a slice is unpacked."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes for a row's id and text, never null; the same for rows that agree in both."""
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def in_fold(doc_id: Column, folds: int, which: int) -> Column:
    """True in that fold; false for a null id."""
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def labelled(docs: DataFrame, marks: DataFrame, label: str, per_class: int, longest: int) -> DataFrame:
    """label and text of a bounded sample: of each class, 0 and 1, the per_class ids of marks (doc_id, label; an id
    once) with the smallest hash; of the id's texts up to longest characters the one with the smallest hash."""
    rows = []
    for kind in (0, 1):
        rows += marks.where(F.col(label) == kind).select("doc_id", label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    # Of proven size: 2 * per_class rows of two numbers.
    bounded = docs.sparkSession.createDataFrame(rows, f"doc_id long, {label} int")
    met = docs.where(F.length(F.coalesce("text", F.lit(""))) <= longest).select("doc_id", "text").join(F.broadcast(bounded), "doc_id")
    return met.groupBy("doc_id", label).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(label, "text")


def chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters each, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
