"""Exact deduplication with a cuckoo-filter index.

The index is a table split into hash buckets. Each bucket holds a cuckoo
filter over its live digests and its content: the digests themselves in order,
each with the row that stays and the group's size. A digest that the filter
doesn't know is new and needs no look at the content; a hit is verified against
it by binary search, so a false positive costs a search and never a document.
The filter takes deletions, so documents that leave the corpus leave the index
too; when an insertion finds no room, the filter is rebuilt at twice the capacity
from the stored digests. The index carries its number of buckets.

Scale: documents are reduced to one partial row for each digest and map
partition before anything is shuffled by digest, so a text that makes up a
third of the corpus arrives as one row per map partition; the lists of its rows
meet the index in SALTS shares. The number of buckets follows the number of
partial rows; a task holds one bucket at a time.

Edge cases: null text counts as empty; a null doc_id is smaller than any id;
of rows with the same text and the same doc_id exactly one stays; a very long
text is a digest like any other; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

SLOTS = 4
MAX_KICKS = 200
#: Partial rows that a bucket should hold, about; its task's memory is in proportion.
ROWS_PER_BUCKET = 50_000
#: Shares that the partial rows of one digest are dealt into.
SALTS = 64

INDEX_SCHEMA = "bucket int, digest binary, keep_id long, keep_rid long, group_size long, capacity int, filter binary, n_buckets int"


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; 0 marks a free slot."""

    def __init__(self, capacity: int = 64, table: bytearray | None = None):
        size = 1
        while size * SLOTS < capacity:
            size *= 2
        self.size = size
        self.table = table if table is not None else bytearray(2 * SLOTS * size)
        self._random = random.Random(size)

    @property
    def capacity(self) -> int:
        return self.size * SLOTS

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def _get(self, place: int, slot: int) -> int:
        at = 2 * (place * SLOTS + slot)
        return self.table[at] | self.table[at + 1] << 8

    def _put(self, place: int, slot: int, mark: int) -> None:
        at = 2 * (place * SLOTS + slot)
        self.table[at], self.table[at + 1] = mark & 255, mark >> 8

    def _swap_in(self, place: int, old: int, new: int) -> bool:
        for slot in range(SLOTS):
            if self._get(place, slot) == old:
                self._put(place, slot, new)
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return any(self._get(p, s) == mark for p in (one, two) for s in range(SLOTS))

    def insert(self, digest: bytes) -> bool:
        """False if there was no room; the filter must then be rebuilt from the keys."""
        mark, one, two = self._places(digest)
        if self._swap_in(one, 0, mark) or self._swap_in(two, 0, mark):
            return True
        place = one
        for _ in range(MAX_KICKS):
            slot = self._random.randrange(SLOTS)
            mark, was = self._get(place, slot), mark
            self._put(place, slot, was)
            place = self._other(place, mark)
            if self._swap_in(place, 0, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return self._swap_in(one, mark, 0) or self._swap_in(two, mark, 0)


class Bucket:
    """A cuckoo filter and the content that its hits are verified against, in order: what was stored, and what came since."""

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.parts: list[tuple[list[bytes], list[list]]] = [([], []), ([], [])]

    def load(self, capacity: int, table: bytes) -> None:
        self.filter = CuckooFilter(capacity, bytearray(table))

    def store(self, digest: bytes, keep: tuple, size: int) -> None:
        """A row of the index; they come in order."""
        digests, entries = self.parts[0]
        digests.append(digest)
        entries.append([keep, size])

    def find(self, digest: bytes) -> tuple[int, int] | None:
        for part, (digests, _) in enumerate(self.parts):
            at = bisect_left(digests, digest)
            if at < len(digests) and digests[at] == digest:
                return part, at
        return None

    def get(self, digest: bytes) -> list | None:
        """The entry of a live digest: [row that stays, group size]."""
        found = self.find(digest) if digest in self.filter else None
        return None if found is None else self.parts[found[0]][1][found[1]]

    def upsert(self, digest: bytes, keep: tuple, size: int) -> None:
        entry = self.get(digest)
        if entry is not None:
            entry[0] = max(entry[0], keep, key=_order)
            entry[1] += size
            return
        digests, entries = self.parts[1]
        at = bisect_left(digests, digest)  # the end, if insertions come in order
        digests.insert(at, digest)
        entries.insert(at, [keep, size])
        if not self.filter.insert(digest):
            self.resize()

    def resize(self) -> None:
        capacity = self.filter.capacity
        done = False
        while not done:
            capacity *= 2
            self.filter = CuckooFilter(capacity)
            done = all(self.filter.insert(d) for digests, _ in self.parts for d in digests)

    def delete(self, digest: bytes) -> None:
        found = self.find(digest) if digest in self.filter else None
        if found is not None:
            digests, entries = self.parts[found[0]]
            del digests[found[1]], entries[found[1]]
            self.filter.delete(digest)

    def entries(self) -> Iterator[tuple[bytes, tuple, int]]:
        for digests, entries in self.parts:
            for digest, (keep, size) in zip(digests, entries, strict=True):
                yield digest, keep, size


def _order(keep: tuple) -> tuple:
    return (keep[0] is not None, keep[0] or 0, keep[1])


#: What a row of the update stream does, in this order within a bucket.
FILTER, ENTRY, DELETE, INSERT = 0, 1, 2, 3


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, action and digest to the bucket's new rows."""
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    names = ["bucket", "digest", "keep_id", "keep_rid", "group_size", "capacity", "filter", "n_buckets"]

    def rows(number: int, bucket: Bucket, n_buckets: int) -> pa.RecordBatch:
        out = [(number, d, *keep, size, None, None, n_buckets) for d, keep, size in bucket.entries()]
        out.append((number, None, None, None, None, bucket.filter.capacity, bytes(bucket.filter.table), n_buckets))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names=names)

    now, bucket, of = None, Bucket(), 0
    for batch in slices(batches):
        for number, action, digest, keep_id, keep_rid, size, capacity, table, n_buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != now:
                if now is not None:
                    yield rows(now, bucket, of)
                now, bucket, of = number, Bucket(), n_buckets
            if action == FILTER:
                bucket.load(capacity, table)
            elif action == ENTRY:
                bucket.store(digest, (keep_id, keep_rid), size)
            elif action == DELETE:
                bucket.delete(digest)
            else:
                bucket.upsert(digest, (keep_id, keep_rid), size)
    if now is not None:
        yield rows(now, bucket, of)


def update_index(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None, n_buckets: int | None = None) -> DataFrame:
    """Apply deletions, then insertions, to an index (None: a new one with n_buckets buckets).

    inserts: digest binary, keep_id, keep_rid, group_size; deletes: digest binary.
    The result has one row for each live digest and one with each bucket's filter. An index keeps its number of
    buckets; another n_buckets is an error.
    """
    stored = None if index is None else index.agg(F.max("n_buckets")).first()[0]
    if stored is not None and n_buckets not in (None, stored):
        raise ValueError(f"the index has {stored} buckets, not {n_buckets}")
    n_buckets = stored or n_buckets or 1
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int").alias("bucket")
    none = [F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("binary").alias("filter")]
    stream = inserts.select(bucket, F.lit(INSERT).alias("action"), "digest", "keep_id", "keep_rid", "group_size", *none)
    if deletes is not None:
        gone = [F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_rid", "group_size")]
        stream = stream.unionByName(deletes.select(bucket, F.lit(DELETE).alias("action"), "digest", *gone, *none))
    if index is not None:
        action = F.when(F.col("digest").isNull(), FILTER).otherwise(ENTRY).alias("action")
        stream = stream.unionByName(index.select("bucket", action, "digest", "keep_id", "keep_rid", "group_size", "capacity", "filter"))
    stream = stream.withColumn("n_buckets", F.lit(n_buckets))
    return stream.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "action", "digest").mapInArrow(_update, INDEX_SCHEMA)


def entries(index: DataFrame) -> DataFrame:
    return index.where(F.col("digest").isNotNull()).select("digest", "keep_id", "keep_rid", "group_size")


def digests(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def partials(docs: DataFrame) -> DataFrame:
    """One row for each digest and map partition, with its rows there; written once."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digests(F.col("text")).alias("digest"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid"),
    )
    member = F.struct("doc_id", "rid")
    grouped = rows.groupBy("digest", "part").agg(F.max(member).alias("best"), F.count(F.lit(1)).alias("n"), F.collect_list(member).alias("members"))
    return materialise(grouped, "dedup-partials")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    parts = partials(docs)
    n_buckets = max(1, -(-parts.count() // ROWS_PER_BUCKET))
    incoming = parts.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("n").alias("group_size"))
    index = entries(update_index(None, incoming, n_buckets=n_buckets))
    # The lists of one text may hold a third of all rows: they are dealt over tasks by the map partitions they came from.
    own = parts.select("digest", "members", F.pmod("part", F.lit(SALTS)).alias("salt"))
    salts = own.groupBy("digest").agg(F.collect_set("salt").alias("salts"))
    joined = own.join(index.join(salts, "digest").withColumn("salt", F.explode("salts")), ["digest", "salt"])
    return joined.select("*", F.explode("members").alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("m.rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; same columns. Texts are moved once: the row that stays is looked up,
    and one of equal rows picked, by the same key of id and digest."""
    key = lambda doc_id, digest: F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary"))
    kept = exact_dedup(docs).where("kept").select(key(F.col("doc_id"), F.unhex("text_sha256")).alias("__llm_key"))
    own = docs.withColumn("__llm_key", key(F.col("doc_id"), digests(F.col("text"))))
    return own.join(kept, "__llm_key", "left_semi").dropDuplicates(["__llm_key"]).select(*docs.columns)
