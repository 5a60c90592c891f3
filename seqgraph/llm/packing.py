"""Packing tokenised documents into fixed-length sequences.

Exact-complement hashing, then best fit. What matters for packing is only how
many pieces there are of each length, so the plan is made on that histogram
(as many numbers as a sequence has tokens, however large the corpus): the
longest piece leaves a gap; an index of single, pair and triple sums of the
lengths still available gives combinations that fill the gap exactly, consumed
as often as availability allows; where none fits, the longest piece that fits
goes in and the search goes on with the smaller gap. Each pattern is used with
a multiplicity, so the plan has a few thousand rows at most.

Scale: tokenising is one narrow pass, which also ranks each piece among those
of its length in its task. Counts by task and length become offsets with a
window over numbers of tasks; a piece's global rank in its length then decides
its sequence and place by binary search in the plan. No token is shuffled.

Edge cases: null text counts as empty (one end token); a null doc_id packs as
any other; repeated rows are packed each; a very long text is cut into pieces of a
whole sequence and a rest; pieces of the same length are placed by task and order;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, slices

SEQUENCE = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, rank long"


_PARTS = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")


def _letters_and_tail(word: bytes) -> tuple[bytes, bytes] | None:
    """A word's letters and the punctuation behind them, which the tokenizer separates; None for any other word.

    Letters are those of Latin up to U+024F that stay single letters in lower case.
    """
    m = _PARTS.fullmatch(word)
    if m is None:
        return None
    core = m[1]
    if not core.isascii():
        text = core.decode()
        if max(text) >= "\u0250" or not text.isalpha() or "\u0130" in text:
            return None
    return core, m[2]


class WordEncoder:
    """Ids of whole texts as little-endian uint32, encoding each distinct word once.

    The tokenizer never merges across white space, so a text's ids are those of
    its words in turn. Letters and the punctuation behind them are separate
    words to it, so those are learned apart; words of letters are encoded many
    at a time, since a token that ends a word says so in its form. Case is
    folded first where the tokenizer does so anyway; texts that spell a special
    token are given to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        plain: set[bytes] = set()
        other: set[bytes] = set()
        tailed: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            if w.isalpha():  # of bytes: ASCII letters only
                plain.add(w)
            elif parts := _letters_and_tail(w):
                plain.add(parts[0])
                if parts[1]:
                    tailed.append((w, *parts))
                    other.add(parts[1])
            else:
                other.add(w)
        known = self.known
        self._learn_plain(list(plain.difference(known)))
        self._learn_other(list(other.difference(known)))
        for w, core, tail in tailed:
            known[w] = known[core] + known[tail]

    def _learn_plain(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 2_000):
            some = words[a : a + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            raw, at = ids.tobytes(), 0
            for w, cut in zip(some, (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist(), strict=True):
                self.known[w] = raw[at:cut]
                at = cut

    def _learn_other(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 2_000):
            some = words[a : a + 2_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            raw = t.encode("utf-8", "replace").lower()
            split.append(None if b"<|" in raw else raw.split())
        words = {w for some in split if some for w in some}
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        self._learn(new)
        known = self.known.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(known, words)) for t, words in zip(texts, split, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, which keeps it from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """Tokenised pieces of at most size ids, with their task and rank among its pieces of that length."""
    tail = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(public_tokenizers.path(tokenizer)), TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, np.int64).tolist()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("rank", pa.int64())])
        for batch in slices(batches):
            rows = []
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for doc_id, raw in zip(doc_ids, own.encode([t or "" for t in texts]), strict=True):
                raw += tail
                for n, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    length = len(part) // 4
                    rows.append((doc_id, n, at // 4, length, part, task, ranks[length]))
                    ranks[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Available:
    """Counts of lengths, and how many pairs of available lengths give each sum."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.counts = size, counts.astype(np.int64).copy()
        self.there = self.counts > 0
        lengths = np.flatnonzero(self.there)
        self.pairs = np.zeros(size + 1, np.int64)
        for x in lengths:  # unordered pairs of different lengths
            sums = lengths[lengths > x] + x
            self.pairs[sums[sums <= size]] += 1

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if self.counts[length] == 0:
            self.there[length] = False
            sums = np.flatnonzero(self.there) + length
            self.pairs[sums[sums <= self.size]] -= 1

    def pair(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """Two available lengths with that sum, the larger one as large as can be."""
        if not (self.pairs[gap] or gap % 2 == 0 and self.left(gap // 2, used) > 1):
            return None
        large = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in large[self.there[large] & self.there[gap - large]].tolist():
            b = gap - a
            if self.left(a, used) > (a == b) and self.left(b, used) > 0:
                return a, b
        return None

    def left(self, length: int, used: dict[int, int]) -> int:
        return int(self.counts[length]) - used.get(length, 0)

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap."""
        if self.left(gap, used) > 0:
            return (gap,)
        if found := self.pair(gap, used):
            return found
        first = np.flatnonzero(self.there[:gap])[::-1]
        rest = gap - first
        even = (rest % 2 == 0) & (self.counts[rest // 2] > 1)
        for c in first[(self.pairs[rest] > 0) | even].tolist():
            if self.left(c, used) > 0 and (found := self.pair(gap - c, used | {c: used.get(c, 0) + 1})):
                return (c, *found)
        return None

    def fitting(self, gap: int, used: dict[int, int]) -> int | None:
        """The longest available length that fits."""
        for x in np.flatnonzero(self.there[: gap + 1])[::-1].tolist():
            if self.left(x, used) > 0:
                return x
        return None


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """counts[n]: pieces of length n. Rows (length, first rank, sequence, copies in a sequence, offset):
    of that length, ranks from the first rank on go to sequences from that one on, so many to each."""
    have, out, ranks, sequence = Available(counts, size), [], np.zeros(size + 1, np.int64), 0
    while True:
        longest = np.flatnonzero(have.there)
        if not len(longest):
            return out
        used: dict[int, int] = {int(longest[-1]): 1}
        gap = size - int(longest[-1])
        while gap:
            found = have.exact(gap, used)
            if found is None:
                one = have.fitting(gap, used)
                if one is None:
                    break
                found = (one,)
            for x in found:
                used[x] = used.get(x, 0) + 1
                gap -= x
        times = min(int(have.counts[x]) // k for x, k in used.items())
        offset = 0
        for x, k in used.items():
            out.append((x, int(ranks[x]), sequence, k, offset))
            ranks[x] += k * times
            offset += k * x
            have.take(x, k * times)
        sequence += times


def placer(rows: list[tuple[int, int, int, int, int]]):
    """A column function: length and rank to sequence_id and offset."""
    data = np.array(sorted(rows), np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        span = int(data[:, 1].max()) + 1 if len(data) else 1
        ranks = rank.to_numpy(np.int64)
        # Ranks of a length beyond its last row's start still belong to that row.
        keys = length.to_numpy(np.int64) * span + np.minimum(ranks, span - 1)
        row = data[np.searchsorted(data[:, 0] * span + data[:, 1], keys, side="right") - 1]
        nth = ranks - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * row[:, 0]})

    return place


def assign(slim: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """sequence_id and offset for pieces with length, task and rank; other columns stay.

    slim is read several times, so it should be a written table.
    """
    by_task = slim.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # size rows at most.
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1, np.int64)
    for r in histogram:
        counts[r.length] = r.n
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = placer(plan(counts, size))
    ranked = slim.join(offsets, ["length", "task"])
    placed = ranked.withColumn("place", place(F.col("length"), F.col("before") + F.col("rank")))
    return placed.select(*[c for c in slim.columns if c not in ("task", "rank")], "place.sequence_id", "place.offset")


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    slim = pieces(docs).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return assign(materialise(slim, "packing-pieces"))


def sequences(docs: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian uint32), parts (doc_id, piece, offset, length)."""
    placed = assign(materialise(pieces(docs), "packing-ids"))
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    # A sequence holds SEQUENCE ids at most.
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts"))
