"""Words and their spelling variants: near words, found with a frequency-vector trie.

A word's frequency vector counts its letters by group: each frequent letter is a
group, the others share a few. Words whose letters differ by one insertion,
deletion or replacement have vectors that differ by a surplus of at most one and a
deficit of at most one. The trie arranges words by the counts of one group after
the other; a search for a word goes down, taking at each level the branch of its
own count, of one more if no surplus has been spent, and of one less if no deficit
has been. The words of the leaves reached, few because their letters agree, are
then compared letter by letter. Words are searched for in blocks: a block goes down
to the leaves, as arrays of word, node and budget, before the next one begins. A node
of few vectors is a leaf; the rest of their counts is compared there.

Scale: words are counted in a narrow pass with partial counts for each task, then
summed. The upper HEAD levels of the trie are a partitioning: a word is stored
under its first counts and asked for under those within budget that do not sort
before its own; what is found under others counts for both words. Branches that hold
more than STORED words are cut into parts by hash, each a trie of its own that all
questions go to, and questions that are more than ASKED are dealt over so many
copies of the part. Each task sorts its rows with stored words first, holds one
part's trie, and lets the questions stream by. Only the number of near words and
the best of them leave a task. Roots are found by pointer doubling: counts at least
double along forms, so a few joins do.

Edge cases: null text has no words; a null doc_id counts as an empty one in the
hash; repeated rows count each; a very long text, or run, counts whole; ties among
forms go to the smaller word in code-point order; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: One occurrence in so many loses a letter.
ONE_IN = 97
SHORTEST, FEWEST, TIMES = 5, 3, 2
#: Letters that are groups of their own, from frequent to rare; all others share OTHERS groups by code point.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
OTHERS = 6
GROUPS = len(LETTERS) + OTHERS
#: Levels of the trie by which words are partitioned; words of a part, and questions to one copy of it.
HEAD = 4
STORED = 50_000
ASKED = 100_000
#: Counts of a head are no larger, so there are at most (MOST + 1) ** HEAD heads.
MOST = 15
#: Distinct words that a task counts before it hands the counts on.
HELD = 500_000
#: Vectors of a leaf, words that are searched for together, pairs that are compared together, and letters up to which
#: words are compared as rows of an array.
LEAF, BLOCK, PAIRS, WIDE = 8, 4_096, 200_000, 40

#: Letters of Latin-1 in UTF-8, after A-Z are in lower case.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_GROUP = {c: i for i, c in enumerate(LETTERS)}


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of words that come at least FEWEST times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        crc32 = zlib.crc32

        def told() -> pa.RecordBatch:
            words = {w.decode(): n for w, n in held.items()}
            return pa.RecordBatch.from_arrays([pa.array([w for w in words if len(w) >= SHORTEST], pa.string()), pa.array([n for w, n in words.items() if len(w) >= SHORTEST], pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                seed = crc32(b"%b:" % (b"" if doc_id is None else str(doc_id).encode()))
                for run, n in Counter(_RUN.findall((text or b"").lower())).items():  # of bytes: only A-Z get lower
                    if len(run) >= SHORTEST:
                        h = crc32(run, seed)
                        if not h % ONE_IN:
                            word = run.decode()
                            at = h % len(word)
                            run = (word[:at] + word[at + 1 :]).encode()
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def frequencies(word: str) -> bytes:
    """Letters of each group, 255 at most: such counts differ by no more than the true ones."""
    counts = [0] * GROUPS
    for c in word:
        at = _GROUP.get(c)
        counts[len(LETTERS) + ord(c) % OTHERS if at is None else at] += 1
    return bytes(min(x, 255) for x in counts)


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class Words:
    """Words as arrays: frequency vectors, and letters from either end."""

    def __init__(self, words: list[str], numbers: list[int], counts: list[bytes]):
        self.words, self.numbers = words, numbers
        self.counts = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, GROUPS)
        self.length = np.array([len(w) for w in words])
        raw = [w.encode("latin-1") if len(w) <= WIDE and w.isascii() else w.encode("latin-1", "ignore") for w in words]
        # Others, the long ones too, are compared one by one.
        self.apart = np.array([len(r) > WIDE or len(r) != n for r, n in zip(raw, self.length.tolist(), strict=True)])
        rows = lambda parts: np.frombuffer(b"".join(r[:WIDE].ljust(WIDE, b"\0") for r in parts), np.uint8).reshape(-1, WIDE)
        self.forward, self.backward = rows(raw), rows([r[::-1] for r in raw])

    def ranks(self) -> np.ndarray:
        """Of each word its place by falling number, then by code points."""
        order = sorted(range(len(self.words)), key=lambda i: (-self.numbers[i], self.words[i]))
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters rows have in common from their beginnings."""
    same = a == b
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def compared(asked: Words, held: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """near() of many pairs: all but one letter of the longer word are shared from the two ends."""
    longer = np.maximum(asked.length[i], held.length[j])
    front = _shared(asked.forward[i], held.forward[j])
    back = _shared(asked.backward[i], held.backward[j])
    out = (np.abs(asked.length[i] - held.length[j]) <= 1) & (front + back >= longer - 1) & (front < WIDE)
    for k in np.flatnonzero(asked.apart[i] | held.apart[j]).tolist():
        out[k] = near(asked.words[i[k]], held.words[j[k]])
    return out


class Trie:
    """Words by the counts of one letter group after the other, from some level on.

    Vectors are sorted, so a node is a range of them. For each level there are the children of all nodes: keys of
    parent and count, sorted, and where each child's vectors begin.
    """

    def __init__(self, held: Words, level: int = HEAD):
        self.held, self.level = held, level
        order = np.lexsort(held.counts[:, : level - 1 if level else None : -1].T)
        counts = held.counts[order]
        new = np.append(True, (counts[1:] != counts[:-1]).any(axis=1))
        self.order, self.first = order, np.append(np.flatnonzero(new), len(order))
        self.vectors = counts[new]
        m = len(self.vectors)
        node, self.keys, self.begin = np.zeros(m, np.int64), [], [np.array([0, m])]
        for at in range(level, GROUPS):
            if np.diff(self.begin[-1]).max() <= LEAF:
                break
            key = node * 512 + self.vectors[:, at]
            new = np.append(True, key[1:] != key[:-1])
            node = np.cumsum(new) - 1
            self.keys.append(key[new])
            self.begin.append(np.append(np.flatnonzero(new), m))

    def search(self, asked: Words, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an asked word and one held near to it, by their numbers."""
        q, node, m, s = np.arange(len(asked.words)), np.zeros(len(asked.words), np.int64), more, less
        found = []
        for depth, begin in enumerate(self.begin):
            size = begin[node + 1] - begin[node]
            leaf = size <= LEAF if depth < len(self.keys) else size > 0
            n = size[leaf]
            found.append((np.repeat(q[leaf], n), np.repeat(begin[node[leaf]] - np.cumsum(n) + n, n) + np.arange(n.sum())))
            q, node, m, s = q[~leaf], node[~leaf], m[~leaf], s[~leaf]
            if not len(q):
                break
            own, keys, parts = asked.counts[q, self.level + depth].astype(np.int64), self.keys[depth], []
            for step, a, b in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
                ok = np.flatnonzero((m >= a) & (s >= b) & (own + step >= 0))
                key = node[ok] * 512 + own[ok] + step
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                ok = ok[hit]
                parts.append((q[ok], at[hit], m[ok] - a, s[ok] - b))
            q, node, m, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        q, v = (np.concatenate(x) for x in zip(*found, strict=True))
        for at in range(0, len(q), PAIRS):
            i, k = q[at : at + PAIRS], v[at : at + PAIRS]
            apart = self.vectors[k, self.level :].astype(np.int16) - asked.counts[i, self.level :]
            within = (np.maximum(apart, 0).sum(axis=1) <= more[i]) & (np.maximum(-apart, 0).sum(axis=1) <= less[i])
            i, k = i[within], k[within]
            n = self.first[k + 1] - self.first[k]
            i, j = np.repeat(i, n), self.order[np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            for b in range(0, len(i), PAIRS):
                good = compared(asked, self.held, i[b : b + PAIRS], j[b : b + PAIRS])
                yield i[b : b + PAIRS][good], j[b : b + PAIRS][good]


def heads(head: tuple[int, ...]) -> list[tuple[tuple[int, ...], int, int]]:
    """Heads within budget that do not sort before this one, with the surplus and deficit that is left."""
    found = [((), 1, 1)]
    for own in head:
        found = [(h + (c,), m, s) for h, more, less in found for c, m, s in ((own, more, less), (own + 1, more - 1, less), (own - 1, more, less - 1)) if m >= 0 and s >= 0 and 0 <= c <= MOST]
    return [x for x in found if x[0] >= head]


def _placed(words: DataFrame) -> DataFrame:
    """word, n, counts (the frequency vector), head, asked (heads to ask, with the budget that is left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("head", pa.binary()), ("more", pa.int32()), ("less", pa.int32())]))
        met: dict[bytes, list] = {}
        for batch in slices(batches):
            counts = [frequencies(w) for w in batch.column(0).to_pylist()]
            own = [bytes(min(x, MOST) for x in c[:HEAD]) for c in counts]
            for h in set(own).difference(met):
                met[h] = [{"head": bytes(x), "more": m, "less": s} for x, m, s in heads(tuple(h))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(own, pa.binary()), pa.array([met[h] for h in own], kind)], names=["word", "n", "counts", "head", "asked"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, counts binary, head binary, asked array<struct<head:binary,more:int,less:int>>")


def shards(words: DataFrame, stored: int = STORED, most_asked: int = ASKED) -> DataFrame:
    """head, part, copy, kind (0 stored, 1 asked), word, n, counts, more, less, own (asked under its own head): what meets
    in each part of the trie."""
    placed = materialise(_placed(words), "spelling-heads")
    asked = placed.select("word", "n", "counts", F.col("head").alias("from"), F.explode("asked").alias("a"))
    asked = asked.select("word", "n", "counts", "a.head", "a.more", "a.less", (F.col("from") == F.col("a.head")).alias("own"))
    sizes = placed.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / stored).cast("int").alias("parts"))
    copies = asked.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / most_asked).cast("int").alias("copies"))
    sizes = F.broadcast(sizes.join(copies, "head"))  # of proven size: 65,536 heads
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    kept = placed.select("word", "n", "counts", "head", F.lit(0).alias("more"), F.lit(0).alias("less"), F.lit(True).alias("own")).join(sizes, "head").withColumn("part", dealt("parts")).withColumn("copy", spread("copies")).withColumn("kind", F.lit(0))
    # A head under which nothing is stored is not asked.
    questions = asked.join(sizes, "head").withColumn("copy", dealt("copies")).withColumn("part", spread("parts")).withColumn("kind", F.lit(1))
    columns = ["head", "part", "copy", "kind", "word", "n", "counts", "more", "less", "own"]
    return kept.select(*columns).unionByName(questions.select(*columns))


NEAR = "word string, n long, other string, other_n long"
BEST = "word string, n_near long, form_n long, form string"


def _pairs_told(asked: Words, held: Words, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """Both ways, but for pairs under a common head, which are met twice."""
    mirrored = ~own[i]
    pick = lambda x, k: [x[a] for a in k.tolist()]
    columns = [pick(asked.words, i) + pick(held.words, j[mirrored]), pick(asked.numbers, i) + pick(held.numbers, j[mirrored]), pick(held.words, j) + pick(asked.words, i[mirrored]), pick(held.numbers, j) + pick(asked.numbers, i[mirrored])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "other", "other_n"])


def _best_told(asked: Words, held: Words, ranks: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """Of each word of a block, and of each held word that they are near to: how many are near, and the best of them."""
    mirrored = ~own[i]
    told: list[list] = [[], [], [], []]
    for a, b, x, y, rank in ((asked, held, i, j, ranks), (held, asked, j[mirrored], i[mirrored], asked.ranks() if mirrored.any() else ranks)):
        if not len(x):
            continue
        order = np.lexsort((rank[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        told[0] += [a.words[k] for k in x[first].tolist()]
        told[1] += np.diff(np.append(first, len(x))).tolist()
        told[2] += [b.numbers[k] for k in y[first].tolist()]
        told[3] += [b.words[k] for k in y[first].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])


def _searched(words: DataFrame, pairs: bool, stored: int, most_asked: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trie, ranks = None, None, None
        held: list[tuple] = []
        asked: list[tuple] = []

        def search() -> Iterator[pa.RecordBatch]:
            nonlocal trie, ranks, held, asked
            if held:
                trie = Trie(Words(*map(list, zip(*held, strict=True))))
                ranks, held = trie.held.ranks(), []
            if asked and trie is not None:
                *own, more, less, same = zip(*asked, strict=True)
                block = Words(*map(list, own))
                met = list(trie.search(block, np.array(more), np.array(less)))
                i, j = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, int), np.zeros(0, int))
                if len(i):
                    yield _pairs_told(block, trie.held, i, j, np.array(same)) if pairs else _best_told(block, trie.held, ranks, i, j, np.array(same))
            asked = []

        for batch in slices(batches, BLOCK):
            for head, part, copy, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (head, part, copy) != shard:
                    yield from search()
                    shard, trie, held = (head, part, copy), None, []
                if not kind:
                    held.append(tuple(row[:3]))
                    continue
                asked.append(tuple(row))
                if len(asked) >= BLOCK:
                    yield from search()
        yield from search()

    key = ["head", "part", "copy"]
    dealt = shards(words, stored, most_asked).repartition(*key).sortWithinPartitions(*key, "kind")
    return dealt.mapInArrow(run, NEAR if pairs else BEST)


def near_pairs(words: DataFrame, stored: int = STORED, most_asked: int = ASKED) -> DataFrame:
    """word, n, other, other_n: each word (word, n) with each near one."""
    return _searched(words, True, stored, most_asked)


def forms(words: DataFrame, stored: int = STORED, most_asked: int = ASKED) -> DataFrame:
    """word, n, n_near, form, form_n of words (word, n)."""
    best = _searched(words, False, stored, most_asked).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    met = words.join(best, "word", "left")
    enough = -F.col("best.n") >= TIMES * F.col("n")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """forms()'s rows with root: the last of a word's forms."""
    found = materialise(found, "spelling-forms")
    ways = materialise(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ways = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of documents."""
    return rooted(forms(materialise(vocabulary(docs), "spelling-words")))
