"""Exact n-gram Jaccard self-join and its components, with signature trees.

Two texts link when their sets of word shingles have a Jaccard similarity of
PERCENT / 100 or more. The join is exact up to collisions of 64-bit hashes.

1. Parts as keys. Of two linked texts at most most_apart(n) shingles are in one
   only. The hash space is cut into more parts than that, so some parts hold the
   same shingles in both texts; what a part holds, hashed, is a key. Linked texts
   share one of their first most_apart + 1 keys in any common order, so only
   these are looked up; the order puts parts with most shingles first, which texts
   hardly ever share by chance, common passages and frequent words or not. The
   number of parts is a power of two, and the smaller text of a pair brings its
   keys for the next number as well if the larger one can have that. A text with
   too few parts that hold anything also brings its first shingles alone.
2. One shuffle of (key, text) by key finds the texts that share a key; their
   components are clusters, and no link leaves a cluster. Most texts share none
   and are done.
3. The texts of each cluster meet in blocks of bounded size. A block builds a
   signature tree - inner nodes hold the union of bitmaps below and the range of
   sizes - and a dual traversal drops node pairs whose largest possible overlap is
   too small, or whose texts are already in one component. What is left is
   verified on the whole sets at once. Nearly all clusters are one block.
4. A larger cluster is cut anew: of its texts all keys are counted, each text
   keeps its rarest most_apart + 1, and texts that only a common passage held
   together fall apart. Of a cluster that is still larger the blocks, dealt by the
   texts' most frequent key, connect what they hold; then every key whose texts are
   not all in one component brings these together, any two of its blocks in a task
   of their own, but for blocks that hold nothing outside its largest component.

Scale: the shuffle of keys grows with the texts and nothing else. Equal texts count
once in each task from the start, and a key that many texts of a task share is
sent once from there, so copies, near copies and common passages cost each task one
row. No pair of a group is listed; components come from star contraction on slim
tables that are written each round, the last one replacing the one before.

Edge cases: null or empty text has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle; null doc_ids are ignored in
the smallest id of a component unless there is no other; repeated rows are rows
of their own with the same result; a very long text is one set like any other and
may fill a block by itself; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, discard, materialise, row_key, slices

WIDTH = 4
PERCENT = 85
#: A block's texts, and their shingles together, about: they bound a task's time and memory (some 70 MB).
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
#: Shares that one node's edges, or the rows of one set, are dealt into for joins.
SALTS = 64
#: Characters that are hashed together, and those whose texts look for shared keys before any are sent.
CHUNK, WINDOW = 1_000_000, 8_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    raw = [b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]  # bytes: A-Z only
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = ~_BLANK[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    n = len(buffer)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(pow(_BASE, -1, 1 << 64), n)
    words = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    cuts = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    long = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        long += words[j : j + len(long)] * _MULT[j]
    long = _mix(long)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(long[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * _MULT[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def most_apart(n: np.ndarray) -> np.ndarray:
    """How many shingles, at most, are in one only of two linked sets, one of which has n."""
    return (100 - PERCENT) * (n + 100 * n // PERCENT) // (100 + PERCENT)


def _bits(n: np.ndarray) -> np.ndarray:
    """Sets of n shingles have 2 to that power parts: more than most_apart(n)."""
    return np.frexp(most_apart(n).astype(float))[1].astype(np.int64)


def part_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """set, tag, key, rank of all keys: the number of the set, which of its groups of keys, and the place therein by
    most shingles. Linked sets share a key among the first most_apart + 1 of a group of each with the same tag."""
    n = np.array([len(s) for s in sets], np.int64)
    one, two = _bits(n), _bits(100 * n // PERCENT)
    group = np.concatenate([np.flatnonzero(n), np.flatnonzero((n > 0) & (one != two))])
    if not len(group):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bits = np.concatenate([one[n > 0], two[(n > 0) & (one != two)]])
    flat = np.concatenate([sets[i] for i in group.tolist()])
    at = np.repeat(np.arange(len(group)), n[group])
    part = np.where(bits[at] > 0, flat >> np.minimum(64 - bits[at], 63).astype(np.uint64), np.uint64(0))
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    held, own = np.diff(np.append(first, len(flat))), at[first]
    key = _mix(np.add.reduceat(_mix(flat), first) + bits[own].astype(np.uint64))
    order = np.lexsort((key, -held, own))
    own, key = own[order], key[order]
    begin = np.searchsorted(own, np.arange(len(group)))
    found = [(group[own], bits[own], key, np.arange(len(own)) - begin[own])]
    for i in group[np.bincount(own, minlength=len(group)) <= most_apart(n[group])].tolist():
        plain = _mix(sets[i] ^ np.uint64(PLAIN))
        found.append((np.full(len(plain), i), np.full(len(plain), -1), plain, np.arange(len(plain))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Sets keys of single shingles apart from those of parts.
PLAIN = 0x5DEECE66D

NODES = "sig binary, sid long, n long, ids array<long>, rows array<binary>, keys array<long>, near array<long>"
_NODES = pa.schema([("sig", pa.binary()), ("sid", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, text) to NODES: of each set in a window of texts its rows; where the set comes first in its
    task also its keys, but for those that another set of the window has sent, and near: the sets that did."""
    seen: set[bytes] = set()

    def flush(own: dict[bytes, tuple]) -> pa.RecordBatch:
        fresh = [sig for sig, x in own.items() if x[0] is not None and len(x[0])]
        sids = np.array([_sid(sig) for sig in fresh], np.int64)
        sets = [own[sig][0] for sig in fresh]
        at, _, key, rank = part_keys(sets)
        use = np.flatnonzero(rank <= most_apart(np.array([len(s) for s in sets], np.int64))[at])
        use = use[np.argsort(at[use], kind="stable")]
        at, key = at[use], key[use]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        holder = at[first][which]
        sent = np.zeros(len(key), bool)
        sent[first] = True
        own_keys, other = key[sent].view(np.int64), np.unique(np.stack([at, holder], 1)[holder != at], axis=0)
        mine = [own_keys[a:b] for a, b in _runs(at[sent], len(fresh))]
        others = sids[other[:, 1]]
        near = [others[a:b] for a, b in _runs(other[:, 0], len(fresh))]
        place = {sig: i for i, sig in enumerate(fresh)}
        columns = [list(own), [_sid(sig) for sig in own], [x[1] for x in own.values()], [x[2] for x in own.values()], [x[3] for x in own.values()]]
        columns += [[x[place[sig]] if sig in place else None for sig in own] for x in (mine, near)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _NODES.types, strict=True)], schema=_NODES)

    own: dict[bytes, tuple] = {}
    size = 0
    for batch in slices(batches):
        doc_ids, rows, texts = (c.to_pylist() for c in batch.columns)
        for a, b in chunks(["" if t is None else t for t in texts], CHUNK):
            for i, s in enumerate(shingle_sets(texts[a:b]), a):
                sig = signature(s)
                if sig not in own:
                    own[sig] = (None if sig in seen else s, len(s), [], [])
                    seen.add(sig)
                own[sig][2].append(doc_ids[i])
                own[sig][3].append(rows[i])
                size += len(texts[i] or "") + 100
            if size >= WINDOW:
                yield flush(own)
                own, size = {}, 0
    if own:
        yield flush(own)


def _sid(sig: bytes) -> int:
    """A short name that different sets have in common by rare chance only, which costs a comparison."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _runs(numbers: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Where each of 0..n-1 begins and ends in sorted numbers."""
    cuts = np.searchsorted(numbers, np.arange(n + 1)).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sid) sorted by key to edges a, b: each sid with the first one of its key."""
    last, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = (np.asarray(c) for c in batch.columns)
        begin = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(begin, np.arange(len(key)), -1))
        head = np.where(at >= 0, sid[np.maximum(at, 0)], sid[0] if hub is None else hub)
        last, hub = key[-1], head[-1]
        found = np.unique(np.stack([sid, head], 1)[sid != head], axis=0)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


class Tree:
    """Signature tree over items sorted by size: (left, right, bitmap, least, most, spare, one item below).

    With sides, one tree for each side, and only pairs across."""

    def __init__(self, sizes: list[int], bitmaps: list[int], union: Union, items: list[int] | None = None, sides: list[bool] | None = None):
        """items: what the union calls each item; by default its place."""
        self.union = union
        items = list(range(len(sizes))) if items is None else items
        self.nodes = [(None, None, b, n, n, n - b.bit_count(), i) for i, n, b in zip(items, sizes, bitmaps, strict=True)]
        self.same = [True] * len(sizes)  # all items below known to be in one component
        parts = [range(len(sizes))] if sides is None else [[i for i, x in enumerate(sides) if x == side] for side in (False, True)]
        self.roots = [self._grow(sorted(part, key=lambda i: sizes[i])) for part in parts]

    def _grow(self, level: list[int]) -> int | None:
        while len(level) > 1:
            up = []
            for a, b in zip(level[::2], level[1::2], strict=False):
                x, y = self.nodes[a], self.nodes[b]
                self.nodes.append((a, b, x[2] | y[2], min(x[3], y[3]), max(x[4], y[4]), max(x[5], y[5]), x[6]))
                self.same.append(False)
                up.append(len(self.nodes) - 1)
            level = up + level[len(level) - len(level) % 2 :]
        return level[0] if level else None

    def one(self, v: int) -> bool:
        if not self.same[v]:
            a, b = self.nodes[v][:2]
            self.same[v] = self.one(a) and self.one(b) and self.union.find(self.nodes[a][6]) == self.union.find(self.nodes[b][6])
        return self.same[v]

    def hopeless(self, x: tuple, y: tuple) -> bool:
        """No two items below can link: sizes too far apart, or the largest possible overlap too small."""
        if 100 * x[4] < PERCENT * y[3] or 100 * y[4] < PERCENT * x[3]:
            return True
        # Of two sets, a common element lies on a common bit; more elements than bits only by the spare ones.
        most = min((x[2] & y[2]).bit_count() + min(x[5], y[5]), x[4], y[4])
        return (100 + PERCENT) * most < PERCENT * (x[3] + y[3])

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of items that may link and are not yet in one component when given."""
        if None in self.roots:
            return
        todo = [(self.roots[0], self.roots[-1])]
        while todo:
            v, w = todo.pop()
            x, y = self.nodes[v], self.nodes[w]
            if v == w:
                if x[0] is not None and not self.one(v):
                    todo += [(x[0], x[1]), (x[0], x[0]), (x[1], x[1])]
                continue
            if self.hopeless(x, y) or self.one(v) and self.one(w) and self.union.find(x[6]) == self.union.find(y[6]):
                continue
            if x[0] is None and y[0] is None:
                yield x[6], y[6]
            elif y[0] is None or x[0] is not None and x[4] - x[3] >= y[4] - y[3]:
                todo += [(x[0], w), (x[1], w)]
            else:
                todo += [(v, y[0]), (v, y[1])]


def bits_for(n: int) -> int:
    size = 64
    while size < 16 * n:
        size *= 2
    return size


def bitmap(shingles: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, np.uint8)
    bits[shingles.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(sizes: list[int], bitmaps: list[int], union: Union, sides: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs that may link, by trees of items whose bitmaps, of bits_for(size) bits, have the same length.

    Sizes of linked sets differ so little that their bitmaps' lengths are equal or neighbours; a longer one is folded.
    """
    widths = [bits_for(n) for n in sizes]
    for width in sorted(set(widths)):
        own = [i for i, w in enumerate(widths) if w == width]
        most = max(sizes[i] for i in own)
        near = [i for i, w in enumerate(widths) if w == 2 * width and PERCENT * sizes[i] <= 100 * most]
        low = (1 << width) - 1
        folded = [bitmaps[i] for i in own] + [bitmaps[i] & low | bitmaps[i] >> width for i in near]
        items = own + near
        tree = Tree([sizes[i] for i in items], folded, union, items, None if sides is None else [sides[i] for i in items])
        for i, j in tree.pairs():
            if widths[i] == width or widths[j] == width:
                yield i, j


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _dealt(edges: DataFrame) -> DataFrame:
    """Edges u, v with a salt, over which a node's edges are dealt, so that no node's edges meet in one task."""
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))


def _least(edges: DataFrame) -> DataFrame:
    """u, salt, m: the least v of a node, once for each salt of its dealt edges."""
    parts = edges.groupBy("u", "salt").agg(F.min("v").alias("m"))
    return parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select("u", "m", F.explode("salts").alias("salt"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) of all nodes in edges (a, b).

    Large-star and small-star steps in turn, until every node hangs on one root. The edges at a node may be a large part
    of all; they are joined with its least neighbour in SALTS shares.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "jaccard-edges")
    on = ["u", "salt"]
    while _unsettled(now):
        both = _dealt(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # Large star: every larger neighbour to the least of the neighbourhood.
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = _dealt(both.where("v > u").join(least, on).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # Small star: every smaller neighbour, and the node, to the least of them.
        small = _least(large)
        moved = large.join(small, on).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialise(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "jaccard-edges", now)
    return with_roots(now.select(F.col("u").alias("node"), F.col("v").alias("comp")))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two larger ends, or is a lower end as well."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def with_roots(labels: DataFrame) -> DataFrame:
    """node, comp with a row for each root as well."""
    return labels.unionByName(labels.select(F.col("comp").alias("node"), "comp").distinct())


#: A set's name: whether it has no doc_id, its least one, its signature. Names sort by these, so the least name of a
#: component has the component's id.
def _name(least: Column, sig: Column) -> Column:
    number = F.lpad(F.hex(F.coalesce(least, F.lit(0).cast("long")).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.concat(F.when(least.isNull(), "01").otherwise("00"), number)), sig)


def _id_of(name: Column) -> Column:
    number = F.conv(F.hex(F.substr(name, F.lit(2), F.lit(8))), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substr(name, F.lit(1), F.lit(1))) == "00", number.cast("long"))


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, low, high, side, name, comp, text) to a, b: each name that links in its block, with the least of
    its component there. Rows of the same comp are known to be connected; where high is not low, only the sides meet."""

    def connected(rows: dict[bytes, tuple], across: bool) -> pa.RecordBatch | None:
        names, sets = list(rows), [x[2] for x in rows.values()]
        union, first = Union(len(rows)), {}
        for i, x in enumerate(rows.values()):
            union.join(i, first.setdefault(x[1], i))
        bits = [int.from_bytes(bitmap(s, bits_for(len(s))), "little") for s in sets]
        for i, j in may_link([len(s) for s in sets], bits, union, [x[0] for x in rows.values()] if across else None):
            if union.find(i) != union.find(j) and linked(sets[i], sets[j]):
                union.join(i, j)
        least: dict[int, bytes] = {}
        for i, name in enumerate(names):
            at = union.find(i)
            least[at] = min(name, least.get(at, name))
        found = [(name, least[union.find(i)]) for i, name in enumerate(names) if name != least[union.find(i)]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"]) if found else None

    now, rows = None, {}
    for batch in slices(batches):
        *columns, texts = (c.to_pylist() for c in batch.columns)
        cuts = list(chunks(["" if t is None else t for t in texts], CHUNK))
        sets = (s for a, b in cuts for s in shingle_sets(texts[a:b]))
        for cluster, low, high, side, name, comp, s in zip(*columns, sets, strict=True):
            if (cluster, low, high) != now:
                if len(rows) > 1 and (found := connected(rows, now[1] != now[2])):
                    yield found
                now, rows = (cluster, low, high), {}
            if len(s) and signature(s) == name[-16:]:
                rows[name] = (side, comp, s)
    if len(rows) > 1 and (found := connected(rows, now[1] != now[2])):
        yield found


MEETING = ["cluster", "low", "high", "side", "name", "comp"]


def _meet(rows: DataFrame, texts: DataFrame, on: str) -> DataFrame:
    """a, b that _connect finds among rows (MEETING and the column that texts are found by)."""
    met = rows.join(texts, on).select(*MEETING, "text")
    keys = MEETING[:3]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_connect, "a binary, b binary")


def _whole(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (cluster, name) as one block for each cluster."""
    zero = F.lit(0).cast("long")
    return rows.select(F.col("cluster").cast("string").cast("binary").alias("cluster"), zero.alias("low"), zero.alias("high"), F.lit(False).alias("side"), "name", F.col("name").alias("comp"), *more)


def _n_blocks() -> Column:
    """Blocks that rows with n shingles each need."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")


def _large(rows: DataFrame) -> DataFrame:
    """cluster, blocks of those that need several; few, and written, so Spark knows how few."""
    return materialise(rows.groupBy("cluster").agg(_n_blocks()).where("blocks > 1"), "jaccard-large")


def linked_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, comp (names) of all sets that are linked with another; nodes: NODES; docs: row, text."""
    keyed = nodes.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "sid")
    shared = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_sharing, "a long, b long")
    edges = nodes.select(F.col("sid").alias("a"), F.explode("near").alias("b")).unionByName(shared)
    clusters = components(edges).select(F.col("node").alias("sid"), F.col("comp").alias("cluster"))
    met = nodes.where("n > 0").select("sid", "sig", "n", F.array_min("ids").alias("least"), F.get("rows", F.lit(0)).alias("row")).join(clusters, "sid")
    sets = met.groupBy("cluster", "sig").agg(F.first("n").alias("n"), F.min("least").alias("least"), F.min("row").alias("row"))
    sets = materialise(sets.select("cluster", _name(F.col("least"), F.col("sig")).alias("name"), "n", "row"), "jaccard-sets")
    large = _large(sets)
    small = sets if large.isEmpty() else sets.join(large, "cluster", "left_anti")
    done = materialise(_meet(_whole(small, "row"), docs, "row"), "jaccard-first")
    # What a cluster of one block has found is final.
    labels = with_roots(done.select(F.col("a").alias("node"), F.col("b").alias("comp")))
    if large.isEmpty():
        return labels
    own = sets.join(large, "cluster", "left_semi")
    own = materialise(own.join(docs, "row").select("name", "n", "text").dropDuplicates(["name"]), "jaccard-large-texts")
    return labels.unionByName(components(_cut_anew(own)))


def _every_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, text) to name, tag, most (keys of the tag that are looked up), key."""
    for batch in slices(batches):
        names, texts = (c.to_pylist() for c in batch.columns)
        for a, b in chunks(texts, CHUNK):
            sets = shingle_sets(texts[a:b])
            at, tag, key, _ = part_keys(sets)
            most = most_apart(np.array([len(s) for s in sets], np.int64))[at] + 1
            yield pa.RecordBatch.from_arrays([pa.array([names[a + i] for i in at.tolist()], pa.binary()), pa.array(tag), pa.array(most), pa.array(key.view(np.int64))], names=["name", "tag", "most", "key"])


def _cut_anew(own: DataFrame) -> DataFrame:
    """Edges a, b of the links among sets of large clusters (name, n, text)."""
    every = materialise(own.select("name", "text").mapInArrow(_every_key, "name binary, tag long, most long, key long"), "jaccard-every")
    counted = every.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rarest = F.row_number().over(W.partitionBy("name", "tag").orderBy("df", "key"))
    rows = every.join(counted, "key", "left").withColumn("df", F.coalesce("df", F.lit(1).cast("long"))).withColumn("nth", rarest).where("nth <= most and df > 1")
    rows = materialise(rows.select("name", "key", "df").distinct(), "jaccard-rarest")
    hubs = rows.groupBy("key").agg(F.min("name").alias("hub"))
    clusters = components(rows.join(hubs, "key").select(F.col("name").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("name"), F.col("comp").alias("cluster"))
    sets = materialise(clusters.join(own.select("name", "n"), "name"), "jaccard-cut")
    large = _large(sets)
    texts = own.select("name", "text")
    found = materialise(_meet(_whole(sets.join(large, "cluster", "left_anti").select(F.hex("cluster").alias("cluster"), "name")), texts, "name"), "jaccard-cut-links")
    if large.isEmpty():
        return found
    still = sets.join(large, "cluster", "left_semi").select("name", "n")
    return found.unionByName(_key_by_key(rows.join(still, "name"), texts))


def _key_by_key(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges a, b of the links among sets (name, n, key, df), which fill several blocks."""
    top = rows.groupBy("name").agg(F.max_by("key", F.struct("df", "key")).alias("key"), F.first("n").alias("n"))
    dealt = top.join(top.groupBy("key").agg(_n_blocks()), "key").withColumn("low", F.pmod(F.xxhash64("name"), F.col("blocks")))
    cluster = F.col("key").cast("string").cast("binary").alias("cluster")
    first = dealt.select(cluster, "low", F.col("low").alias("high"), F.lit(False).alias("side"), "name", F.col("name").alias("comp"))
    first = materialise(_meet(first, texts, "name"), "jaccard-begun")
    known = components(first).withColumnRenamed("node", "name")
    rows = materialise(rows.join(known, "name", "left").withColumn("comp", F.coalesce("comp", "name")), "jaccard-rows")
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"))
    apart = per.groupBy("key").agg(F.sum("count").alias("total"), F.sum("n").alias("weight"), F.max(F.struct("count", "n", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # Two blocks meet in a task, so each is half of one; those of the key's largest component don't meet each other.
    halves = lambda count, n: F.ceil(F.greatest(2 * count / BLOCK, 2 * n / BLOCK_SHINGLES))
    others, most = halves(F.col("total") - F.col("top.count"), F.col("weight") - F.col("top.n")), halves(F.col("top.count"), F.col("top.n"))
    is_top, small = F.col("comp") == F.col("top.comp"), (F.col("total") <= BLOCK) & (F.col("weight") <= BLOCK_SHINGLES)
    block = F.when(small, F.lit(0).cast("long")).when(is_top, others + F.pmod(F.xxhash64("name"), most)).otherwise(F.pmod(F.xxhash64("name"), others))
    partners = F.sequence(F.lit(0).cast("long"), F.when(small, F.lit(0)).when(is_top, others - 1).otherwise(others + most - 1))
    dealt = rows.join(apart, "key").withColumn("block", block).withColumn("other", F.explode(partners))
    met = dealt.select(cluster, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("side"), "name", "comp")
    return first.unionByName(materialise(_meet(met, texts, "name"), "jaccard-second"))


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NODES, and sets (sig, least, name, root: the name that its component goes by, best: null_id, doc_id, row of the row
    that may stay) of all but empty ones."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    nodes = materialise(own.mapInArrow(_nodes, NODES), "jaccard-nodes")
    labels = materialise(linked_sets(nodes, own.select("row", "text")), "jaccard-components")
    best = F.array_min(F.transform(F.arrays_zip("ids", "rows"), lambda x: F.struct(x["ids"].isNull().alias("null_id"), x["ids"].alias("doc_id"), x["rows"].alias("row"))))
    sets = nodes.where("n > 0").select("sig", best.alias("best")).groupBy("sig").agg(F.min("best").alias("best"))
    sets = sets.withColumn("name", _name(F.col("best.doc_id"), F.col("sig")))
    labels = labels.select(F.substr("node", F.lit(10), F.lit(16)).alias("sig"), F.col("comp").alias("root"))
    return nodes, sets.join(labels, "sig", "left").withColumn("root", F.coalesce("root", "name"))


def jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    nodes, sets = _sets(docs)
    # The rows of one set may be a third of all: they stay in lists, one of a task's window, that are dealt over tasks.
    own = nodes.select("sig", "n", "ids", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt"))
    salts = own.groupBy("sig").agg(F.collect_set("salt").alias("salts"))
    named = sets.select("sig", "root").join(salts, "sig").select("sig", "root", F.explode("salts").alias("salt"))
    joined = own.join(named, ["sig", "salt"], "left").select("n", "root", F.explode("ids").alias("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, _id_of(F.col("root"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id, and with all rows without words; same columns.

    Rows are told apart by id and text together, so repeated and null ids are no trouble; of several texts with a
    component's smallest id one stays, and of rows that agree in both any one. Texts are moved once.
    """
    nodes, sets = _sets(docs)
    kept = sets.where(F.col("root") == F.col("name")).select(F.col("best.row").alias("__llm_row"), F.lit(False).alias("__llm_bare"))
    kept = kept.unionByName(nodes.where("n = 0").select(F.explode("rows").alias("__llm_row"), F.lit(True).alias("__llm_bare")).distinct())
    own = docs.withColumn("__llm_row", row_key(F.col("doc_id"), F.col("text"))).join(kept, "__llm_row")
    nth = F.when(F.col("__llm_bare"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return own.withColumn("__llm_nth", nth).dropDuplicates(["__llm_row", "__llm_nth"]).select(*docs.columns)
