"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Text is cut into marked words: each begins at a run of spaces, which become word
marks, or at a line feed. The best segmentation of a word is the one with the
highest sum of piece scores (Viterbi). A batch's distinct words go through the
trie of pieces together, as arrays: from each position all words that reach so far
take a step at once. Few words, very long ones and such as need bytes go one by one,
sorted, so that the forward scores of a shared prefix are computed once.

The vocabulary file holds merge ranks, not probabilities. Those are estimated: from
scores of -log(r + 2) for a piece of rank r (Zipf's law), ROUNDS of expectation and
maximisation. A round counts how often each piece is expected in the words of all
texts, over all segmentations (forward and backward sums), and takes the logs of
the shares, each count raised by SMOOTH, as scores. A byte costs more than the
rarest piece. Decoding is exact: a literal word mark in the text is spelled in bytes,
the mark itself is always a space.

Scale: encoding is one narrow pass without a shuffle; a worker remembers words up to
a bound. Before it, another pass counts the words of all texts whole: tasks hand on
their counts whenever they hold COUNTED words, and Spark sums them, so a round works on
distinct words however often they come. As many numbers as there are pieces reach the
driver.

Edge cases: null or empty text has no ids; characters without a piece go as
bytes; lone surrogates are replaced by a question mark as Spark's strings hold
none; of segmentations with the same score the one whose last piece is longest is
taken; repeated rows are encoded each; a very long text is encoded whole; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
BYTE_COST = 12.0
ROUNDS, SMOOTH = 3, 0.1
#: Words that a task counts before it hands on their counts.
COUNTED = 200_000
#: Below this a word's probability is counted in logs: longer words, or such as are spelled in bytes.
TINY = 1e-200
REMEMBERED = 300_000
#: Texts whose words are sorted together.
TOGETHER = 500
#: Characters of words that go through the trie together, filled up to the longest; and how many words are worth that.
CELLS, ENOUGH = 200_000, 32

#: No piece has a mark behind another character, or a line feed inside, so words begin with a run of marks or a line feed.
_WORD = re.compile(f"(?:{MARK}+|\n)[^{MARK}\n]*")
#: A private character that introduces, within marked text, a literal mark (1) or itself (0).
_ASIDE = "\ue000"


def _n_bytes(codes: np.ndarray) -> np.ndarray:
    """How many bytes of UTF-8 each character takes."""
    return 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)


class Trie:
    """The pieces' beginnings as a double array: from node x character kind k leads to base[x] + k if that one's check is x."""

    def __init__(self, pieces: dict[str, tuple[int, float]], beginnings: set[str]):
        letters = sorted({p[-1] for p in beginnings})
        #: By code point; 0 stands in no piece.
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k for k, c in enumerate(letters, 1)}
        below: dict[str, list[int]] = {}
        for p in beginnings:
            below.setdefault(p[:-1], []).append(number[p[-1]])
        used, free, base = bytearray(1), 1, {}
        for p in sorted(below, key=lambda p: (-len(below[p]), p)):
            kinds = sorted(below[p])
            while free < len(used) and used[free]:
                free += 1
            at = max(free, kinds[0])
            for at in range(at, min(at + 50, len(used))):
                if not any(used[i] for k in kinds if (i := at - kinds[0] + k) < len(used)):
                    break
            else:
                at = max(len(used), kinds[0])
            base[p] = at - kinds[0]
            used.extend(bytes(max(0, base[p] + kinds[-1] + 1 - len(used))))
            for k in kinds:
                used[base[p] + k] = 1
        slot = {p: base[p[:-1]] + number[p[-1]] for p in beginnings} | {"": 0}
        self.base, self.check, self.piece = (np.full(len(used) + len(letters) + 1, x, np.int32) for x in (0, -1, -1))
        for p, x in slot.items():
            self.base[x] = base.get(p, 0)
            if p:
                self.check[x] = slot[p[:-1]]
        for p, (i, _) in pieces.items():
            self.piece[slot[p]] = i

    def walk(self, codes: np.ndarray, reach: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """codes: a row for each position, a column for each word, words by falling length; reach: how many words are longer
        than each position. Start, end, words and ids of all pieces that stand there, by start and end."""
        kinds = self.kind[codes]
        for start in range(len(reach)):
            words, nodes = np.arange(reach[start]), np.zeros(reach[start], np.int32)
            for at in range(start, len(reach)):
                if at > start:
                    most = np.searchsorted(words, reach[at])
                    words, nodes = words[:most], nodes[:most]
                ahead = self.base[nodes] + kinds[at, words]
                there = self.check[ahead] == nodes
                words, nodes = words[there], ahead[there]
                if not len(words):
                    break
                ids = self.piece[nodes]
                there = ids >= 0
                if there.any():
                    yield start, at + 1, words[there], ids[there]


class Codec:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_cost: float = BYTE_COST, trie: Trie | None = None):
        """pieces: to id and score; byte_ids: ids of the 256 bytes; trie: of the same pieces."""
        self.pieces, self.byte_ids, self.byte_cost = pieces, byte_ids, byte_cost
        self.spelling = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.longest = max(map(len, pieces), default=1)
        self.beginnings = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.trie = trie or Trie(pieces, self.beginnings)
        self.scores = np.zeros(max((i for i, _ in pieces.values()), default=-1) + 1)
        for i, x in pieces.values():
            self.scores[i] = x
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, model: str = MODEL) -> Codec:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        pieces, byte_ids, rank = {}, [0] * 256, 0
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = (i, -math.log(rank + 2))
                rank += 1
        return cls(pieces, byte_ids)

    def scored(self, scores: np.ndarray) -> Codec:
        """The same pieces with scores by id."""
        own = {p: (i, float(scores[i])) for p, (i, _) in self.pieces.items()}
        return Codec(own, self.byte_ids, 1.0 - min((s for _, s in own.values()), default=0.0), self.trie)

    def expected(self, word: str) -> dict[int, float]:
        """How often each piece is expected in a word, over all its segmentations by their probabilities."""
        n, edges = len(word), []
        front, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for s in range(n):
            edges.append((s, s + 1, -1, -self.byte_cost * len(word[s].encode())))
            for e in range(s + 1, min(n, s + self.longest) + 1):
                part = word[s:e]
                if (found := self.pieces.get(part)) is not None:
                    edges.append((s, e, found[0], found[1]))
                if part not in self.beginnings:
                    break
        likely = [math.exp(x) for *_, x in edges]
        for (s, e, _, _), p in zip(edges, likely, strict=True):  # in order of their starts
            front[e] += front[s] * p
        if front[n] < TINY:
            return self._expected_in_logs(n, edges)
        for (s, e, _, _), p in zip(reversed(edges), reversed(likely), strict=True):
            back[s] += p * back[e]
        out: dict[int, float] = {}
        for (s, e, i, _), p in zip(edges, likely, strict=True):
            if i >= 0:
                out[i] = out.get(i, 0.0) + front[s] * p * back[e] / front[n]
        return out

    @staticmethod
    def _expected_in_logs(n: int, edges: list[tuple[int, int, int, float]]) -> dict[int, float]:
        """The same where probabilities are too small for a number."""
        front, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        plus = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
        for s, e, _, x in edges:
            front[e] = plus(front[e], front[s] + x)
        for s, e, _, x in reversed(edges):
            back[s] = plus(back[s], back[e] + x)
        out: dict[int, float] = {}
        for s, e, i, x in edges:
            if i >= 0:
                out[i] = out.get(i, 0.0) + math.exp(front[s] + x + back[e] - front[n])
        return out

    @staticmethod
    def _blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
        """Where the words of a block stand, their lengths, which fall, their codes and reach as walk() takes them. What is left
        is too little for arrays: a block without codes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            own = order[at : at + max(1, CELLS // max(1, size))]
            own = own[sizes[own] >= size // 2 - 8]  # a very long word takes no short ones along
            at += len(own)
            if len(own) < ENOUGH or not size:
                yield own, sizes[own], np.zeros((0, 0), np.uint32), []
                continue
            n = sizes[own]
            codes = np.zeros((len(own), size), np.uint32)
            codes[np.arange(size) < n[:, None]] = np.frombuffer("".join([words[i] for i in own.tolist()]).encode("utf-32-le"), np.uint32)
            yield own, n, np.ascontiguousarray(codes.T), np.searchsorted(-n, -np.arange(size), "left").tolist()

    def total(self, words: list[str], counts: list[int]) -> np.ndarray:
        """How often each piece is expected in all words, by id: expected() of each word times its count."""
        out = np.zeros(len(self.scores))
        likely = np.exp(self.scores)
        for own, n, codes, reach in self._blocks(words):
            rest = own
            if len(reach):
                front, back = np.zeros((len(reach) + 1, len(own))), np.zeros((len(reach) + 1, len(own)))
                front[0] = 1
                back[n, np.arange(len(own))] = 1
                alone = np.exp(-self.byte_cost * _n_bytes(codes))
                edges, done = [], 0
                for edge in self.trie.walk(codes, reach):
                    start, end, at, ids = edge
                    for k in range(done, start + 1):  # bytes of the positions before, whose sums are whole now
                        if k:
                            front[k, : reach[k - 1]] += front[k - 1, : reach[k - 1]] * alone[k - 1, : reach[k - 1]]
                    done = start + 1
                    edges.append((start, end, at, ids, p := likely[ids]))
                    front[end, at] += front[start, at] * p
                for k in range(max(done, 1), len(reach) + 1):
                    front[k, : reach[k - 1]] += front[k - 1, : reach[k - 1]] * alone[k - 1, : reach[k - 1]]
                whole = front[n, np.arange(len(own))]
                rest = own[small := whole < TINY]
                times = np.where(small, 0.0, np.asarray(counts, float)[own] / np.where(small, 1.0, whole))
                i = len(edges)
                for start in range(len(reach) - 1, -1, -1):
                    back[start, : reach[start]] += alone[start, : reach[start]] * back[start + 1, : reach[start]]
                    while i and edges[i - 1][0] == start:
                        i -= 1
                        _, end, at, ids, p = edges[i]
                        x = p * back[end, at]
                        back[start, at] += x
                        edges[i] = ids, front[start, at] * x * times[at]
                if edges:
                    ids, x = (np.concatenate(c) for c in zip(*edges, strict=True))
                    out += np.bincount(ids, x, len(out))
            for k in rest.tolist():
                for i, x in self.expected(words[k]).items():
                    out[i] += counts[k] * x
        return out

    def mark(self, text: str) -> list[str]:
        """Marked words; a literal mark, and what stands for it, are put aside by a private character each."""
        safe = text.replace(_ASIDE, _ASIDE + "0").replace(MARK, _ASIDE + "1").replace(" ", MARK)
        return _WORD.findall(safe if safe[:1] in ("", "\n") else MARK + safe)

    def _bytes(self, part: str) -> list[int]:
        return [self.byte_ids[b] for b in part.encode()]

    def learn(self, words: set[str]) -> None:
        """Viterbi: remembers the words' ids."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        given = sorted(words)
        for own, n, codes, reach in self._blocks(given):
            if not len(reach):
                self._learn_sorted(sorted(given[k] for k in own.tolist()))
                continue
            best, last, ids = np.full((len(reach) + 1, len(own)), -np.inf), np.zeros((len(reach) + 1, len(own)), np.int32), np.full((len(reach) + 1, len(own)), -1, np.int32)
            best[0] = 0
            alone, done = self.byte_cost * _n_bytes(codes), 0

            def spell(k: int) -> None:
                """The character before k as bytes; of equal scores this one is taken."""
                r = reach[k - 1]
                score = best[k - 1, :r] - alone[k - 1, :r]
                better = score >= best[k, :r]
                best[k, :r][better], last[k, :r][better], ids[k, :r][better] = score[better], k - 1, -1

            for start, end, at, found in self.trie.walk(codes, reach):
                # The byte of the character at start comes before the pieces from there, when all of start is known.
                for k in range(done, start + 1):
                    spell(k + 1)
                done = start + 1
                score = best[start, at] + self.scores[found]
                better = score > best[end, at]
                at = at[better]
                best[end, at], last[end, at], ids[end, at] = score[better], start, found[better]
            for k in range(done, len(reach)):
                spell(k + 1)
            # Back from all words' ends at once.
            left, at, column = np.arange(len(own)), n.copy(), []
            plain = np.ones(len(own), bool)
            while len(left):
                column.append((left, found := ids[at, left]))
                plain[left[found < 0]] = False
                at = last[at, left]
                left, at = left[at > 0], at[at > 0]
            many = np.zeros(len(own), np.int64)
            for at, _ in column:
                many[at] += 1
            ends = np.cumsum(many)
            flat = np.zeros(int(ends[-1]), "<u4")
            for k, (at, found) in enumerate(column, 1):
                flat[ends[at] - k] = found.astype(np.uint32)
            raw, cuts = flat.tobytes(), (4 * ends).tolist()
            for k, a, b, whole in zip(own.tolist(), [0, *cuts], cuts, plain.tolist(), strict=False):
                if whole:
                    self.known[given[k]] = raw[a:b]
            self._learn_sorted(sorted(given[k] for k in own[~plain].tolist()))

    def _learn_sorted(self, words: list[str]) -> None:
        """One by one, sharing the forward scores of common prefixes."""
        pieces, beginnings, longest, known = self.pieces, self.beginnings, self.longest, self.known
        before = ""
        best: list[float] = [0.0]  # best score of each prefix of the present word
        back: list[int] = [0]  # where its last piece starts; -1 - start if it goes as bytes
        ready: list[list[int]] = [[]]  # starts from which a piece may still go on beyond each prefix
        for word in words:
            shared = 0
            top = min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], ready[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                score, start = best[end - 1] - self.byte_cost * len(c.encode()), -end  # -1 - (end - 1)
                going = []
                for s in (*ready[end - 1], end - 1):
                    part = word[s:end]
                    found = pieces.get(part)
                    if found is not None and best[s] + found[1] > score:
                        score, start = best[s] + found[1], s
                    if end - s < longest and part in beginnings:
                        going.append(s)
                best.append(score)
                back.append(start)
                ready.append(going)
            ids: list[int] = []
            at = len(word)
            while at:
                s = back[at]
                if s >= 0:
                    ids.append(pieces[word[s:at]][0])
                    at = s
                else:
                    ids.extend(reversed(self._bytes(word[at - 1])))
                    at -= 1
            known[word] = np.array(ids[::-1], "<u4").tobytes()
            before = word

    def _aside(self, word: str) -> bytes:
        """A word with characters put aside: those go as bytes, the rest as it is."""
        out = []
        for part in re.split(f"({_ASIDE}[01])", word):
            if part[:1] == _ASIDE:
                out.append(np.array(self._bytes(_ASIDE if part[1] == "0" else MARK), "<u4").tobytes())
            elif part:
                self.learn({part} - self.known.keys())
                out.append(self.known[part])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32."""
        marked = [self.mark(t) for t in texts]
        words = {w for some in marked for w in some}
        plain = {w for w in words if _ASIDE not in w}
        new = plain.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = plain
        self.learn(new)
        ids = {w: self.known[w] for w in plain}
        for w in words - plain:
            ids[w] = self._aside(w)
        return [b"".join(map(ids.__getitem__, some)) for some in marked]

    @functools.cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All spellings one after another, and by id where one starts and how long it is; 0 for an id without any."""
        sizes = np.zeros(max(self.spelling) + 1, np.int64)
        for i, x in self.spelling.items():
            sizes[i] = len(x)
        return np.frombuffer(b"".join(self.spelling[i] for i in sorted(self.spelling)), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: bytes) -> str:
        spelled, starts, sizes = self._spelled
        own = np.frombuffer(ids, "<u4")
        n = sizes[own]
        if not n.all():
            raise KeyError(f"no piece: {own[n == 0][0]}")
        raw = spelled[np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)].tobytes().decode("utf-8", "replace")
        # The mark before the first word stands for no space, unless the text begins with a line feed.
        return raw[1:] if raw[:1] == " " else raw


_CODECS: dict[str, Codec] = {}


def codec(model: str = MODEL, name: str = "", scores: np.ndarray | None = None) -> Codec:
    """One for each worker process, and for each name of scores, of which the last stays."""
    key = f"{model} {name}"
    if key not in _CODECS:
        if name:
            for old in [k for k in _CODECS if k != f"{model} "]:
                del _CODECS[old]
        _CODECS[key] = Codec.load(model) if scores is None else codec(model).scored(scores)
    return _CODECS[key]


def counted(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """word, n: how often each marked word comes in all texts. Of a word with characters put aside its other parts count,
    which are encoded each by itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = codec(model), Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
        for batch in slices(batches, TOGETHER):
            for text in batch.column(0).to_pylist():
                marked = own.mark(text)
                if _ASIDE in text or MARK in text:
                    marked = [p for w in marked for p in re.split(f"{_ASIDE}[01]", w) if p]
                words.update(marked)
            if len(words) >= COUNTED:
                yield told()
                words.clear()
        yield told()

    return docs.where("text is not null").select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, model: str = MODEL) -> np.ndarray | None:
    """Scores by id, estimated from all words of all documents; None where there is none."""
    start = codec(model)
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    words = materialise(counted(docs, model), "pieces-words").repartition(2 * tasks, "word").sortWithinPartitions("word")  # sums in one order
    scores = np.zeros(max(i for i, _ in start.pieces.values()) + 1)
    for i, s in start.pieces.values():
        scores[i] = s
    ids = np.array([i for i, _ in start.pieces.values()])
    # The first scores as probabilities.
    scores[ids] -= np.log(np.exp(scores[ids]).sum())
    for _ in range(ROUNDS):
        now = scores.astype(np.float32)

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own = codec(model).scored(now)
            total = np.zeros(len(own.scores))
            for batch in batches:
                total += own.total(*(c.to_pylist() for c in batch.columns))
            needed = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(needed, pa.int32()), pa.array(total[needed], pa.float64())], names=["id", "x"])

        # Whole millionths, so that sums are alike in any order.
        told = words.mapInArrow(expect, "id int, x double").groupBy("id").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x")).collect()
        if not told:
            return None
        counts = np.full(len(scores), SMOOTH)
        counts[[r.id for r in told]] += [r.x / 1e6 for r in told]
        scores[ids] = np.log(counts[ids] / counts[ids].sum())
    return scores.astype(np.float32)


def encode(docs: DataFrame, model: str = MODEL, scores: np.ndarray | None = None) -> DataFrame:
    """doc_id, ids (little-endian uint32), exact: whether decoding gives the text back. scores: of fit()."""
    name = "" if scores is None else hashlib.sha256(scores.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, name, scores)
        for batch in slices(batches, TOGETHER):
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            ids = own.encode(texts)
            exact = [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(exact, pa.bool_())], names=["doc_id", "ids", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, exact boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, TOGETHER):
            texts = [None if i is None else own.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, exact."""
    return encode(docs, scores=fit(docs)).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "exact")
