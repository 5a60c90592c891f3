"""Token counts by greedy longest match, with a linear automaton.

The vocabulary is a trie. Where greedy matching fails at a node, the tokens
that it would have emitted so far are known in advance: each node has a failure
link to the node that stands for what is left after they are popped, and the
number of popped tokens. Scanning a word is then one step or one link at a
time, linear in its length, and the count needs no pieces.

A word's first character carries the word mark, so the vocabulary's pieces with
the mark begin words and those without continue them. A character that no piece
begins with counts as its UTF-8 bytes (byte fallback).

Scale: one narrow pass without a shuffle; a worker remembers the counts of the
words it has seen, up to a bound.

Edge cases: null or empty text has no words and no tokens; white space that
separates words is ASCII's; repeated rows are counted each; a very long text, or
word, is counted whole; greedy matching knows no ties; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 500_000


def vocabulary(model: str = MODEL) -> list[str]:
    """Ordinary pieces of the model."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
    kinds = (sp.is_byte, sp.is_control, sp.is_unknown, sp.is_unused)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not any(k(i) for k in kinds)]


class Automaton:
    """Trie nodes are numbers; 0 is the root."""

    def __init__(self, pieces: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        self.token = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in self.child[v]:
                    self.child[v][c] = len(self.child)
                    self.child.append({})
                    self.token.append(False)
                v = self.child[v][c]
            self.token[v] = True
        self.fail, self.popped = [0] * len(self.child), [0] * len(self.child)
        self._link()

    def _link(self) -> None:
        """Breadth first. A token's node pops itself, and nothing is left. Else follow the parent's link, and the
        links from there, until the character fits; what is popped on the way adds up. A single character that is
        no token, or that nothing begins with, pops its bytes."""
        level = [(0, 0)]
        while level:
            following = []
            for u, depth in level:
                for c, v in self.child[u].items():
                    following.append((v, depth + 1))
                    if self.token[v] or not depth:
                        self.popped[v] = 1 if self.token[v] else _bytes(c)
                        continue
                    at, n = self._step(self.fail[u], c)
                    self.fail[v], self.popped[v] = at, self.popped[u] + n
            level = following

    def _step(self, v: int, c: str) -> tuple[int, int]:
        """The node after c, and what was popped to get there."""
        n = 0
        while v and c not in self.child[v]:
            n += self.popped[v]
            v = self.fail[v]
        if c in self.child[v]:
            return self.child[v][c], n
        return 0, n + _bytes(c)

    def count(self, word: str) -> int:
        """Tokens of greedy longest match; characters that no token begins with count as their bytes."""
        v, total = 0, 0
        for c in word:
            v, n = self._step(v, c)
            total += n
        while v:
            total += self.popped[v]
            v = self.fail[v]
        return total


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


_AUTOMATA: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def automaton(model: str) -> tuple[Automaton, dict[bytes, int]]:
    """One for each worker process, with the counts of words seen."""
    if model not in _AUTOMATA:
        _AUTOMATA[model] = Automaton(vocabulary(model)), {}
    return _AUTOMATA[model]


def counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = automaton(model)
        for batch in slices(batches):
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                new = set(words).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set(words)
                known.update((w, own.count(MARK + w.decode("utf-8", "surrogatepass"))) for w in new)
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
