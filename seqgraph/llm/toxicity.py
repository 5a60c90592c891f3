"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic model over
its words and word beginnings; the document's score is the noisy-or of its
sentences, 1 - prod(1 - p). Only documents carry labels: the gradient of the
document's log loss is shared out among the sentences, so the model learns by
itself which sentences offend, and can point at them afterwards.

Scale: the model is fitted on a bounded sample (at most PER_CLASS labelled ids
of each class, those with the smallest hash, one text of each and none longer
than LONGEST, so neither the corpus nor a text decides its size). Scoring is one
narrow pass over whole texts without a shuffle; the weights are a vector of fixed
size.

Edge cases: null or empty text has no sentence and scores 0; a null doc_id is
scored but never learned from; a doc_id with contradicting labels counts as
toxic; of several texts with one labelled id the one with the smallest hash is
learned from; repeated rows are scored each; without a labelled document of each
class every score is 0; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, slices

#: Labelled ids of each class that the model is fitted on, at most, and characters of a text among them.
#: Both together bound what reaches the driver: two features for each word of 80 M characters at most.
PER_CLASS, LONGEST = 2_000, 20_000
#: Weights; words and word beginnings are hashed to them.
DIM = 1 << 18
PREFIX = 4
THRESHOLD = 0.7
#: A sentence of such a score offends.
OFFENDING = 0.5
STEPS, RATE, L1, L2, BIAS = 300, 0.3, 2e-5, 1e-6, -10.0
#: Chi-square that a feature needs to enter the model.
TELLING = 15.0
#: And how many times as often toxic documents must hold it as clean ones.
LIFT = 4.0

SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
WORD = re.compile(r"\w+")


def features(word: str) -> tuple[int, int]:
    """Of a lower-cased word: itself and its beginning."""
    return zlib.crc32(word.encode()) % DIM, zlib.crc32(b"^" + word[:PREFIX].encode()) % DIM


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text to toxic, lens (features of each sentence) and ids."""
    for batch in slices(batches):
        rows = []
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bags = [sorted({i for w in set(WORD.findall(s.lower())) for i in features(w)}) for s in SENTENCE.findall(text or "")]
            bags = [b for b in bags if b]
            rows.append((toxic, [len(b) for b in bags], [i for b in bags for i in b]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["toxic", "lens", "ids"])


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """toxic and text of a bounded sample of labelled rows; usable: which doc_ids may be learned from."""
    return labelled(docs, labels.where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "toxic", PER_CLASS, LONGEST)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> np.ndarray:
    """DIM weights and the bias."""
    rows = sample(docs, labels, usable).mapInArrow(_featurise, "toxic int, lens array<int>, ids array<int>").collect()
    rows.sort(key=lambda r: (r.toxic, r.ids, r.lens))  # sums come out alike however Spark deals the rows
    return fit_bags(*([r[k] for r in rows] for k in range(3)))


def fit_bags(labels: list[int], lens: list, ids: list) -> np.ndarray:
    """Gradient descent on the log loss of noisy-or; classes weigh the same."""
    weights = np.zeros(DIM + 1)
    weights[DIM] = BIAS
    bags = [(y, np.asarray(n, np.int64), np.asarray(i, np.int64)) for y, n, i in zip(labels, lens, ids, strict=True) if len(n)]
    y = np.array([b[0] for b in bags], float)
    if not len(bags) or y.min() == y.max():
        return weights
    feats = telling(y, [b[2] for b in bags])
    if not len(feats):
        return weights
    bags = [_only(b, feats) for b in bags]
    sizes = np.concatenate([b[1] for b in bags])
    column = np.concatenate([b[2] for b in bags])
    per_doc = np.array([len(b[1]) for b in bags])
    doc_first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(bags)), per_doc)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, bias, seen, seen_bias = np.zeros(len(feats)), BIAS, np.full(len(feats), 1e-8), 1e-8
    for _ in range(STEPS):
        logit = np.bincount(sentence, w[column], len(sizes)) + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), doc_first)  # log of the chance that no sentence offends
        score = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        # d loss / d logit of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        pull = share * np.where(y == 1, -(1 - score) / score, 1.0)
        grad = pull[doc] * p
        g = np.bincount(column, grad[sentence], len(feats)) + L2 * w
        seen += g * g
        step = RATE / np.sqrt(seen)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        g = grad.sum()
        seen_bias += g * g
        bias -= 0.05 * g / np.sqrt(seen_bias)
    weights[feats] = w
    weights[DIM] = bias
    return weights


def telling(y: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """Features that more toxic than clean documents hold than chance explains (chi-square of TELLING), LIFT times as often at least."""
    every = np.concatenate([np.unique(i) for i in ids])
    toxic = np.repeat(y == 1, [len(np.unique(i)) for i in ids])
    feats, at = np.unique(every, return_inverse=True)
    a, b = np.bincount(at, toxic, len(feats)), np.bincount(at, ~toxic, len(feats))
    pos, neg = y.sum(), (1 - y).sum()
    c, d = pos - a, neg - b
    chi = (pos + neg) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * pos * neg, 1e-9)
    return feats[(chi >= TELLING) & (a * neg >= LIFT * b * pos)]


def _only(bag: tuple, feats: np.ndarray) -> tuple:
    """The bag with those features only, by their place in feats."""
    y, lens, ids = bag
    at = np.minimum(np.searchsorted(feats, ids), len(feats) - 1)
    kept = feats[at] == ids
    return y, np.bincount(np.repeat(np.arange(len(lens)), lens)[kept], minlength=len(lens)), at[kept]


class Scorer:
    """Sentence and document scores from the weights; each word's weight is looked up once."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def word(self, w: str) -> float:
        found = self.known.get(w)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            a, b = features(w)
            found = self.known[w] = float(self.weights[a] + (self.weights[b] if a != b else 0))
        return found

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, logits = [], []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            if words:
                spans.append(m.span())
                logits.append(sum(map(self.word, words)))
        return spans, 1 / (1 + np.exp(-np.clip(np.array(logits, float) + self.weights[DIM], -30, 30)))

    def both(self, text: str | None, least: float) -> tuple[float, list[dict]]:
        """The document's score, and the sentences that score least or more."""
        spans, p = self.sentences(text or "")
        score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0
        return score, [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= least).tolist()]

    def document(self, text: str | None) -> float:
        return self.both(text, 2.0)[0]

    def offending(self, text: str | None, least: float = OFFENDING) -> list[dict]:
        return self.both(text, least)[1]


def _sparse(weights: np.ndarray) -> tuple:
    kept = np.flatnonzero(weights)
    return kept.astype(np.int32), weights[kept].astype(np.float32)


def _dense(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    weights = np.zeros(DIM + 1, np.float32)
    weights[at] = values
    return weights


def scorer(weights: np.ndarray):
    """A column function: text to its score."""
    at, values = _sparse(weights)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(_dense(at, values))
        for texts in parts:
            yield pd.Series([own.document(t) for t in texts], dtype="float64")

    return score


SPANS = "array<struct<start:int,end:int,score:double>>"


def judge(weights: np.ndarray, least: float = OFFENDING):
    """A column function: text to its score and its offending sentences, from one look at it."""
    at, values = _sparse(weights)

    @F.pandas_udf(f"score double, sentences {SPANS}")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scorer(_dense(at, values))
        for texts in parts:
            found = [own.both(t, least) for t in texts]
            yield pd.DataFrame({"score": [x for x, _ in found], "sentences": [x for _, x in found]})

    return judged


def locate(docs: DataFrame, weights: np.ndarray, least: float = OFFENDING) -> DataFrame:
    """doc_id and the spans (code points) of sentences that score least or more."""
    at, values = _sparse(weights)

    @F.pandas_udf(SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(_dense(at, values))
        for texts in parts:
            yield pd.Series([own.offending(t, least) for t in texts])

    return docs.select("doc_id", spans(F.col("text")).alias("sentences"))


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences (start and end in code points, and score of those that offend)."""
    judged = judge(fit(docs, labels, usable))
    found = docs.select("doc_id", held_out.alias("held_out"), judged(F.col("text")).alias("j"))
    return found.select("doc_id", "held_out", "j.score", (F.col("j.score") >= THRESHOLD).cast("int").alias("predicted"), "j.sentences")


def keep_clean(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """docs without those predicted toxic; same columns."""
    score = scorer(fit(docs, labels, usable))
    return docs.where(score(F.col("text")) < THRESHOLD)
