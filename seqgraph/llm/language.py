"""Language identification with interpolated Kneser-Ney character models.

One trigram model for each language. Distinct n-grams of all languages lie in
sorted arrays of 64-bit keys with one row of log probabilities beside each, so
a lookup is a binary search and one pass scores all languages. The language
with the lowest cross-entropy per character wins; a document whose best
cross-entropy lies far above what its length usually gives is rejected, by a
limit that is calibrated on documents that took no part in the counts.

Scale: the counts come from a bounded sample (PER_LANGUAGE documents of each
language, by hash of the id, and of their trigrams the PER_MODEL most frequent);
prediction is one narrow pass without a shuffle. Every language is learned. The model
that each task gets grows with their number and with nothing else; languages lie in blocks of LANGUAGES_TOGETHER, so a row of
probabilities never spans them all.

Edge cases: null text or text without a letter gives und with score 0 and is
rejected; a null lang or doc_id is never learned from; repeated rows are learned
from and predicted each; of languages with the same cross-entropy the first by
name is taken; a very long text is scored whole; with no document to learn from
every text is und; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, materialise

#: Documents of each language that the counts come from, about.
PER_LANGUAGE = 1_000
#: Trigrams of a language that its model keeps, the most frequent ones.
PER_MODEL = 500_000
#: Languages up to which their numbers of documents are sent to all tasks; beyond, texts are joined with them.
MOST_BROADCAST = 100_000
#: Languages whose probabilities lie side by side.
LANGUAGES_TOGETHER = 32
#: Of these, each so-manieth only calibrates the limit of rejection.
CALIBRATE = 5
#: Rejected above the mean cross-entropy plus so many standard deviations of a document of its length.
DEVIATIONS = 8.0
DISCOUNT = 0.75
CHUNK = 2_000_000
UND = "und"
SPACE = 32

_LETTER = np.zeros(0x110000, bool)
#: Bits of a symbol, enough for any code point; three fill 63 bits of a key.
_BITS = np.uint64(21)
_MASK, _PAIR = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return _LETTER


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, other runs as one space, each text led by two spaces;
    where each text starts; how many letters each has."""
    spaced = ["  " + t.lower() + " " for t in texts]
    sizes = np.array([len(t) for t in spaced])
    codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, SPACE)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first stays, as a space
    keep[start] = keep[start + 1] = True
    n_letters = np.add.reduceat(letter.astype(np.int64), start)
    firsts = np.cumsum(keep)[start] - 1
    return codes[keep], firsts, n_letters


def trigrams(codes: np.ndarray) -> np.ndarray:
    """63-bit keys of the trigrams that end at the third symbol and after."""
    c = codes.astype(np.uint64)
    return (c[:-2] << (_BITS + _BITS)) | (c[1:-1] << _BITS) | c[2:]


def _of_text(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys inside the texts, where each text's begin, and how many each has; two at least by construction."""
    ends = np.concatenate([firsts[1:], [len(codes)]])
    inside = np.ones(max(0, len(codes) - 2), bool)
    for cut in (firsts[1:] - 1, firsts[1:] - 2):  # these reach into the next text
        inside[cut] = False
    n = ends - firsts - 2
    return trigrams(codes)[inside], np.concatenate([[0], np.cumsum(n)[:-1]]), n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to lang, key, n."""
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for a, b in chunks(texts, CHUNK):
                codes, firsts, _ = symbols(texts[a:b])
                keys, n = np.unique(_of_text(codes, firsts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])


class Block:
    """Log probabilities of trigrams in some languages, with bigrams and single symbols for those unseen.

    uni: the symbols of all languages, so that each spreads its last probability over the same ones.
    """

    def __init__(self, seen: list[tuple[np.ndarray, np.ndarray]], uni: np.ndarray):
        self.uni = uni
        self.tri = np.unique(np.concatenate([k for k, _ in seen]))
        self.bi = np.unique(np.concatenate([self.tri & _PAIR, self.tri >> _BITS]))
        shape = len(seen)
        self.uni_p = np.zeros((len(self.uni) + 1, shape), np.float32)
        self.bi_p, self.bi_back = np.zeros((len(self.bi), shape), np.float32), np.ones((len(self.bi), shape), np.float32)
        self.uni_back = np.ones((len(self.uni) + 1, shape), np.float32)
        self.tri_p = np.zeros((len(self.tri), shape), np.float32)
        for j, (keys, n) in enumerate(seen):
            self._fit(j, keys, n.astype(float))
        self.uni_p, self.bi_p, self.tri_p = (np.log(x) for x in (self.uni_p, self.bi_p, self.tri_p))

    def _fit(self, j: int, keys: np.ndarray, n: np.ndarray) -> None:
        low = keys & _PAIR
        # Lower orders count in how many contexts an n-gram continues.
        bi, bi_n = np.unique(low, return_counts=True)
        uni, uni_n = np.unique(bi & _MASK, return_counts=True)
        size = len(self.uni) + 1  # one for all symbols never seen
        p = np.full(size, 1.0 / size) * (DISCOUNT * len(uni) / max(1, uni_n.sum()))
        p[np.searchsorted(self.uni, uni)] += (uni_n - DISCOUNT) / uni_n.sum()
        self.uni_p[:, j] = p
        # Bigrams: context is the first symbol.
        context, at = np.unique(bi >> _BITS, return_inverse=True)
        total, kinds = np.bincount(at, bi_n), np.bincount(at)
        known = np.isin(context, self.uni)
        self.uni_back[np.searchsorted(self.uni, context[known]), j] = (DISCOUNT * kinds / total)[known]
        second = np.searchsorted(self.uni, self.bi & _MASK)
        second = np.where(self.uni[np.minimum(second, len(self.uni) - 1)] == (self.bi & _MASK), second, len(self.uni))
        first = np.searchsorted(self.uni, self.bi >> _BITS)
        first = np.where(self.uni[np.minimum(first, len(self.uni) - 1)] == (self.bi >> _BITS), first, len(self.uni))
        p = self.uni_back[first, j] * self.uni_p[second, j]
        where = np.searchsorted(self.bi, bi)
        p[where] += (bi_n - DISCOUNT) / total[at]
        self.bi_p[:, j] = p
        # Trigrams: context is the first two symbols.
        context, at = np.unique(keys >> _BITS, return_inverse=True)
        total, kinds = np.bincount(at, n), np.bincount(at)
        self.bi_back[np.searchsorted(self.bi, context), j] = DISCOUNT * kinds / total
        p = self.bi_back[np.searchsorted(self.bi, self.tri >> _BITS), j] * self.bi_p[np.searchsorted(self.bi, self.tri & _PAIR), j]
        p[np.searchsorted(self.tri, keys)] += (n - DISCOUNT) / total[at]
        self.tri_p[:, j] = p

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def logp(self, keys: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.tri, keys)
        out = self.tri_p[at]
        if not hit.all():
            miss = keys[~hit]
            context, known = self._find(self.bi, miss >> _BITS)
            back = np.where(known[:, None], np.log(self.bi_back[context]), 0)
            low = miss & _PAIR
            pair, known = self._find(self.bi, low)
            one, seen = self._find(self.uni, low & _MASK)
            mid, found = self._find(self.uni, low >> _BITS)
            single = np.where(found[:, None], np.log(self.uni_back[mid]), 0) + self.uni_p[np.where(seen, one, len(self.uni))]
            out[~hit] = back + np.where(known[:, None], self.bi_p[pair], single)
        return out


class Model:
    """The models of all languages, and the limits of rejection."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        seen = [counts[x] for x in self.langs]
        self.uni = np.unique(np.concatenate([k & _MASK for k, _ in seen])) if seen else np.zeros(0, np.uint64)
        self.blocks = [Block(seen[a : a + LANGUAGES_TOGETHER], self.uni) for a in range(0, len(seen), LANGUAGES_TOGETHER)]
        self.limits: np.ndarray | None = None

    def logp(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([b.logp(keys) for b in self.blocks], axis=1)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol in each language, symbols and letters of each text."""
        codes, firsts, letters = symbols(texts)
        keys, start, n = _of_text(codes, firsts)
        full = n > 0
        sums = np.zeros((len(texts), len(self.langs)))
        if full.any():
            sums[full] = np.concatenate([np.add.reduceat(b.logp(keys).astype(np.float64), start[full]) for b in self.blocks], axis=1)
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        names, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return names, score, rejected
        for a, b in chunks(["" if t is None else t for t in texts], CHUNK):
            part = ["" if t is None else t for t in texts[a:b]]
            h, n, letters = self.entropies(part)
            best = h.argmin(axis=1)
            least = h[np.arange(len(part)), best]
            odds = np.exp(-(h - least[:, None]) * np.minimum(n, 200)[:, None])
            score[a:b] = np.where(letters > 0, 1 / odds.sum(axis=1), 0)
            limit = np.inf if self.limits is None else self.limits[0] + self.limits[1] / np.sqrt(np.maximum(n, 1))
            rejected[a:b] = (letters == 0) | (least > limit)
            for i, (k, some) in enumerate(zip(best, letters > 0, strict=True)):
                if some:
                    names[a + i] = self.langs[k]
        return names, score, rejected


def sample(docs: DataFrame, usable: Column) -> DataFrame:
    """lang, text and part (0 calibrates) of about PER_LANGUAGE documents of each language."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    # A row for each language, checked; the texts of a language, which may be most of all, then stay where they are.
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(sizes, "lang").where(place < F.lit(float(PER_LANGUAGE)) / F.col("n"))
    return chosen.select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)).alias("part"))


def fit(docs: DataFrame, usable: Column) -> Model:
    rows = sample(docs, usable)
    counted = rows.where("part <> 0").select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    first = W.partitionBy("lang").orderBy(F.desc("n"), "key")
    counted = counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PER_MODEL).drop("place").toPandas()
    counts = {str(lang): (k := g.sort_values("key"))[["key", "n"]].to_numpy().T for lang, g in counted.groupby("lang")}
    model = Model({lang: (x[0].astype(np.uint64), x[1]) for lang, x in counts.items()})
    if model.langs:
        model.limits = limits(model, rows.where("part = 0").select("text"))
    return model


def limits(model: Model, held: DataFrame) -> np.ndarray:
    """From all documents (text) outside the counts: the mean, the spread between documents and within one."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, CHUNK):
                h, n, letters = model.entropies(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(h.min(axis=1)[letters > 0]), pa.array(n[letters > 0].astype(np.int64))], names=["best", "n"])

    scored = materialise(held.mapInArrow(score, "best double, n long"), "language-held")
    mid = scored.agg(F.count(F.lit(1)).alias("rows"), F.percentile("best", F.lit(0.5)).alias("best"), F.percentile("n", F.lit(0.5)).alias("n")).first()
    if mid.rows < 2:
        return np.array([np.inf, 0.0])
    off = F.abs(F.col("best") - F.lit(mid.best))
    far = scored.agg(F.percentile(F.when(F.col("n") >= F.lit(mid.n), off), F.lit(0.5)).alias("spread"), F.percentile(off * F.sqrt("n"), F.lit(0.5)).alias("within")).first()
    return np.array([mid.best + DEVIATIONS * far.spread / 0.6745, DEVIATIONS * far.within / 0.6745])


def predictor(model: Model):
    """A column function: text to lang, score, rejected."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, score, rejected = model.predict(list(texts))
            yield pd.DataFrame({"lang": names, "score": score, "rejected": rejected})

    return predict


def identify(docs: DataFrame, usable: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    predict = predictor(fit(docs, usable))
    found = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_known(docs: DataFrame, usable: Column) -> DataFrame:
    """docs without those rejected; same columns."""
    predict = predictor(fit(docs, usable))
    return docs.where(~predict(F.col("text"))["rejected"])
