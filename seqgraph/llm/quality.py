"""Quality by Bradley-Terry pairwise ranking.

The chance that one document is preferred to another is the logistic function
of the difference of their scores, and a score is linear in a few features of
the text. Weights are learned by logistic loss on the feature differences of
all preference pairs (a document marked good and one marked bad). A quantile of
all their scores, at the share of bad documents among the labels, is the threshold;
it maps to THRESHOLD on the scale from 0 to 1.

Scale: features are column expressions, one narrow pass over whole texts, written
once; the fit and the scores read them. A step of the fit is one aggregation over all
labelled ids, one text of each: a pair's chance depends on the two scores only, so
rows are summed by class and score in BINS steps, each at its rows' mean score (which
leaves an error of the order of the square of a step), and the driver pairs these
sums. Newton steps end where the convex loss is least. A bounded sample says
where they start, and changes nothing in where they end.

Edge cases: null counts as empty text; a null doc_id is scored but never
learned from; a doc_id with contradicting labels counts as bad; of several texts
with one labelled id the one with the smallest hash is learned from; repeated
rows are scored each, rows with the same score are predicted alike; without
labelled documents of both classes every score is 0.5; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, materialise

#: Labelled ids of each class that the fit is started from, at most, and characters of a text among them.
PER_CLASS, LONGEST = 2_000, 1_000_000
#: Steps of scores that rows are summed by, of each class.
BINS = 4_096
#: The fit ends when a round can lessen the loss by so little only, above what the steps of scores leave, or after so many.
LOSS_LEFT, ROUNDS = 1e-10, 30
PAIRS = 40_000
STEPS, RATE, L2 = 300, 1.0, 1e-4
THRESHOLD = 0.3
#: The scale's steepness: a score this many units above the threshold has odds of e to the power SLOPE times that.
SLOPE = 2.0


def features(text: Column) -> list[Column]:
    """Shares by word and by character, each from 0 to about 1."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    words, chars = count(r"\S++") + 1, F.length(t) + F.lit(1.0)
    root = lambda c: F.sqrt(F.least(c, F.lit(1.0)))  # noqa: E731  # spreads small shares
    return [
        root(count(r"[#*$%&<>^~_=]{2,}") / words),
        root(count(r"(?<!\S)\|(?!\S)") / words),
        root(count(r"!{2,}") / words),
        root(count(r"\p{Lu}") / chars),
        root(count(r"(?<!\S)(\S++)(?=\s++\1(?!\S))") / words),
        root(count(r"\d") / chars),
        root(count(r"[.!?]+(?=\s|$)") / words),
        F.least(F.log1p(words) / 10, F.lit(1.0)),
        F.least(chars / words / 20, F.lit(1.0)),
        root(count(r"[^\p{L}\p{N}\s]") / chars),
    ]


def weighted(own: list[Column], weights: list[float]) -> Column:
    return sum((f * float(w) for f, w in zip(own, weights, strict=True)), F.lit(0.0))


@dataclass
class Model:
    weights: list[float]
    threshold: float

    def score(self, text: Column) -> Column:
        """From 0 to 1; the threshold maps to THRESHOLD."""
        return self.score_of(features(text))

    def score_of(self, own: list[Column]) -> Column:
        """The same of a text's features."""
        raw = weighted(own, self.weights)
        return 1 / (1 + F.exp(-(F.lit(SLOPE) * (raw - F.lit(self.threshold)) + F.lit(float(np.log(THRESHOLD / (1 - THRESHOLD)))))))


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """quality and x (features) of a bounded sample of labelled rows."""
    marks = labels.where(usable).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return labelled(docs, marks, "quality", PER_CLASS, LONGEST).select("quality", F.array(*features(F.col("text"))).alias("x"))


def fit_pairs(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights by gradient descent on the log loss of preferring good to bad, over seeded pairs."""
    rng = np.random.default_rng(7)
    diff = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
    w = np.zeros(diff.shape[1])
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(diff @ w))
        speed = 0.9 * speed + (diff.T @ p / len(diff) - L2 * w)
        w += RATE * speed
    return w


def featured(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, x (features), hash of every row; written."""
    held = F.lit(False) if held_out is None else held_out
    return materialise(docs.select("doc_id", held.alias("held_out"), F.array(*features(F.col("text"))).alias("x"), F.xxhash64("text").alias("hash")), "quality-features")


def learned(rows: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """quality, x of all labelled ids, of featured rows; written."""
    marks = labels.where(usable).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where("quality is not null")
    one = rows.join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min_by("x", F.struct("hash", "x")).alias("x"))
    return materialise(one.select("quality", "x"), "quality-learned")


def _binned(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """rows with score and bin by these weights; features are from 0 to 1."""
    width = max(float(np.abs(w).sum()), 1e-9) / BINS
    scored = rows.withColumn("score", weighted([F.col("x")[i] for i in range(len(w))], w.tolist()))
    return scored.withColumn("bin", F.floor(F.col("score") / width))


def _sums(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """By class and bin: class, bin, rows, sums of x, sums of x times x."""
    n = len(w)
    x = [F.col("x")[i] for i in range(n)]
    twice = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)]
    found = _binned(rows, w).groupBy("quality", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *twice)
    # Of proven size: two classes of BINS rows each.
    table = np.array([tuple(r) for r in found.orderBy("quality", "bin").collect()], float)
    square = np.zeros((len(table), n, n))
    for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n)):
        square[:, i, j] = square[:, j, i] = table[:, 3 + n + k]
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3 : 3 + n], square


def slopes(sums: tuple[np.ndarray, ...], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of all pairs with its penalty, its gradient and its second derivatives."""
    y, _, n, x, xx = sums
    good, bad = y == 1, y == 0
    pairs = n[good].sum() * n[bad].sum()
    mean = x / n[:, None]
    far = (mean[good] @ w)[:, None] - (mean[bad] @ w)[None, :]
    p = 1 / (1 + np.exp(np.clip(far, -700, 700)))
    each = n[good][:, None] * n[bad][None, :]
    loss = (each * np.logaddexp(0, -far)).sum() / pairs + L2 / 2 * w @ w
    pulled = (p * n[bad]).sum(1), (p * n[good][:, None]).sum(0)
    slope = -(pulled[0] @ x[good] - pulled[1] @ x[bad]) / pairs + L2 * w
    k = p * (1 - p)
    cross = x[good].T @ k @ x[bad]
    curve = np.einsum("i,ijk->jk", (k * n[bad]).sum(1), xx[good]) + np.einsum("i,ijk->jk", (k * n[good][:, None]).sum(0), xx[bad]) - cross - cross.T
    return loss, slope, curve / pairs + L2 * np.eye(len(w))


def fit_all(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Weights at which the loss over all pairs of learned rows is least, from w on, and the sums there."""
    sums = _sums(rows, w)
    loss, slope, curve = slopes(sums, w)
    for _ in range(ROUNDS):
        step, share = np.linalg.solve(curve, slope), 1.0
        if slope @ step / 2 < LOSS_LEFT:
            break
        while share > 1e-3:
            tried = w - share * step
            tried_sums = _sums(rows, tried)
            found = slopes(tried_sums, tried)
            if found[0] <= loss:
                break
            share /= 2
        else:
            break  # no shorter step lessens the loss: what is left of the slope is rounding
        w, sums, (loss, slope, curve) = tried, tried_sums, found
    return w, sums


def quantiles(rows: DataFrame, w: np.ndarray, sums: tuple[np.ndarray, ...], shares: list[float]) -> list[float]:
    """The scores' quantiles as numpy has them, over all learned rows: bins say where they lie, and only those are read."""
    bins, at = np.unique(sums[1], return_inverse=True)
    ends = np.cumsum(np.bincount(at, sums[2]))
    places = [s * (ends[-1] - 1) for s in shares]
    ranks = {int(r) for p in places for r in (np.floor(p), np.ceil(p))}
    holds = {r: int(np.searchsorted(ends, r, "right")) for r in ranks}
    asked = _binned(rows, w).where(F.col("bin").isin([int(bins[b]) for b in set(holds.values())]))
    counted = asked.groupBy("bin", "score").agg(F.count(F.lit(1)).alias("n")).orderBy("score").collect()
    value = {}
    for r, b in holds.items():
        own = [c for c in counted if c["bin"] == int(bins[b])]
        value[r] = own[int(np.searchsorted(np.cumsum([c["n"] for c in own]), r - (ends[b - 1] if b else 0), "right"))]["score"]
    return [value[int(np.floor(p))] + (p - np.floor(p)) * (value[int(np.ceil(p))] - value[int(np.floor(p))]) for p in places]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: DataFrame | None = None) -> Model:
    """rows: featured(docs), where they are there already."""
    first = sorted(sample(docs, labels, usable).collect())  # the same pairs however Spark deals the rows
    x, y = np.array([r.x for r in first], float), np.array([r.quality for r in first])
    n = len(features(F.lit("")))
    own = learned(featured(docs) if rows is None else rows, labels, usable)
    counts = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model([0.0] * n, float(np.log(THRESHOLD / (1 - THRESHOLD)) / SLOPE))
    start = fit_pairs(x[y == 1], x[y == 0]) if 0 < y.sum() < len(y) else np.zeros(n)
    w, sums = fit_all(own, start)
    # The threshold lies midway between the neighbouring scores at the share of bad ones.
    share = counts[0] / (counts[0] + counts[1])
    low, high = quantiles(own, w, sums, [max(0, share - 0.01), min(1, share + 0.01)])
    return Model(w.tolist(), float((low + high) / 2))


def quality(docs: DataFrame, labels: DataFrame, usable: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = featured(docs, held_out)
    model = fit(docs, labels, usable, rows)
    scored = rows.select("doc_id", "held_out", model.score_of([F.col("x")[i] for i in range(len(model.weights))]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
