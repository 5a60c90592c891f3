"""Toxicity, language and quality: held-out accuracy, and edge cases."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqgraph.llm import language, quality, toxicity
from seqgraph.llm.common import in_fold
from seqgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(name, spark):
    return QUERIES[name](spark, SF).where("held_out").toPandas()


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", in_fold(F.col("id"), 5, 0).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert spark.createDataFrame([(None,)], "id long").select(in_fold(F.col("id"), 5, 0)).first()[0] is False


def test_toxicity_on_held_out_rows(spark):
    found = held("op10_toxicity", spark).merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    clean, toxic = found[found.toxic == 0], found[found.toxic == 1]
    assert clean.predicted.mean() < 0.02 and toxic.predicted.mean() > 0.7
    assert found.score.between(0, 1).all()


def test_quality_on_held_out_rows(spark):
    found = held("op6_quality_classifier", spark).merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (found.predicted == found.quality).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_on_held_out_rows(spark):
    found = held("op7_language_id", spark).merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.lang_pred == found.lang).mean() > 0.98


EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, "1234 !!", "en", None), (None, "the cat", "en", "b"), (4, "x" * 300_000, "en", "b"), (4, "x" * 300_000, "en", "b"), (5, "le chat. idiot!", None, "c")]
COLUMNS = "doc_id long, text string, lang string, source string"


def edge_docs(spark):
    """With columns whose names clash with results."""
    return spark.createDataFrame(EDGES, COLUMNS).withColumns({"score": F.lit("x"), "predicted": F.lit("x"), "held_out": F.lit("x"), "rejected": F.lit("x"), "p": F.lit(1)})


LABELS = [(5, 0, 1), (2, 1, 0), (None, 1, 1), (4, None, None), (9, 1, 0)]


@pytest.mark.parametrize("labels", [LABELS, []])
def test_edge_cases(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    for found in (toxicity.toxicity(docs, marks, F.lit(True), F.lit(False)), quality.quality(docs, marks, F.lit(True), F.lit(False))):
        rows = found.toPandas()
        assert len(rows) == len(EDGES) and rows.score.between(0, 1).all()
    rows = language.identify(docs, F.lit(True), F.lit(False)).toPandas()
    by = dict(zip(rows.doc_id.fillna(-1), rows.lang_pred, strict=True))
    assert (by[1], by[2], by[3]) == ("und", "und", "und") and by[-1] == "en" and len(rows) == len(EDGES)
    assert toxicity.keep_clean(docs, marks, F.lit(True)).columns == docs.columns == language.keep_known(docs, F.lit(True)).columns


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], COLUMNS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, marks, F.lit(True), F.lit(False)).count() == quality.quality(docs, marks, F.lit(True), F.lit(False)).count() == language.identify(docs, F.lit(True), F.lit(False)).count() == 0


def test_noisy_or_finds_the_sentence():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts, marks = [], []
    for i in range(120):
        own = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if i % 2:
            own[rng.integers(5)] += " scoundrel"
        texts.append(". ".join(own))
        marks.append(i % 2)
    bags = [[sorted({k for w in s.split() for k in toxicity.features(w)}) for s in t.split(". ")] for t in texts]
    weights = toxicity.fit_bags(marks, [[len(b) for b in own] for own in bags], [[k for b in own for k in b] for own in bags])
    scorer = toxicity.Scorer(weights)
    assert all((scorer.document(t) >= 0.7) == bool(m) for t, m in zip(texts, marks, strict=True))
    text = "w1 w2. w3 scoundrel w4. w5."
    (span,) = scorer.offending(text)
    assert "scoundrel" in text[span["start"] : span["end"]] and "w5" not in text[span["start"] : span["end"]]
    assert scorer.document(None) == scorer.document("") == 0.0


def test_the_query_tells_offending_sentences(spark, sf):
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert any(r.sentences for r in rows)
    for r in rows:
        assert all(0 <= x.start < x.end <= len(texts[r.doc_id]) and x.score >= toxicity.OFFENDING for x in r.sentences)
        assert not r.sentences or r.score >= toxicity.OFFENDING  # noisy-or is at least its largest


def test_letters_beyond_the_first_plane_are_told_apart():
    """U+10400 and U+20400 agree in their last 16 bits, and with U+0400."""
    a, b, c = (language.trigrams(np.array([x, x, x], np.uint32))[0] for x in (0x10400, 0x20400, 0x0400))
    assert len({int(a), int(b), int(c)}) == 3
    counts = {}
    for name, letters in (("one", "\U00010428\U00010429\U0001042a"), ("two", "\U00020428\U00020429\U0002042a")):
        codes, firsts, _ = language.symbols([letters * 20])
        counts[name] = np.unique(language._of_text(codes, firsts)[0], return_counts=True)
    assert language.Model(counts).predict(["\U00010429\U0001042a\U00010428", "\U00020429\U0002042a\U00020428"])[0] == ["one", "two"]


def test_located_sentences(spark):
    weights = np.zeros(toxicity.DIM + 1)
    weights[toxicity.DIM] = -5
    weights[list(toxicity.features("vile"))] = 10
    rows = toxicity.locate(spark.createDataFrame([(1, "Fine. So vile! Fine."), (2, None)], "doc_id long, text string"), weights).collect()
    assert [len(r.sentences) for r in rows] == [1, 0]


def test_language_model_is_a_distribution():
    texts = {"a": ["abab ba", "aab"], "b": ["cdcd dc", "ccd"]}
    counts = {}
    for k, some in texts.items():
        codes, firsts, _ = language.symbols(some)
        counts[k] = tuple(np.unique(language._of_text(codes, firsts)[0], return_counts=True))
    model = language.Model(counts)
    # After a seen context, the probabilities of all symbols (and of one for the unseen) sum to 1.
    context = [ord("a"), ord("b")]
    keys = np.concatenate([language.trigrams(np.array([*context, int(c)], np.uint32)) for c in [*model.uni, 0x7A]])
    assert np.exp(model.logp(keys))[:, 0].sum() == pytest.approx(1, abs=1e-4)
    assert model.predict(["abba", "dcdc", "", None, "42"])[0] == ["a", "b", "und", "und", "und"]


def test_symbols_collapse_other_runs():
    codes, firsts, letters = language.symbols(["Ab, -c", "", "1"])
    parts = np.split(codes, firsts[1:])
    assert ["".join(map(chr, p)) for p in parts][0].rstrip() == "  ab c" and letters.tolist() == [3, 0, 0]


def test_pairs_rank_the_better_feature_up():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (50, 2)), rng.normal(0, 1, (50, 2))
    assert (quality.fit_pairs(good, bad) > 0).all()
    assert pd.Series(quality.fit_pairs(good, good)).abs().max() < 0.5


def test_rejection_is_calibrated_on_every_language(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):  # by language, each of a larger alphabet
        letters = [chr(0x430 * (k % 2) + 97 * (1 - k % 2) + i) for i in range(4 + 6 * k)]
        rows += [(1_000 * k + i, f"l{k}", " ".join("".join(rng.choice(letters, 4)) for _ in range(rng.integers(3, 12)))) for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(docs, F.lit(True))
    held = [r.text for r in language.sample(docs, F.lit(True)).where("part = 0").collect()]
    assert len(held) > 600
    h, n, _ = model.entropies(held)
    off = np.abs(h.min(axis=1) - np.median(h.min(axis=1)))
    spread, within = np.median(off[n >= np.median(n)]), np.median(off * np.sqrt(n))
    assert model.limits == pytest.approx([np.median(h.min(axis=1)) + language.DEVIATIONS * spread / 0.6745, language.DEVIATIONS * within / 0.6745])


# References by definition


def test_kneser_ney_by_definition():
    rng = np.random.default_rng(2)
    texts = {x: ["".join(rng.choice(list(letters), 40)) for _ in range(6)] for x, letters in (("a", "abc  "), ("b", "bcde "), ("c", "xyz "))}
    grams = {}
    for x, some in texts.items():
        for t in some:
            codes, _, _ = language.symbols([t])
            grams.setdefault(x, []).extend(tuple(codes[i : i + 3].tolist()) for i in range(len(codes) - 2))
    symbols = {g[2] for own in grams.values() for g in own}
    d = language.DISCOUNT

    def probability(own, gram):
        a, b, c = gram
        tri = {g: own.count(g) for g in set(own)}
        bi = {p: len({g for g in tri if g[1:] == p}) for p in {g[1:] for g in tri}}  # in how many contexts
        uni = {s: len({p for p in bi if p[1] == s}) for s in {p[1] for p in bi}}
        p = max(0, uni.get(c, 0) - d) / sum(uni.values()) + d * len(uni) / sum(uni.values()) / (len(symbols) + 1)
        after = {q: n for q, n in bi.items() if q[0] == b}
        if after:
            p = max(0, bi.get((b, c), 0) - d) / sum(after.values()) * ((b, c) in bi) + d * len(after) / sum(after.values()) * p
        after = {g: n for g, n in tri.items() if g[:2] == (a, b)}
        if after:
            p = max(0, tri.get(gram, 0) - d) / sum(after.values()) * (gram in tri) + d * len(after) / sum(after.values()) * p
        return p

    def counted(some):
        codes, firsts, _ = language.symbols(some)
        return tuple(np.unique(language._of_text(codes, firsts)[0], return_counts=True))

    model = language.Model({x: counted(some) for x, some in texts.items()})
    tried = sorted({g for own in grams.values() for g in own} | {(97, 98, 113), (120, 97, 98), (113, 113, 113), (32, 32, 97)})
    found = model.logp(np.array([(a << 32) | (b << 16) | c for a, b, c in tried], np.uint64))
    expected = np.log([[probability(grams[x], g) for x in sorted(texts)] for g in tried])
    assert found == pytest.approx(expected, abs=1e-4)
    text = "abcb xyz"
    codes, _, _ = language.symbols([text])
    h, n, _ = model.entropies([text])
    assert h[0] == pytest.approx([-np.mean([np.log(probability(grams[x], tuple(codes[i : i + 3].tolist()))) for i in range(len(codes) - 2)]) for x in sorted(texts)], abs=1e-4)


def test_languages_in_blocks_score_alike(monkeypatch):
    rng = np.random.default_rng(4)
    texts = {f"l{k}": ["".join(rng.choice(list("abcdefgh"[k % 4 : k % 4 + 4] + " "), 60)) for _ in range(4)] for k in range(5)}

    def counted(some):
        codes, firsts, _ = language.symbols(some)
        return tuple(np.unique(language._of_text(codes, firsts)[0], return_counts=True))

    counts = {x: counted(some) for x, some in texts.items()}
    tried = ["abc dead", "hgf fed", "zzz", "bade cafe"]
    whole = language.Model(counts).entropies(tried)[0]
    monkeypatch.setattr(language, "LANGUAGES_TOGETHER", 2)
    assert language.Model(counts).entropies(tried)[0] == pytest.approx(whole, abs=1e-4)


def test_foreign_text_is_rejected_and_known_text_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usable = F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)
    foreign = ["Это предложение написано на русском языке и не похоже ни на один из известных языков. " * 4, "これは日本語の文章です。機械は知らないはずです。" * 5, "xqzj vkwq zzxk qqjw xzvk jjqx wvkz kqxz " * 8, "qwx" * 200]
    rows = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    held = docs.where(in_fold(F.col("doc_id"), 4, 2)).where(F.length("text") > 40)
    kept = language.keep_known(docs.unionByName(rows), usable)
    assert kept.where("doc_id >= 1000000000").count() == 0
    assert kept.join(held.select("doc_id"), "doc_id", "left_semi").count() >= 0.995 * held.count()


def test_noisy_or_by_definition(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    usable = ~in_fold(F.col("doc_id"), 3, 1)
    weights = toxicity.fit(docs, labels, usable).astype(np.float32)
    found = {r.doc_id: r.score for r in QUERIES["op10_toxicity"](spark, sf).collect()}

    def score(text):
        clean = 1.0
        for sentence in toxicity.SENTENCE.findall(text or ""):
            words = set(toxicity.WORD.findall(sentence.lower()))
            if words:
                logit = sum(float(weights[i]) for w in words for i in set(toxicity.features(w))) + float(weights[toxicity.DIM])
                clean *= 1 - 1 / (1 + np.exp(-min(30, max(-30, logit))))
        return 1 - clean

    rows = docs.collect()
    assert [found[r.doc_id] for r in rows] == pytest.approx([score(r.text) for r in rows], abs=1e-6)


def test_bradley_terry_by_definition(spark, sf):
    regex = pytest.importorskip("regex")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    usable = ~in_fold(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, usable)
    found = {r.doc_id: r.score for r in QUERIES["op6_quality_classifier"](spark, sf).collect()}

    def features(text):
        n = lambda pattern: len(regex.findall(pattern, text))
        root = lambda x: min(x, 1) ** 0.5
        words, chars = n(r"\S+") + 1, len(text) + 1
        return [
            root(n(r"[#*$%&<>^~_=]{2,}") / words), root(n(r"(?<!\S)\|(?!\S)") / words), root(n(r"!{2,}") / words), root(n(r"\p{Lu}") / chars), root(n(r"(?<!\S)(?:(\S++)(?=\s++\1(?!\S)))") / words),
            root(n(r"[0-9]") / chars), root(n(r"[.!?]+(?=\s|$)") / words), min(np.log1p(words) / 10, 1), min(chars / words / 20, 1), root(n(r"[^\p{L}\p{N}\s]") / chars),
        ]

    def score(text):
        x = sum(w * f for w, f in zip(model.weights, features(text or ""), strict=True))
        return 1 / (1 + np.exp(-(quality.SLOPE * (x - model.threshold) + np.log(quality.THRESHOLD / (1 - quality.THRESHOLD)))))

    rows = docs.collect()
    assert [found[r.doc_id] for r in rows] == pytest.approx([score(r.text) for r in rows], abs=1e-6)
    # And the fit: the seeded pairs' log loss, its gradient one pair at a time.
    rng = np.random.default_rng(11)
    good, bad = rng.normal(0.5, 1, (6, 2)), rng.normal(0, 1, (5, 2))
    w = quality.fit_pairs(good, bad)
    rng = np.random.default_rng(7)
    pairs = list(zip(rng.integers(len(good), size=quality.PAIRS).tolist(), rng.integers(len(bad), size=quality.PAIRS).tolist(), strict=True))
    slope = np.zeros(2)
    for (i, j), times in Counter(pairs).items():
        diff = good[i] - bad[j]
        slope += times * diff / (1 + np.exp(diff @ w))
    assert slope / len(pairs) - quality.L2 * w == pytest.approx([0, 0], abs=1e-4)


def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_CLASS", 3)  # where the fit starts
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(["word", "Other", "x!!", "12", "##", "end."], 12, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1] if i % 2 else [0.3, 0.2, 0.1, 0.1, 0.2, 0.1]))) for i in range(120)]
    docs = spark.createDataFrame([*texts, (500, "words " * 200_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(500, 1)], "doc_id long, quality int")
    rows = docs.select("doc_id", F.array(*quality.features(F.col("text"))).alias("x")).collect()
    x, y = np.array([r.x for r in rows]), np.array([1 if r.doc_id == 500 else r.doc_id % 2 for r in rows])
    model = quality.fit(docs, marks, F.lit(True))
    w = np.array(model.weights)
    diff = (x[y == 1][:, None, :] - x[y == 0][None, :, :]).reshape(-1, len(w))
    slope = -(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + quality.L2 * w
    assert np.abs(slope).max() < 1e-5  # of the loss over all pairs
    share = (y == 0).mean()
    assert model.threshold == pytest.approx(np.quantile(x @ w, [share - 0.01, share + 0.01]).mean(), abs=1e-9)


def test_contradicting_labels_and_repeated_ids(spark):
    rows = [(1, "fine words here"), (1, "other words here"), (2, "bad words here"), (3, "x" * 1_000_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    bad = quality.sample(docs, marks, F.lit(True)).collect()
    toxic = toxicity.sample(docs, marks, F.lit(True)).collect()
    assert [r.quality for r in bad] == [0, 0] and sorted(r.toxic for r in toxic) == [1, 1]
    assert len({r.text for r in toxic} & {"fine words here", "other words here"}) == 1
