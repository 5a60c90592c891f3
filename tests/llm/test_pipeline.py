"""The pipeline, stage by stage, against its operators and brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from seqgraph.llm import packing

from .test_jaccard import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, own, sf)
        assert kept.columns == docs.columns, name
        own = kept.cache()
    assert 0.8 * len(texts) < own.count() <= len(texts)
    before = {r.doc_id: r.text for r in own.collect()}
    own = corpus_pipeline.drop_copies(spark, own, sf).cache()
    largest = {}
    for d, t in before.items():
        largest[t] = max(d, largest.get(t, d))
    assert sorted(r.doc_id for r in own.collect()) == sorted(largest.values())
    left = [(r.doc_id, r.text) for r in own.collect()]
    own = corpus_pipeline.drop_near_copies(spark, own, sf).cache()
    assert sorted(r.doc_id for r in own.collect()) == sorted(d for d, _, c in brute(left) if d == c)
    packed = corpus_pipeline.pack(spark, own, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in own.collect()} and max(r.offset + r.length for r in packed) <= packing.SEQUENCE


def test_stages_take_edge_cases(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the of and the of and", "en", "a", 5), (3, "word " * 5000, "en", "a", 9), (3, "word " * 5000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            assert stage(spark, given, sf).columns == docs.columns, name
            stage(spark, given, sf).count()
    assert corpus_pipeline.drop_copies(spark, docs, sf).count() == 3


@pytest.fixture
def tables(spark, sf, tmp_path):
    """A folder of tables with given documents, and the given labels."""

    def put(docs):
        docs.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
        return f"file://{tmp_path}"

    return put


def test_the_whole_run_on_edge_cases(spark, sf, tables):
    """Learned from the given documents; beside them nulls, empty, long, repeated and equal texts, and clashing columns."""
    given = spark.read.parquet(f"{sf}/documents.parquet")
    text = given.where("length(text) between 2000 and 4000 and lang is not null").orderBy("doc_id").first().text
    words = text.split()
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", None, "a", 0), (10**6 + 2, text, "en", "a", 1), (10**6 + 2, text, "en", "a", 1), (10**6 + 3, text, "en", "b", 1), (None, text + " End", "en", "a", 1), (None, None, None, None, None), (10**6 + 4, " ".join([*words[:-1], "changed"]), "en", "a", 1), (10**6 + 5, (text + "\\n") * 30, "en", "a", 1)]
    clash = {c: F.lit("x") for c in ("ids", "piece", "start", "sig", "row", "key", "digest", "toxic", "score", "p", "n", "sequence_id")}
    both = given.unionByName(spark.createDataFrame(odd, given.schema))
    packed = corpus_pipeline.run(spark, tables(both.withColumns(clash).repartition(3))).collect()
    kept = {r.doc_id for r in packed}
    # Toxic and foreign documents aside, one of each group of near copies stays; empty texts are in no language.
    plain = {r.doc_id for r in corpus_pipeline.run(spark, tables(given)).collect()}
    assert len(plain) > 100 and not kept & {10**6, 10**6 + 1}
    # What stays now and didn't before is the long text, or a near copy of the text, whose own row gave way to a copy.
    shingles = lambda t: {tuple(w[i : i + 4]) for w in [t.lower().split()] for i in range(len(w) - 3)}
    texts = {r.doc_id: r.text for r in both.collect()}
    for d in kept - plain - {10**6 + 5}:
        a, b = shingles(text), shingles(texts[d])
        assert len(a & b) >= 0.85 * len(a | b)
    at = {}
    for r in packed:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.SEQUENCE


def test_the_whole_run_without_rows(spark, sf, tables):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, tables(given.limit(0))).collect() == []
