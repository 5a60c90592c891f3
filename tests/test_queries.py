"""Every registered query of the graph library against its SQL."""

import os

import pytest

from seqgraph.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SF
from .oracle import TABLES, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, sf, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name], sf) > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_likelihoods_have_a_row_for_each_part(spark, sf):
    rows = QUERIES["pair_likelihoods"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/part.parquet").count()
    assert rows.where("log10_likelihood > 0").count() == 0


def test_reachable_subgraph_has_arcs_at_any_depth(spark, monkeypatch):
    from seqgraph.plans import derived

    chain = [(i, 2 * i, 2 * i + 2) for i in range(6)] + [(6, 12, 0), (7, 20, 22)]
    monkeypatch.setattr(derived, "arcs", lambda spark, sf: spark.createDataFrame(chain, "link_id long, v long, w long"))
    assert sorted(r.link_id for r in QUERIES["reachable_subgraph"](spark, None).collect()) == [0, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("name", ["fastq_reads", "fastx_files"])
def test_short_texts_as_records(spark, tmp_path, name):
    """Texts of no base up to four, by all forms of records: a quality of the wrong length is wrong in each."""
    texts = [(i, "?" + "acgt"[: i // 420], "en", f"src{i % 3}", 0) for i in range(420 * 5)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for other in TABLES:
        if other != "documents":
            os.symlink(f"{SF}/{other}.parquet", f"{tmp_path}/{other}.parquet")
    assert same(spark, QUERIES[name], ORACLE_SQL[name], str(tmp_path)) == len(texts)
