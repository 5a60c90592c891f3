"""Where intermediates go, and when they go away."""

import os
from types import SimpleNamespace

import pytest

from seqgraph.sources import storage


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session(master))
    assert storage.shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"


def test_one_process_may_use_its_own_folder():
    assert storage.shared_dir(session("local[4]")) == storage.shared_dir(session("local[4]"))


def folder(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file://")


def test_intermediates_are_replaced_and_deleted(spark):
    before = spark.conf.getAll
    one = storage.materialise(spark.range(5), "one")
    two = storage.materialise(one.where("id > 1"), "two", one)
    assert not [d for d in os.listdir(os.path.dirname(folder(two))) if d.startswith("one-")]
    assert two.count() == 3 and os.path.exists(folder(two))
    with storage.scratch(spark):
        inner = storage.materialise(two, "inner")
        kept = storage.materialise(inner, "kept", outside=True)
        assert "/scratch-" in folder(inner)
        gone = folder(inner)
    assert not os.path.exists(gone) and kept.count() == 3
    gone = folder(kept)
    storage.discard(kept)
    assert not os.path.exists(gone)
    assert spark.conf.getAll == before
