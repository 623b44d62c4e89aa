"""The shared folder: where it is, and what goes."""

import os

import pytest

from cairn import tables


def test_scratch(spark):
    keep = tables.shared_dir(spark)
    with tables.scratch(spark, keep=[keep]):
        tables.written(spark.range(3), keep)
        gone = tables.shared_dir(spark)
        tables.written(spark.range(5), gone)
        assert os.path.isdir(gone.removeprefix("file://"))
    assert spark.read.parquet(keep).count() == 3 and not os.path.exists(gone.removeprefix("file://"))
    tables.dropped(spark, [keep, keep])
    assert not os.path.exists(keep.removeprefix("file://"))


class Elsewhere:
    """A session on a cluster, as far as shared_dir() looks."""

    def __init__(self, master, base=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = {} if base is None else {"spark.checkpoint.dir": base}


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"])
def test_a_cluster_names_its_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Elsewhere(master))
    assert tables.shared_dir(Elsewhere(master, "hdfs:///x/")).startswith("hdfs:///x/cairn-")
