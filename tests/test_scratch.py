"""Scratch tables lie in the shared folder, or nowhere."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quire.operators import scratch


def _session(master):
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(_session("spark://somewhere:7077"))
    assert scratch.shared_dir(_session("local[2]"))


def test_written_tables_are_read_back_and_dropped(spark):
    before = spark.conf.get(scratch._CLEANUP)
    table = scratch.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert sorted(r["count"] for r in table.collect()) == [14] * 5 + [15] * 2
    assert spark.conf.get(scratch._CLEANUP) == before and table.inputFiles()[0].split("/")[-2].startswith("quire-test-")
    scratch.drop_written(table)
    with pytest.raises(Exception):  # noqa: B017
        table.count()
