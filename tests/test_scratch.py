from types import SimpleNamespace

import pytest

from textloom.plans import scratch


def test_named_folder(spark):
    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch.settle(spark.range(3), "x").count() == 3


def test_own_folder_only_where_unset():
    told = []
    context = SimpleNamespace(applicationId="app", master="local[2]", setCheckpointDir=told.append)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=context)
    assert scratch.shared_dir(session) == scratch.shared_dir(session) == told[0]
    assert len(told) == 1 and told[0].startswith("file:///")
    context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session)


def test_small_tables_are_dealt(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    small = scratch.read_dealt(spark, path)
    assert small.count() == 100 and small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(scratch, "SMALL_BYTES", 1)
    assert "Exchange" not in scratch.read_dealt(spark, path)._jdf.queryExecution().toString()
