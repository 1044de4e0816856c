import os

import pytest

from quarterdeck.session import pin, scratch_path, shared_folder, unpin


class _Session:
    """The settings of a session, and nothing else."""

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_the_named_folder_is_used(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert shared_folder(_Session(spark_checkpoint_dir="hdfs://name/dir/")) == "hdfs://name/dir"


def test_only_a_local_session_has_a_folder_of_its_own():
    local = _Session(spark_master="local[2]", spark_app_id="a")
    assert os.path.isdir(shared_folder(local)) and shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError):
        shared_folder(_Session(spark_master="yarn"))


def test_pinned_rows_come_back_with_a_known_size(spark):
    df = pin(spark.range(10).selectExpr("id", "id * 2 as x"))
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(10)]
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_files_belong_to_the_application(spark):
    assert f"/quarterdeck/{spark.conf.get('spark.app.id')}/" in scratch_path(spark, "x")


def test_unpinned_files_are_gone(spark):
    kept, gone = pin(spark.range(3)), pin(spark.range(3))
    path = gone.inputFiles()[0].removeprefix("file://")
    unpin(gone, spark.range(1))
    assert not os.path.exists(path) and kept.count() == 3
