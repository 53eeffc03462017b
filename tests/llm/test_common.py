from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common


def test_scratch_folders_of_finished_work_go(spark):
    with common.cleaned(spark):
        inner = common.scratch(spark)
        assert common.stored(spark.range(3), f"{inner}/t").count() == 3
        assert Path(inner.removeprefix("file://")).exists()
    assert not Path(inner.removeprefix("file://")).exists()
    outer = common.scratch(spark)
    common.stored(spark.range(3), f"{outer}/t")
    assert Path(outer.removeprefix("file://")).exists()
    common.drop_path(spark, outer)


def test_writes_at_once_leave_the_setting_as_it_was(spark):
    before, path = spark.conf.get(common.CLEANUP, None), common.scratch(spark)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: common.stored(spark.range(50).groupBy((F.col("id") % 3).alias("k")).count(), f"{path}/{i}").count(), range(6)))
    assert spark.conf.get(common.CLEANUP, None) == before
    common.drop_path(spark, path)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
