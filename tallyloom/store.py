"""Tables in the folder that all executors share: they cut lineage, and a lost executor costs one of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without one gets a temporary folder; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Tables:
    """The tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back."""
        path, self.count = f"{self.path}/{self.count}", self.count + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
