"""Leaders of clusters over arriving rows: a stored table that equals the batch's result at any time.

Rows are stored by buckets of their documents. A batch's documents are read back from their
buckets, the new rows added, leaders found again for those documents alone, and the touched buckets
replaced; so a row that comes late, before the leader that its cluster had, leads from then on. A batch
that is run again, after a failure, finds its rows stored and leaves the table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linkage
from ..sources.golden_store import read_golden, write_golden
from ..store import Tables

#: Folders of a stored table.
BUCKETS = 64


def merge(batch: DataFrame, path: str, order: str, buckets: int = BUCKETS, **how) -> None:
    """Adds a batch's rows to the table of rows with leaders under path; a row is told by its document and order value."""
    spark = batch.sparkSession
    tables, bucket = Tables(spark), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    new = tables.keep(batch.dropDuplicates(["doc_id", order]))
    touched = [r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
    if not touched:
        return
    try:
        held = tables.keep(read_golden(spark, path).filter(F.col("bucket").isin(touched)))
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = tables.keep(new.limit(0).withColumns({"leader": F.lit(None).cast("long"), "bucket": F.lit(None).cast("int")}))
    again = held.join(new.select("doc_id").distinct(), "doc_id", "left_semi").select(new.columns)
    rows = again.unionByName(new.join(again.select("doc_id", order), ["doc_id", order], "left_anti").select(new.columns))
    found = linkage.leader_clusters(rows, order, **how).withColumn("bucket", bucket)
    others = held.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    write_golden(others.select(found.columns).unionByName(found), path, "bucket")


def clustered(arriving: DataFrame, path: str, checkpoint: str, order: str = "idx", **how):
    """The started query that merges a stream's rows into the table under path."""
    return arriving.writeStream.foreachBatch(lambda batch, _: merge(batch, path, order, **how)).option("checkpointLocation", checkpoint).start()
