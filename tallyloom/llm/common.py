"""Shared pieces: shared-storage scratch tables, whitespace words, worker shipping."""

from __future__ import annotations

import sys
import threading
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word definition `[^\x20\x09-\x0D]+`, besides the space.
BLANKS = "\t\n\x0b\x0c\r"


def by_value(module_name: str) -> None:
    """Ship the functions of a module inside the job, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session without one gets a temporary folder; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder for one operator call's tables, under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def cleaned(spark: SparkSession):
    """Deletes the scratch folders that are made inside when it ends: for work whose result is stored by then."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for path in made:
            drop_path(spark, path)


#: Writes of this process that want their shuffle files deleted, and the setting from before the first.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES: dict = {"lock": threading.Lock(), "count": 0, "before": None}


@contextmanager
def _shuffles_go(spark: SparkSession):
    """The setting that deletes a query's shuffle files when it ends, until the last of writes at once has ended."""
    with _WRITES["lock"]:
        if not _WRITES["count"]:
            _WRITES["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITES["count"] += 1
    try:
        yield
    finally:
        with _WRITES["lock"]:
            _WRITES["count"] -= 1
            if not _WRITES["count"]:
                if _WRITES["before"] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, _WRITES["before"])


def stored(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write df as a table and read it back: cuts lineage, survives lost executors.

    The write's shuffle files go when it ends, so operators of several rounds need the
    disk of one; what it wrote is in the shared folder.
    """
    with _shuffles_go(df.sparkSession):
        df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing will read it again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words of a text; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_map(df: DataFrame, keep: Sequence[str], given: Sequence[Column], fields: Sequence[tuple[str, str]], work: Callable[[Iterable], Iterable]) -> DataFrame:
    """df's columns `keep` and result `fields` (name, type) that work makes from the columns `given`.

    work takes batches and yields (rows, arrays): a slice of a batch, whose last columns are
    the given ones, and the fields' values for it. Inside, columns have plain names, so those
    of df may clash with anything or hold dots.
    """
    n, kinds = len(keep), {f.name: f.dataType for f in df.schema}
    names = [*[f"c{i}" for i in range(n)], *[f"r{i}" for i in range(len(fields))]]
    schema = T.StructType([T.StructField(x, k) for x, k in zip(names, [*[kinds[c] for c in keep], *[T._parse_datatype_string(t) for _, t in fields]], strict=True)])
    source = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], *[g.alias(f"x{i}") for i, g in enumerate(given)])

    def run(batches):
        for rows, arrays in work(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns[:n], *arrays], names=names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f for f, _ in fields])


def learned_in_task(rows: DataFrame, order: str, columns: Sequence[str], train: Callable[[Iterable[tuple]], dict | None]) -> dict | None:
    """Float32 parameters that train learns from the columns of the rows, in the order of a column, in one executor task.

    For a bounded sample: its rows go to one task, which reads them batch by batch; the
    parameters, of fixed size, come to the driver.
    """

    def work(batches):
        tuples = (tuple(v.as_py() for v in row) for b in batches for row in zip(*b.columns, strict=True))
        for name, values in (train(tuples) or {}).items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([list(values.shape)], pa.list_(pa.int32())), pa.array([values.tobytes()], pa.binary())],
                names=["name", "shape", "data"]
            )

    one = rows.repartition(1).sortWithinPartitions(order).select(*columns).mapInArrow(work, "name string, shape array<int>, data binary")
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in one.collect()} or None
