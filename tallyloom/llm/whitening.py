"""Embedding whitening by the singular values of centred rows.

Components of the vectors become integers x = floor(scale * c) + shift. Rows are centred exactly (n x - S,
with S the sums by dimension, in integers) and divided by n; MLlib's computeSVD of the distributed
centred rows gives the components, all of them, so that the decomposition of their Gram
matrix, which has the size of the dimensions squared, is a full one in double precision. A
singular value s becomes the variance s^2 / n. The total variance is computed apart from it,
from the exact squared deviations. Whitened values are the centred row on a component, divided by the
root of its variance; their covariance, centred before multiplying, is compared with the identity.

Rows with a vector that is null, empty or holds null or non-finite components take no part; nor do
those of another length than `size` (by default the commonest, the smaller of equals). Repeated
rows and null ids take part as they are. Components without variance (below RANK of the first's
singular value, where rounding of the Gram matrix shows) aren't given, so a single row, or equal rows, give no rows. Empty tables give none.
Further columns are left out, whatever their names. Components of 2^40 and more in size raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import usable
from .common import by_value, quoted, scratch, stored

by_value(__name__)

SCALE, SHIFT, RANK, LARGEST = 1024.0, 100_000, 1e-6, 2**40
#: Squared deviations are summed in two parts of at most so many digits each, which decimals hold for any number of rows.
DIGITS = 18


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, size: int | None, scale: float, shift: int) -> DataFrame:
    """(id, x): the vectors that take part, as integers."""
    vector = quoted(vector_col)
    near = lambda x: F.greatest(F.lit(-2 * LARGEST), F.least(F.lit(2 * LARGEST), x))
    whole = F.transform(vector, lambda c: near(F.floor(F.lit(scale) * c.cast("double"))) + F.lit(shift))
    good = usable(vector) & ~F.exists(whole, lambda x: F.abs(x) >= LARGEST)
    rows = df.select(quoted(id_col).alias("id"), F.when(usable(vector, size), whole).alias("x"), F.when(good, 1).alias("fits"))
    return rows.filter("x is not null and size(x) > 0").withColumn("x", F.when(F.col("fits") == 1, F.col("x")).otherwise(F.raise_error("a component's size is 2^40 or more"))).drop("fits")


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows (x) of one length and the exact sums by dimension; (0, []) without rows."""
    d = rows.select(F.size("x")).first()
    if d is None:
        return 0, []
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d[0])]).first()
    return sums.n, [int(s) for s in sums[1:]]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of int64 rows: int64 where that holds it, else Python's integers."""
    most = n * LARGEST + max(map(abs, sums))
    if most < 2**63:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(y: np.ndarray) -> list[int]:
    """The sum of squares of each row of n x - S, exact."""
    most = int(np.abs(y).max()) if y.size else 0
    if y.dtype == np.int64 and most * most * y.shape[1] < 2**63:
        return (y * y).sum(axis=1).tolist()
    return (y.astype(object) ** 2).sum(axis=1).tolist()


def components(rows: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(variances, falling; components by column) of the rows' covariance, divisor n; those without variance left out."""
    d = len(sums)

    def run(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = centred(x, n, sums).astype(np.float64) / n
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, d), pa.int32()), pa.array(y.ravel()))], names=["y"])

    y = rows.select("x").mapInArrow(run, "y array<double>").select(array_to_vector("y").alias("y"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(y, "y"), n, d).computeSVD(d, computeU=False, rCond=RANK)
    s, v = svd.s.toArray(), svd.V.toArray()
    some = s > 0
    return s[some] ** 2 / n, v[:, some]


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8, size: int | None = None, scale: float = SCALE, shift: int = SHIFT
) -> DataFrame:
    """A row for each vector that takes part: id, n, deviation (exact, decimal), whitened (array by component, at most `most`), explained
    (each component's share of the total variance) and identity_error."""
    spark, path, id_type = df.sparkSession, scratch(df.sparkSession), dict(df.dtypes)[id_col]
    result = f"id {id_type}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = stored(whole_vectors(df, id_col, vector_col, size, scale, shift), f"{path}/rows")
    if size is None:
        common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        rows = rows.filter(F.size("x") == common.d) if common else rows
    n, sums = moments(rows)
    if not n:
        return spark.createDataFrame([], result)
    variances, axes = components(rows, n, sums)
    variances, axes = variances[:most], axes[:, :most]
    if not len(variances):
        return spark.createDataFrame([], result)
    d, k, turned = len(sums), len(variances), axes / np.sqrt(variances)

    def project(batches):
        for b in batches:
            y = centred(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d), n, sums)
            w = (y.astype(np.float64) / n) @ turned
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
            deviation = pa.array([str(v) for v in deviations(y)], pa.string()).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), deviation, lists], names=["id", "deviation", "w"])

    found = stored(rows.mapInArrow(project, f"id {id_type}, deviation decimal(38,0), w array<double>"), f"{path}/whitened")
    w = [F.get("w", F.lit(i)) for i in range(k)]
    part = F.lit(10**DIGITS).cast("decimal(38,0)")
    high, low = F.floor(F.col("deviation") / part).cast("decimal(38,0)"), (F.col("deviation") % part).cast("decimal(38,0)")
    first = found.agg(F.sum(high).alias("high"), F.sum(low).alias("low"), *[F.avg(x) for x in w]).first()
    total = (int(first.high) * 10**DIGITS + int(first.low)) / n**3
    apart = [x - F.lit(m) for x, m in zip(w, first[2:], strict=True)]
    products = found.agg(*[F.avg(apart[i] * apart[j]) for i in range(k) for j in range(i, k)]).first()
    same = [float(i == j) for i in range(k) for j in range(i, k)]
    error = max(abs(p - s) for p, s in zip(products, same, strict=True))
    explained = F.array(*[F.lit(float(e / total)) for e in variances])
    return found.select("id", F.lit(n).cast("bigint").alias("n"), "deviation", F.col("w").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """whiten()'s rows with a row for each component (from 1)."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "v")
    return whitened.select("id", "n", "deviation", "identity_error", each).select(
        "id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error"
    )
