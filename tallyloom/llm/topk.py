"""Exact top-k inner-product search by pivot-table elimination.

Vectors become integers floor(scale * x). For a query q and a candidate v the inner product is
(|q|^2 + |v|^2 - |q - v|^2) / 2, and |q - v| is at least |d(q, p) - d(v, p)| for every pivot p;
so precomputed distances to many pivots bound every product from above. The stated queries and
the candidates meet in blocks (each block of queries with each of candidates, all of bounded
size). In a block, candidates are sorted into cells by their nearest pivot and norm; a cell's
ranges of distances bound all of its products at once. Cells are taken in the order of their
bounds; a cell, and in it a candidate, is evaluated for a query only if its bound reaches the
k-th score so far, and a query stops when no cell's bound does. Where the candidates' own bounds
have ruled out next to nothing in a block (PAYS), its later cells are judged by their cell's
bound alone: the result is the same. Blocks' best are merged by a last top-k.

Vectors that are null or hold null or non-finite components take no part; vectors of another
length never meet. Ties go to the smaller id; rows that repeat a query's id are no candidates
of it; equal rows of other ids all count. Query rows equal in id and vector are one query, those
of one id and other vectors are queries of their own. Null ids take no part. Empty tables give none. Further
columns are left out, whatever their names. Products below 2^53 are made in doubles, which hold
them exactly, those below 2^62 in integers; larger ones don't fit the result and raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, quoted, scratch, stored

by_value(__name__)

#: Pivots, the rows they are chosen from, and the rows of a block of candidates and of queries.
PIVOTS, PIVOT_ROWS, CANDIDATES, QUERIES = 32, 2000, 8192, 2048
#: Candidates of a cell, queries that go through the cells together, and the share of products
#: that candidates' own bounds must rule out, over the first TRIED cells, to be looked at further.
CELL, TOGETHER, PAYS, TRIED = 256, 64, 0.2, 4


def choose_pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far apart rows: each the farthest from those chosen before."""
    rows = np.unique(rows, axis=0)
    if not len(rows):
        return rows
    chosen, far = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0, square))


def _gaps(dq: np.ndarray, dv: np.ndarray) -> np.ndarray:
    """The greatest difference of distances to any pivot, for each query and candidate."""
    gap = np.zeros((len(dq), len(dv)), np.float32)
    for p in range(dv.shape[1]):
        np.maximum(gap, np.abs(dq[:, p, None] - dv[None, :, p]), out=gap)
    return gap


def search(q_ids, q, ids, rows, pivots, k: int):
    """The k best (query index, candidate index, score) of each query over one block, and how many products were made."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * rows.shape[1]
    if most >= 2**62:
        raise OverflowError("products beyond 2^62")
    if not len(q) or not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    dq, dv = distances(q, pivots).astype(np.float32), distances(rows, pivots).astype(np.float32)
    nq, nv = (q**2).sum(axis=1), (rows**2).sum(axis=1)
    exact = (lambda x: x) if most < 2**53 else (lambda x: x.astype(np.int64))
    q, rows = exact(q), exact(rows)
    order = np.lexsort((nv, dv.argmin(axis=1)))
    cells = [order[at : at + CELL] for at in range(0, len(order), CELL)]
    low, high = (np.stack([f(dv[c], axis=0) for c in cells]) for f in (np.min, np.max))
    large = np.array([nv[c].max() for c in cells])

    def bound(nq, nv, gap):
        """Products' bounds; distances were rounded, so each is widened by more than that."""
        near = np.maximum(0, gap.astype(np.float64) * (1 - 1e-5) - 1e-5 * (1 + np.sqrt(nv)))
        return (nq + nv - near**2) / 2 + 1e-6 * (nq + nv) + 0.5

    out, made, seen, ruled, pays = [], 0, 0, 0, True
    for at in range(0, len(q), TOGETHER):
        part = np.arange(at, min(at + TOGETHER, len(q)))
        gap = np.zeros((len(part), len(cells)), np.float32)
        for p in range(dv.shape[1]):
            d = dq[part, p, None]
            np.maximum(gap, np.maximum(d - high[None, :, p], low[None, :, p] - d), out=gap)
        reach = bound(nq[part, None], large[None, :], gap)
        best = [(np.empty(0, q.dtype), np.empty(0, np.int64)) for _ in part]
        kth = np.full(len(part), -np.inf)
        tried = 0
        for c in np.argsort(-reach.max(axis=0), kind="stable"):
            ask = np.flatnonzero(reach[:, c] >= kth)
            if not len(ask):
                continue
            cell = cells[c]
            if pays:
                able = bound(nq[part[ask], None], nv[None, cell], _gaps(dq[part[ask]], dv[cell])) >= kth[ask, None]
                seen, ruled, tried = seen + able.size, ruled + able.size - int(able.sum()), tried + 1
                cell = cell[able.any(axis=0)]
                pays = tried < TRIED or ruled >= PAYS * seen
            made += len(ask) * len(cell)
            scores = q[part[ask]] @ rows[cell].T
            for j, s in zip(ask, scores, strict=True):
                good = np.flatnonzero(s >= kth[j]) if kth[j] > -np.inf else np.arange(len(cell))
                good = good[ids[cell[good]] != q_ids[part[j]]]
                if len(good):
                    all_s, all_v = np.concatenate([best[j][0], s[good]]), np.concatenate([best[j][1], cell[good]])
                    top = np.lexsort((ids[all_v], -all_s))[:k]
                    best[j] = all_s[top], all_v[top]
                    if len(top) == k:
                        kth[j] = best[j][0][-1]
        out += [(np.full(len(v), i), v, s) for i, (s, v) in zip(part, best, strict=True)]
    i, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return i, j, s.astype(np.int64), made


def _cell(pivots: np.ndarray, size: int, k: int):
    """The search of one block of queries in one block of candidates."""

    def rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("id").to_numpy(), np.array(t.column("v").combine_chunks().flatten()).reshape(-1, size)

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        (q_ids, q), (ids, vectors) = rows_of(asked), rows_of(held)
        i, j, s, _ = search(q_ids, q, ids, vectors, pivots, k) if len(q) and len(ids) else ([], [], [], 0)
        take = lambda x, at: pa.array(x[np.asarray(at, dtype=np.int64)], pa.int64())
        return pa.table({
            "query_id": take(q_ids, i), "u": take(asked.column("u").to_numpy(), i), "vec_id": take(ids, j),
            "score": pa.array(np.asarray(s, dtype=np.int64))
        })

    return work


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row that is_query (a condition) takes."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    vector = quoted(vector_col)
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    good = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.select(quoted(id_col).cast("long").alias("id"), is_query.alias("asks"), F.when(good, whole).alias("v"))
    rows = stored(rows.filter("id is not null and v is not null").withColumns({"size": F.size("v"), "u": F.xxhash64("v")}), f"{path}/rows")
    counts = {r["size"]: r for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    parts = []
    for size, n in counts.items():
        own = rows.filter(F.col("size") == size)
        chosen = choose_pivots(
            np.array([r.v for r in own.orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).select("v").collect()], dtype=np.float64).reshape(-1, size),
            pivots
        )
        c_blocks, q_blocks = -(-n["n"] // CANDIDATES), max(1, -(-n["q"] // QUERIES))
        spread = lambda m, salt: F.pmod(F.xxhash64("id", "u", F.lit(salt)), F.lit(m))
        blocks = lambda a, b: F.concat_ws("/", F.lit(str(size)), a.cast("string"), b.cast("string"))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        candidates = own.select("id", "v", spread(c_blocks, 1).alias("c"), every(q_blocks).alias("q")).select("id", "v", blocks(F.col("c"), F.col("q")).alias("cell"))
        queries = own.filter("asks").dropDuplicates(["id", "u"]).select("id", "u", "v", spread(q_blocks, 2).alias("q"), every(c_blocks).alias("c")).select("id", "u", "v", blocks(F.col("c"), F.col("q")).alias("cell"))

        both = queries.groupBy("cell").cogroup(candidates.groupBy("cell"))
        parts.append(both.applyInArrow(_cell(chosen, size, k), "query_id bigint, u bigint, vec_id bigint, score bigint"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = W.partitionBy("query_id", "u").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
