"""Exact top-k search by inner product as a Voronoi join.

Data are grouped by the nearest of some pivots, with each vector's distance d to
its pivot c. For a query q and a vector x of the group,

    q.c - |q| d  <=  q.x  <=  q.c + |q| d.

The least distances of each group, a small summary, tell a score that the k-th
best of a query cannot be below, and that score tells per group the distance below
which no vector can matter to the query. Queries are grouped as well, and a
vector is copied only to the query groups it may matter to, where the scores are
worked out block by block; the best of the blocks are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.storage import materialise


@dataclass(frozen=True)
class SearchSettings:
    k: int = 20
    # A component x counts as floor(scale * x).
    scale: int = 64
    # Ids divisible by this are queries.
    query_every: int = 20
    # Pivots of the data groups; the first ones are those of the query groups.
    n_pivots: int = 32
    n_query_groups: int = 8
    # Queries and vectors that meet in one task, on average.
    queries: int = 1024
    vectors: int = 25_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers as doubles; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if not len(sizes):
        return np.zeros((0, 0))
    if (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max()))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _as_wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each pivot."""
    width = max(matrix.shape[1], pivots.shape[1])
    matrix, pivots = _as_wide(matrix, width), _as_wide(pivots, width)
    squares = (matrix**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * matrix @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact up to 2^53; larger ones are
    summed as integers."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _as_wide(queries, width), _as_wide(vectors, width)
    top = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * width
    if top < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def integer_vectors(df: DataFrame, id: str, vector: str, settings: SearchSettings) -> DataFrame:
    """`id, v, h, n` of the rows that take part, each pair of id and vector once; `h`
    is a hash of the vector, `n` says how often the pair is there."""
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(id).isNotNull() & x.isNotNull() & whole).select(
        F.col(id).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(settings.scale * c.cast("double")).cast("long")).alias("v"),
    )
    return rows.withColumn("h", F.xxhash64("v")).groupBy("id", "h").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("n")
    )


def _grouped(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add `cell`, the number of the nearest pivot, and `d`, the distance to it."""

    def run(batches):
        for batch in batches:
            far = _distances(_matrix(batch.column("v")), pivots)
            cell = far.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), batch.column("n"), pa.array(cell),
                 pa.array(far[np.arange(len(cell)), cell])],
                names=["id", "v", "n", "cell", "d"],
            )

    return df.select("id", "v", "n").mapInArrow(run, "id long, v array<long>, n long, cell int, d double")


def _bounded(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, near: np.ndarray, own: int, settings: SearchSettings) -> DataFrame:
    """Add `group`, and `least`, per pivot the distance from which a vector of its
    group may be among the k best of the query; `own` is the most rows of its id."""
    n_groups, k = settings.n_query_groups, settings.k

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("v"))
            width = max(q.shape[1], pivots.shape[1])
            group = _distances(q, pivots[:n_groups]).argmin(axis=1).astype(np.int32)
            norm = np.linalg.norm(q, axis=1)
            at_pivot = _as_wide(q, width) @ _as_wide(pivots, width).T
            lower = at_pivot[:, cells] - norm[:, None] * near
            # All rows of the query's id may be among the best, so as many more than k.
            rank = min(k + own, lower.shape[1])
            floor = -np.partition(-lower, rank - 1, axis=1)[:, rank - 1] if rank == k + own else np.full(len(q), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (floor[:, None] - at_pivot) / norm[:, None]
            # A little less, for rounding; anything for a query of zeros.
            least = np.where(norm[:, None] > 0, least - 1e-6 * (1 + np.abs(least)), -np.inf)
            least = np.nan_to_num(least, nan=-1.0, neginf=-1.0, posinf=np.finfo(float).max)
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(group),
                 pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))],
                names=["id", "v", "group", "least"],
            )

    return queries.select("id", "v").mapInArrow(run, "id long, v array<long>, group int, least array<double>")


def _best(k: int):
    """The k best vectors of each query of a block, ties to the smaller id."""

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros((4, 0), dtype=np.int64)]
        if queries.num_rows and vectors.num_rows:
            ids = vectors.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], _matrix(vectors.column("v"))[order]
            times = vectors.column("n").to_numpy()[order]
            query_ids, q = queries.column("id").to_numpy(), _matrix(queries.column("v"))
            for first in range(0, len(q), 64):
                points = scores(q[first : first + 64], data)
                own = query_ids[first : first + 64, None] == ids
                for query, row, same in zip(query_ids[first : first + 64], points, own):
                    at = np.flatnonzero(~same)
                    if len(at) > k:
                        cut = np.partition(row[at], len(at) - k)[len(at) - k]
                        at = at[row[at] >= cut]
                    # Ids ascend, so a stable sort leaves ties in their order.
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    found.append(np.stack((np.full(len(at), query), ids[at], row[at], times[at])))
        all_ = np.concatenate(found, axis=1)
        return pa.table({"query_id": all_[0], "vec_id": all_[1], "score": all_[2], "n": all_[3]})

    return run


def top_k(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", settings: SearchSettings = SearchSettings()
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best vectors of each query. Runs jobs.

    Null vectors, vectors with a null or non-finite component and rows without
    an id take no part. A repeated row is a candidate as often as it is there; a
    repeated query is answered once. Rows with the id of the query are its own and are
    no candidates. Other columns are not read; an empty table gives an empty result.
    """
    s = settings
    rows = materialise(integer_vectors(df, id, vector, s), "vectors")
    spark = df.sparkSession
    # A bounded sample of pivots, which steer the work but not the result.
    chosen = rows.orderBy(F.xxhash64("id", "h"), "id").limit(s.n_pivots).select("v").collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(len(row["v"]) for row in chosen)
    pivots = np.array([list(row["v"]) + [0] * (width - len(row["v"])) for row in chosen], dtype=np.float64)
    queries = rows.where(F.col("id") % s.query_every == 0)
    # Of equal vectors only those with the smallest ids can be among the best. Map
    # tasks apply this limit too, so a vector that is very common is no hot key.
    by_id = Window.partitionBy("h", "v").orderBy("id")
    candidates = rows.withColumn("_copy", F.row_number().over(by_id)).where(F.col("_copy") <= s.k + 1)
    data = materialise(_grouped(candidates, pivots), "grouped")

    by_distance = Window.partitionBy("cell").orderBy("d", "id")
    nearest = data.select("id", "cell", "d").withColumn("_n", F.row_number().over(by_distance))
    summary = nearest.where(F.col("_n") <= s.k + 1).select("cell", "d").collect()
    cells = np.array([row["cell"] for row in summary], dtype=np.int64)
    near = np.array([row["d"] for row in summary])
    own = queries.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    bounded = materialise(_bounded(queries, pivots, cells, near, own, s), "queries")
    sizes = {row["group"]: row["count"] for row in bounded.groupBy("group").count().collect()}
    n_chunks = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, math.ceil(n / s.queries))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    n_blocks = max(1, math.ceil(data.count() / s.vectors))
    chunked = bounded.withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit(s.k), "id"), F.element_at(n_chunks, F.col("group"))).cast("int")
    )
    bounds = (
        chunked.select("group", "chunk", F.posexplode("least").alias("cell", "least"))
        .groupBy("group", "chunk", "cell")
        .agg(F.min("least").alias("least"))
    )
    copied = (
        data.join(materialise(bounds, "bounds"), "cell")
        .where("d >= least")
        .select("group", "chunk", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "id", "v", "n")
    )
    spread = chunked.select(
        "group", "chunk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "id", "v"
    )
    keys = ("group", "chunk", "block")
    met = spread.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInArrow(
        _best(s.k), "query_id long, vec_id long, score long, n long"
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= s.k)

    # Of the k best, each is there as often as its row is.
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(s.k).cast("long"))))
    return (
        best(best(met).select("query_id", "vec_id", "score", each.alias("copy")))
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
