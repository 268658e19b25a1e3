"""Stored vectors in trained cells: exact nearest vectors that read only the cells which the triangle inequality leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.retrieval import BLOCK_NUMBERS, _best

#: Vectors, of the least hashes of their ids, that the centres are trained on, and rounds of that training.
SAMPLE, ROUNDS = 20_000, 6
#: Distances are doubles: what bounds may be off by.
SLACK = 1e-6


def _matrix(column: pa.Array, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their components) of a list column: those of the right length without nulls and non-finite numbers."""
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == places)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), places)
    good = np.isfinite(flat).all(1)
    return rows[good], flat[good]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def train_centres(vectors: DataFrame, cells: int, places: int, sample: int = SAMPLE) -> np.ndarray:
    """Means of at most ``cells`` groups of a bounded sample; the sample is the same at every run."""
    rows = vectors.where(F.size("embedding") == places).select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id", F.hash("embedding")).limit(sample).collect()
    x = np.array([r.embedding for r in rows if all(v is not None for v in r.embedding)], float).reshape(-1, places)
    x = x[np.isfinite(x).all(1)]
    centres = np.unique(x[:cells], axis=0)
    for _ in range(ROUNDS if len(centres) else 0):
        own = _distances(x, centres).argmin(1)
        centres = np.array([x[own == c].mean(0) for c in np.unique(own)])
    return centres


def write_cells(vectors: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE) -> DataFrame:
    """Store vectors by cells in ``path``, a folder a cell; returns (and stores) the cells: cell, centre, radius, n.

    ``vectors``: vec_id, embedding. Most vectors' length counts; null vectors, those of another length and those with nulls or non-finite
    numbers are left out. Repeated ids are stored each. A cell's radius is the largest distance of a vector of it from its centre. Cells are
    split over tasks where they are large.
    """
    spark = vectors.sparkSession
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    common = v.groupBy(F.size("embedding").alias("places")).count().orderBy(F.desc("count"), "places").first()
    places = common.places if common else 1
    centres = train_centres(v, cells, places, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _matrix(b.column(1), places)
            if len(rows):
                cell = _distances(x, centres).argmin(1)
                gap = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                kept = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), pa.array(gap), pa.array(cell.astype(np.int32))], names=["vec_id", "embedding", "gap", "cell"])

    stored = v.mapInArrow(assign, "vec_id long, embedding array<double>, gap double, cell int") if len(centres) else v.select("*", F.lit(0.0).alias("gap"), F.lit(0).alias("cell")).limit(0)
    stored.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = _stored(spark, path).groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
    at.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return spark.read.parquet(f"{path}/cells")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<double>, gap double, cell int").parquet(f"{path}/vectors")


def _search(ids: np.ndarray, q: np.ndarray, needs: np.ndarray, k: int, digits: int, include_self: bool):  # noqa: ANN202
    """Each task's ``k`` nearest of every query, among vectors (vec_id, embedding, cell) of the cells that the query needs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        bound = np.full(len(ids), np.inf)
        for b in batches:
            vec, cells = b.column(0).to_numpy(), b.column(2).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
            for c in np.unique(cells):
                rows, asked = np.flatnonzero(cells == c), np.flatnonzero(needs[:, c])
                for at in range(0, len(rows), max(1, BLOCK_NUMBERS // max(1, len(asked)))):
                    part = rows[at : at + max(1, BLOCK_NUMBERS // max(1, len(asked)))]
                    d = _distances(x[part], q[asked])
                    if not include_self:
                        d[vec[part][:, None] == ids[asked][None]] = np.inf
                    limit = np.minimum(bound[asked], np.partition(d, k - 1, axis=0)[k - 1]) if len(part) >= k else bound[asked]
                    i, j = np.nonzero((d <= limit[None] + SLACK + 10.0**-digits) & np.isfinite(d))
                    exact = np.round(np.sqrt(((x[part[i]] - q[asked[j]]) ** 2).sum(1)), digits)
                    best = _best(*(np.concatenate(z) for z in zip(best, (asked[j], vec[part[i]], exact))), k)
                    last = np.full(len(ids), -np.inf)
                    np.maximum.at(last, best[0], best[2])
                    bound = np.where(np.bincount(best[0], minlength=len(ids)) >= k, last, np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], names=["query_id", "vec_id", "distance"])

    return work


def nearest_in_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int = 9, include_self: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank, cells_read) of the ``k`` nearest stored vectors of every query by l2, exactly, as ``knn`` gives them.

    ``queries``: vec_id, embedding; counted, they go in blocks. A block first reads for each query the cells of the nearest centres that hold ``k``
    vectors; their k-th distance bounds the result. Then it reads the other cells of which some vector may lie within the bound: a vector of
    a cell is no nearer than the centre's distance less the radius. Cells that no query needs aren't opened. ``cells_read`` counts a query's cells.
    """
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # trained, so bounded
    q = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    schema = "query_id long, vec_id long, distance double"
    if not cells:
        return spark.createDataFrame([], f"{schema}, rank int, cells_read int")
    centres, radius, n = np.array([r.centre for r in cells]), np.array([r.radius for r in cells]), np.array([r.n for r in cells])
    number, places = np.array([r.cell for r in cells]), centres.shape[1]
    q = q.where(F.size("q") == places)
    blocks = max(1, -(-q.count() * (places + len(cells)) // BLOCK_NUMBERS))
    out = None
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()  # one block
        ids, x = np.array([r.query_id for r in part], np.int64), np.array([r.q for r in part], float).reshape(len(part), places)
        apart = np.sqrt(np.maximum(0, ((x[:, None, :] - centres[None]) ** 2).sum(2))) if len(part) * centres.size <= BLOCK_NUMBERS else _distances(x, centres)
        order = np.argsort(apart, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(apart.shape, bool)
        np.put_along_axis(first, order, before < k + (not include_self), axis=1)

        def read(chosen: np.ndarray) -> DataFrame:
            needs = np.zeros((len(ids), int(number.max()) + 1), bool)
            needs[:, number] = chosen
            some = [int(c) for c in number[chosen.any(0)]]
            return _stored(spark, path).where(F.col("cell").isin(some)).select("vec_id", "embedding", "cell").mapInArrow(_search(ids, x, needs, k, digits, include_self), schema)

        near = read(first)
        kth = {r.query_id: r.distance for r in near.withColumn("rank", rank).where(F.col("rank") == k).collect()}  # one a query of the block
        bound = np.array([kth.get(i, np.inf) for i in ids.tolist()])
        more = (apart - radius[None] <= bound[:, None] + SLACK + 10.0**-digits) & ~first
        counts = spark.createDataFrame(list(zip(ids.tolist(), (first | more).sum(1).tolist())), "query_id long, cells_read int").dropDuplicates(["query_id"])
        found = near.unionByName(read(more)).withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(counts), "query_id")  # a row a query of the block
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "vec_id", "distance", "rank", "cells_read")
