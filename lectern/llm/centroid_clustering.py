"""Centroid clustering of whole-number vectors by exponion search.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to all others. Where
these don't settle the assignment, only centroids inside a ball around the current one are scanned, by lists of centroids sorted
by their distance from each other. A round is one pass: a task writes its vectors with their new state and, in the same table, a
row of sums for each of its clusters, so that the new centroids come from a few columns of what was just written. The driver
holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import forget, persist_shared

DIMENSION, CLUSTERS, ROUNDS = 64, 40, 5
#: Components are whole multiples of one in so many; those beyond LIMIT count as LIMIT, for a long can't hold longer distances.
SCALE, LIMIT = 256, 2**27
#: Up to this size products of components are exact in doubles, which is faster.
EXACT = 2**22
#: Bounds are doubles: this share covers their rounding, so that a tie is never mistaken for a gap.
SLACK = 1e-9
#: Centroids of a list that are scanned in the first step; each later step is twice as long.
STEP = 4


def whole_vectors(column: pa.Array, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components in whole numbers) of a list column: right length, nothing null, all finite."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dimension)
    flat = column.take(pa.array(rows)).flatten() if len(rows) else pa.array([], pa.float64())
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dimension)  # nulls become NaN
    good = np.isfinite(x).all(1)
    return rows[good], np.clip(np.floor(SCALE * x[good]), -LIMIT, LIMIT).astype(np.int64)


class Centroids:
    """Centroids with their sorted distances from each other, and how far they moved since the last round."""

    def __init__(self, at: np.ndarray, last: np.ndarray | None = None) -> None:
        self.at, self.k = at, len(at)
        self.norms = (at * at).sum(1)
        between = np.sqrt(self.squared(at, np.arange(self.k)).astype(float))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, 1)
        self.nearest = self.between[:, 1] if self.k > 1 else np.full(1, np.inf)
        self.moved = np.zeros(self.k) if last is None else np.sqrt(((at - last) ** 2).sum(1).astype(float)) * (1 + SLACK)
        falling = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(self.k, self.moved[falling[0]])
        self.others_moved[falling[0]] = self.moved[falling[1]] if self.k > 1 else 0.0

    def squared(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of ``x`` from some centroids."""
        c = self.at[some]
        if not len(x) or max(np.abs(x).max(), np.abs(self.at).max()) <= EXACT:
            products = (x.astype(float) @ c.T.astype(float)).astype(np.int64)
            return (x * x).sum(1)[:, None] + self.norms[some][None, :] - 2 * products
        return np.stack([((x - one) ** 2).sum(1) for one in c], 1)

    def own(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Exact squared distance of each row from its own centroid."""
        return ((x - self.at[a]) ** 2).sum(1)

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New (centroid, upper bound, lower bound) of each row, and how many distances were computed."""
        upper, lower = upper + self.moved[a], lower - self.others_moved[a]
        settled = lambda rows: upper[rows] * (1 + SLACK) < np.maximum(lower[rows], self.nearest[a[rows]] / 2) * (1 - SLACK)
        rows = np.flatnonzero(~settled(slice(None)))
        upper[rows] = np.sqrt(self.own(x[rows], a[rows]).astype(float))
        scanned = len(rows)
        rows = rows[~settled(rows)]
        a = a.copy()
        for c in np.unique(a[rows]):
            mine = rows[a[rows] == c]
            # all centroids as near as the second nearest are at most 2 u + s from this one; the radius is inclusive
            radius = (2 * upper[mine] + self.nearest[c]) * (1 + SLACK)
            within = np.searchsorted(self.between[c], radius, "right")
            best, second = np.full(len(mine), np.iinfo(np.int64).max), np.full(len(mine), np.inf)
            number = np.full(len(mine), self.k)
            begin, step = 0, STEP
            while begin < self.k and len(left := np.flatnonzero(within > begin)):
                some = self.order[c, begin : begin + step]
                found = self.squared(x[mine[left]], some)
                scanned += found.size
                for j, d in zip(some, found.T):
                    better = (d < best[left]) | ((d == best[left]) & (j < number[left]))
                    second[left] = np.where(better, np.where(number[left] < self.k, best[left], np.inf), np.minimum(second[left], d))
                    best[left] = np.where(better, d, best[left])
                    number[left] = np.where(better, j, number[left])
                begin, step = begin + step, 2 * step
            a[mine], upper[mine], lower[mine] = number, np.sqrt(best.astype(float)), np.sqrt(second)
        return a, upper, lower, scanned


def _state(spark_type: str, last: bool) -> str:
    state = "distance long" if last else "v binary, upper double, lower double"
    return f"vec_id {spark_type}, cluster int, {state}, n long, inertia long, sums array<long>"


def _pass(rows: DataFrame, centroids: Centroids, raw: bool, last: bool, spark_type: str) -> DataFrame:
    """One assignment of all rows, with a row of sums (``n`` not null) for each task and cluster."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = _state(spark_type, last)
    d, k = centroids.at.shape[1], centroids.k
    out = StructType.fromDDL(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        sums, counts, inertia = np.zeros((k, d), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)

        def batch(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        for b in batches:
            ids = b.column(0)
            if raw:
                kept, x = whole_vectors(b.column(1), d)
                ids, a = ids.take(pa.array(kept)), np.zeros(len(kept), np.int64)
                upper, lower = np.full(len(kept), np.inf), np.zeros(len(kept))
            else:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int32).reshape(b.num_rows, d).astype(np.int64)
                a, upper, lower = (b.column(i).to_numpy().astype(t) for i, t in ((1, np.int64), (3, float), (4, float)))
            if not len(x):
                continue
            a, upper, lower, _ = centroids.assign(x, a, upper, lower)
            counts += np.bincount(a, minlength=k)
            columns = {"vec_id": ids, "cluster": pa.array(a)}
            if last:
                distance = centroids.own(x, a)
                np.add.at(inertia, a, distance)
                columns["distance"] = pa.array(distance)
            else:
                np.add.at(sums, a, x)
                bits = x.astype(np.int32).tobytes()
                columns |= {"v": pa.array([bits[i : i + 4 * d] for i in range(0, len(bits), 4 * d)], pa.binary()), "upper": pa.array(upper), "lower": pa.array(lower)}
            yield batch(columns)
        used = np.flatnonzero(counts)
        if len(used):
            yield batch({"cluster": pa.array(used), "n": pa.array(counts[used]), "inertia": pa.array(inertia[used]), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    return rows.mapInArrow(work, schema)


def _means(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; clusters without vectors keep their centroid."""
    totals = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("component", "part"))
    totals = totals.groupBy("cluster", "component").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = at.copy()
    for r in totals.collect():  # a row for each cluster and component
        new[r.cluster, r.component] = int(r.total) // r.n
    return new


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, dimension: int = DIMENSION) -> np.ndarray:
    """Vectors of the ``clusters`` smallest hashes of ``2:<vec_id>``; of one id's vectors the one of the least bytes comes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = whole_vectors(b.column(1), dimension)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array([v.tobytes() for v in x.astype(">i4")], pa.binary())], names=["hash", "v"])

    hashed = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("hash"), "embedding")
    found = hashed.mapInArrow(work, "hash string, v binary").orderBy("hash", "v").limit(clusters).collect()
    return np.array([np.frombuffer(bytes(r.v), ">i4") for r in found], np.int64).reshape(len(found), dimension)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of the right length with finite components.

    Other vectors are left out: null, too short or too long, with a null, NaN or infinite component. Ties go to the
    centroid of the smaller number; clusters without vectors keep their centroid. Rows that repeat an id are clustered each; rows
    without an id too, but none of them starts a centroid (without any that does there are no rows). With fewer than ``clusters`` vectors each starts one; an empty table
    has no rows. Components beyond 2^27 count as 2^27. Other columns are ignored. Stops early once no centroid moves, which
    changes nothing. A lost task is run again from the table of the round before.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    at = first_centroids(vectors, clusters, dimension)
    if not len(at):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, table, centroids = vectors.select("vec_id", "embedding"), None, Centroids(at)
    for k in range(rounds):
        last, table = table, persist_shared(_pass(state, centroids, k == 0, False, kind), "clusters")
        if last:
            forget(last)
        state = table.where("n is null").select("vec_id", "cluster", "v", "upper", "lower")
        new = _means(table, at)
        still = (new == at).all()
        at, centroids = new, Centroids(new, at)
        if still:
            break
    done = persist_shared(_pass(state, centroids, table is None, True, kind), "clustered")
    if table:
        forget(table)
    by = {r.cluster: int(r.total) for r in done.where("n is not null").groupBy("cluster").agg(F.sum("inertia").alias("total")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    names = spark.createDataFrame([(c, t, sum(by.values()), hashes[c]) for c, t in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = done.where("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(names), "cluster")  # a row for each cluster
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(
            f"a{k} AS MATERIALIZED (SELECT row_id, vec_id, v, arg_min(c, struct_pack(d, c)) AS c, min(d) AS d FROM (SELECT row_id, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{k}) GROUP BY ALL)"
        )
        if k < ROUNDS:
            parts.append(
                f"m{k} AS MATERIALIZED (SELECT c, list(floor_mean ORDER BY i) AS w FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS floor_mean FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i)) GROUP BY c)"
            )
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, COALESCE(list_transform(m{k}.w, lambda x: x::BIGINT), c{k}.w) AS w FROM c{k} LEFT JOIN m{k} USING (c))")
    return ",\n".join(parts)


#: The same rounds by plain SQL: every vector meets every centroid.
ORACLE_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INTEGER AS c, v AS w FROM k WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}),
{_rounds_sql()}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""
