"""Centroid clustering of integer vectors with Elkan's bounds, exact in every assignment.

Each vector keeps, from round to round, its cluster, an upper bound on the
distance to its centroid and a lower bound on that to each of the k centroids.
A round moves the bounds by how far the centroids have moved and computes a
distance only where neither a lower bound nor half the distance between two
centroids shows that a centroid is farther. Bounds are doubles, rounded outward
by SLACK at each step, and prune strictly, so an equally near centroid is always
looked at; distances that decide are squared distances of integers, exact in 64
bits, and ties go to the smaller number.

A round is one pass of Python in Arrow batches over the stored vectors with
their bounds, k centroids sent along, written to the shared folder as the next
round's input (the previous one goes then), and one aggregation by cluster in
Spark, partial sums first, whose k rows make the next centroids. Nothing depends
on how the rows are dealt, so a lost task is repeated with the same result.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component aren't kept, and neither are those with a component beyond
+-MOST, whose squared distances don't fit 64 bits; fewer than k kept vectors
make as many clusters; none, an empty result; repeated vectors and repeated
identifiers are rows like any others, null identifiers are the last to be
seeds, and equal seed hashes are told apart by the vectors' components; a
centroid without vectors stays where it is; other columns aren't read, and the
result has none of their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, batch_of, dropped, shared_folder, stored

SCALE, CLUSTERS, ROUNDS, DIMS = 1024, 8, 10, 64
#: Largest magnitude of a component after scaling: 64 squared differences of twice as much fit 63 bits.
MOST = 1 << 27
#: Relative rounding of a bound, some steps of a double's last bit.
SLACK = 2.0**-50


def components(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def kept(vector: str, dims: int = DIMS, scale: int = SCALE) -> Column:
    """True for vectors that take part; a comparison with NaN is false only this way round, since Spark puts NaN above all numbers."""
    within = lambda x: F.coalesce(F.abs(x.cast("double")) * scale <= MOST - 1, F.lit(False))
    return F.coalesce(F.size(vector) == dims, F.lit(False)) & F.coalesce(F.forall(vector, within), F.lit(False))


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK), 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Round:
    """The centroids of a round and what follows from them."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.centroids = np.array(centroids, np.int64)
        root = np.sqrt(_squared(self.centroids[:, None], self.centroids[None]).astype(float))
        self.half = _down(root / 2)
        np.fill_diagonal(self.half, np.inf)
        self.nearest_half = self.half.min(axis=1)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(_squared(self.centroids, np.array(before, np.int64)).astype(float))
        self.moved = _up(moved)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, bounds, exact squared distances (-1 where none was needed) and numbers of computed distances."""
        n, k = lower.shape
        cluster = cluster.copy()
        upper, lower = _up(upper + self.moved[cluster]), _down(lower - self.moved)
        exact, computed = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        open_ = upper >= self.nearest_half[cluster]
        for c in range(k):
            nearer = lambda rows, c=c: rows[(cluster[rows] != c) & (upper[rows] >= lower[rows, c]) & (upper[rows] >= self.half[cluster[rows], c])]
            rows = nearer(np.flatnonzero(open_))
            loose = rows[exact[rows] < 0]
            if len(loose):
                self.tighten(vectors, loose, cluster, upper, lower, exact, computed)
                rows = nearer(rows)
            if not len(rows):
                continue
            d = _squared(vectors[rows], self.centroids[c])
            computed[rows] += 1
            root = np.sqrt(d.astype(float))
            lower[rows, c] = _down(root)
            wins = (d < exact[rows]) | ((d == exact[rows]) & (c < cluster[rows]))
            won = rows[wins]
            cluster[won], exact[won], upper[won] = c, d[wins], _up(root[wins])
        return cluster, upper, lower, exact, computed

    def tighten(self, vectors: np.ndarray, rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: np.ndarray, computed: np.ndarray) -> None:
        """The exact distance of rows to their own centroid."""
        exact[rows] = _squared(vectors[rows], self.centroids[cluster[rows]])
        computed[rows] += 1
        root = np.sqrt(exact[rows].astype(float))
        upper[rows], lower[rows, cluster[rows]] = _up(root), _down(root)


def _stepped(step: Round, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(step.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            vectors = b.column("vec").flatten().to_numpy().reshape(n, -1).astype(np.int64)
            cluster, upper = b.column("cluster").to_numpy(), b.column("upper").to_numpy()
            lower = b.column("lower").flatten().to_numpy().reshape(n, k)
            cluster, upper, lower, exact, computed = step.assign(vectors, cluster, upper, lower)
            out = {"id": b.column("id")}
            if last:
                rows = np.flatnonzero(exact < 0)
                step.tighten(vectors, rows, cluster, upper, lower, exact, computed)
                out |= {"cluster": pa.array(cluster), "distance": pa.array(exact)}
            else:
                ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
                out |= {"vec": b.column("vec"), "cluster": pa.array(cluster), "upper": pa.array(upper), "lower": pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))}
            yield batch_of(out | {"computed": pa.array(b.column("computed").to_numpy() + computed)})

    return run


def seeds(vectors: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """Components of the k vectors whose identifiers' hashes are the smallest."""
    order = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).asc_nulls_last()
    return [list(r["vec"]) for r in vectors.orderBy(order, "vec").limit(k).select("vec").collect()]


def _moved_to_means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the clusters' means, component by component; k rows reach the driver."""
    sums = [F.sum(F.get("vec", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, prefix: str = "3:", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, computed) of each kept vector, and the centroids.

    distance is the squared one to its centroid, computed the number of distances
    that were computed for the vector in all rounds; without bounds it would be
    k * (rounds + 1).
    """
    spark = df.sparkSession
    base = df.where(kept(vector, dims, scale)).select(F.col(key).alias("id"), components(vector, scale).alias("vec"))
    kind = base.schema["id"].dataType.simpleString()
    path = shared_folder(spark)
    base = stored(base, path=path)
    centroids = seeds(base, k, prefix)
    if not centroids:
        return base.selectExpr("id", "0 AS cluster", "0L AS distance", "0L AS computed"), []
    # No bound is known yet: the first round starts from cluster 0 with bounds that exclude nothing.
    state = base.selectExpr("id", "vec", "0 AS cluster", "double('Infinity') AS upper", f"array_repeat(0D, {len(centroids)}) AS lower", "0L AS computed")
    before = None
    for _ in range(rounds):
        schema = f"id {kind}, vec array<int>, cluster int, upper double, lower array<double>, computed long"
        at = shared_folder(spark)
        state = stored(arrow_map(state, _stepped(Round(centroids, before), last=False), schema), path=at)
        dropped(path)
        path = at
        before, centroids = centroids, _moved_to_means(state, centroids)
    last = arrow_map(state, _stepped(Round(centroids, before), last=True), f"id {kind}, cluster int, distance long, computed long")
    out = stored(last)
    dropped(path)
    return out, centroids


def with_totals(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with the summed distances of their cluster and of all, and the hash of their centroid's components."""
    spark = rows.sparkSession
    of = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    table = [(c, of.get(c, 0), sum(of.values()), ",".join(map(str, v))) for c, v in enumerate(centroids)]
    totals = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid string")
    # A row for each of the k clusters.
    return rows.join(F.broadcast(totals), "cluster").withColumn("centroid_sha256", F.sha2("centroid", 256))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, prefix: str = "3:") -> str:
    """DuckDB SQL with all distances of every round."""
    square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.vec[i] - c.vec[i]) * (v.vec[i] - c.vec[i])))"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.rid, any_value(v.vec) AS vec, min(CAST({square} AS HUGEINT) * {k} + c.cluster) AS best FROM vecs v, c{r} c GROUP BY v.rid)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT CAST(best % {k} AS INTEGER) AS cluster, i, sum(vec[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY 1, 2)")
            parts.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS vec FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)")
    return f"""
WITH vecs AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS vec
         FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) * {scale} <= {MOST - 1})) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{prefix}' || vec_id), vec) - 1 AS INTEGER) AS cluster, vec FROM vecs ORDER BY cluster LIMIT {k}),
{", ".join(parts)},
near AS (SELECT rid, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM a{rounds}),
totals AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near GROUP BY cluster),
every AS (SELECT CAST(sum(distance) AS BIGINT) AS inertia FROM near)
SELECT v.vec_id, n.cluster, n.distance, t.cluster_inertia, e.inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM near n JOIN vecs v ON v.rid = n.rid JOIN totals t ON t.cluster = n.cluster JOIN c{rounds} c ON c.cluster = n.cluster, every e
"""
