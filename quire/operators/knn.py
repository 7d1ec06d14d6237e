"""Exact nearest neighbours over a table with a vector column, and the table's own operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions import vector as V

MAX_K, MAX_DIMENSION = 4_096, 8_192
#: Distances are compared and returned with so many decimals, ties by key.
DECIMALS = 6
#: Queries multiplied at once, and kept rows of all queries that one pass over the base holds in a task.
QUERY_BLOCK, PASS_ROWS = 1_024, 1 << 20
#: Base rows multiplied at once.
BASE_ROWS = 1_024


def _check_k(k: int) -> None:
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k must be from 0 to {MAX_K}")


def knn(
    df: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "l2",
    key: str = "vec_id",
    vector: str = "embedding",
    where: Column | None = None,
    ids: DataFrame | Sequence | None = None,
    distance_range: Sequence[tuple[str, float]] = (),
    decimals: int = DECIMALS,
) -> DataFrame:
    """The k rows of df nearest to query, with their distance.

    where: a predicate on other columns, pushed into the scan; ids: keys to which
    the search is restricted, a list or a table with the key column;
    distance_range: pairs of >, >=, <, <= and a bound. All of them apply before
    the top k. Ties go to the least key. A row without a vector, or with a null
    in it, has no distance and is never a neighbour. The rest of the columns is
    fetched for the winners only as far as the caller asks for them.
    """
    _check_k(k)
    if len(query) > MAX_DIMENSION:
        raise ValueError(f"at most {MAX_DIMENSION} dimensions")
    if where is not None:
        df = df.where(where)
    if isinstance(ids, DataFrame):
        df = df.join(ids.select(key), key, "left_semi")
    elif ids is not None:
        df = df.where(F.col(key).isin(list(ids)))
    df = df.where(F.col(vector).isNotNull()).withColumn("distance", F.round(V.distance_to(metric, vector, query), decimals) + 0.0)
    for op, bound in distance_range:
        d = F.col("distance")
        if op not in (">", ">=", "<", "<="):
            raise ValueError(f"{op} is no range operator")
        df = df.where({">": d > bound, ">=": d >= bound, "<": d < bound, "<=": d <= bound}[op])
    return df.orderBy(F.asc_nulls_last("distance"), key).limit(k).where("distance is not null")


def knn_batch(queries: DataFrame, base: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", decimals: int = DECIMALS) -> DataFrame:
    """(query_key, key, distance, rank): the k nearest base rows (l2) of each query.

    A pass over base takes as many queries as keep PASS_ROWS rows, in blocks of
    QUERY_BLOCK, each a broadcast. A task multiplies its rows with each block and
    keeps the best k rows a query from its first row to its last, so what is
    shuffled is k rows for each query and task, whatever the size of base.
    Products only choose candidates; distances are those of differences, so a
    vector's distance from itself is 0. Rows without a vector, or with a null in
    it, are neither queries nor neighbours.
    """
    _check_k(k)
    spark = base.sparkSession
    whole = lambda df, c: df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(c, vector)
    queries, base = whole(queries, query_key), whole(base, key)
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.select(query_key).schema, *base.select(key).schema)}
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, distance double"
    parts = []
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    together = max(1, PASS_ROWS // (QUERY_BLOCK * max(k, 1)))
    for first in range(0, blocks, together):
        shared = []
        for i in range(first, min(first + together, blocks)):
            rows = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i).collect()  # about QUERY_BLOCK
            shared.append(spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))))
        parts.append(base.mapInArrow(_nearest(shared, k, decimals, (query_key, key), to_arrow_type(queries.schema[query_key].dataType)), schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Best:
    """The k least (distance, key) of each query of a block so far."""

    def __init__(self, names: list, q: np.ndarray, k: int, decimals: int):
        self.names, self.q, self.k, self.decimals, self.size = names, q, k, decimals, (q * q).sum(1) if len(q) else q
        self.query, self.distance, self.keys = np.empty(0, np.intp), np.empty(0), np.empty(0, object)
        self.bound = np.full(len(names), np.inf)

    def add(self, keys: np.ndarray, x: np.ndarray, of: np.ndarray | None = None) -> None:
        """Rows x for all queries, or for those at the places of."""
        if not len(self.names) or not self.k:
            return
        own = slice(None) if of is None else of
        q, size = self.q[own], (x * x).sum(1)
        guess = self.size[own][:, None] + size - 2 * q @ x.T
        # What rounding of the products may hide, and of the distances.
        wrong = 8 * (x.shape[1] + 2) * np.finfo(float).eps * (self.size[own][:, None] + size)
        if x.shape[0] > self.k:
            least = np.sqrt(np.maximum(np.partition(guess + wrong, self.k - 1, axis=1)[:, self.k - 1], 0)) + 10.0**-self.decimals
            bound = np.minimum(self.bound[own], least)
        else:
            bound = self.bound[own]
        i, j = np.nonzero(guess - wrong <= (bound * bound)[:, None])
        d = np.concatenate([np.sqrt(((q[i[a : a + 65_536]] - x[j[a : a + 65_536]]) ** 2).sum(1)) for a in range(0, len(i), 65_536)] or [np.empty(0)])
        self.query, self.distance, self.keys = np.concatenate((self.query, i if of is None else of[i])), np.concatenate((self.distance, np.round(d, self.decimals))), np.concatenate((self.keys, keys[j]))
        if len(self.query) > 4 * self.k * len(self.names):
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((np.unique(self.keys, return_inverse=True)[1], self.distance, self.query)) if len(self.keys) else np.empty(0, np.intp)
        self.query, self.distance, self.keys = self.query[order], self.distance[order], self.keys[order]
        n = np.bincount(self.query, minlength=len(self.names))
        rank = np.arange(len(self.query)) - np.repeat(np.cumsum(n) - n, n)
        last = rank == self.k - 1
        self.bound[self.query[last]] = self.distance[last] + 10.0**-self.decimals
        self.query, self.distance, self.keys = self.query[rank < self.k], self.distance[rank < self.k], self.keys[rank < self.k]


def _nearest(shared, k: int, decimals: int, names: tuple[str, str], query_kind: pa.DataType):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, dimension = [Best(*s.value, k, decimals) for s in shared], None, None
        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, b.num_rows, BASE_ROWS):
                part = b.slice(at, BASE_ROWS)
                keys = np.empty(part.num_rows, object)
                keys[:] = part.column(0).to_pylist()
                flat, dimension = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(part.column(1)[0])
                x = flat.reshape(part.num_rows, dimension)
                for own in best:
                    own.add(keys, x)
        for own in best:
            own.cut()
            if len(own.query):
                yield pa.RecordBatch.from_arrays([pa.array([own.names[i] for i in own.query.tolist()], query_kind), pa.array(own.keys.tolist(), kind), pa.array(own.distance)], names=[*names, "distance"])

    return nearest


def centroids(df: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """(group, pos, mean): the mean vector of each group, a row for each place."""
    return df.select(group, F.posexplode(vector).alias("pos", "value")).groupBy(group, "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, embedding): mean vector of the group's rows over its length; a zero vector stays zero."""
    parts = centroids(df, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("m"))
    size = V.norm("m")
    return parts.select(group, F.transform("m", lambda x: F.when(size > 0, x / size).otherwise(x).cast("float")).alias("embedding"))


class VectorTable:
    """A stored table with a vector column: declared, filled, changed and searched.

    Tables are Parquet folders, partitioned by the partition columns, so that a
    predicate on these reads their folders only. Changes write a new version
    beside the old one; readers see one or the other, and the version before
    stays for those that have begun. A change is made from the version that it
    has read and becomes the one after it: a writer claims that number by a file
    that only one can create, and fails, changing nothing, where it is claimed
    or there already. A claim that a dead driver has left is to be deleted by
    hand.
    """

    TYPES = {"float": "array<float>", "int8": "array<tinyint>", "bit": "binary"}

    def __init__(self, spark: SparkSession, path: str, dimension: int, kind: str = "float", metric: str = "l2", key: str = "id string", partition: Sequence[str] = (), metadata: Sequence[str] = (), auxiliary: Sequence[str] = ()):
        if not 0 < dimension <= MAX_DIMENSION or kind not in self.TYPES or len(partition) > 4 or len(metadata) > 16 or len(auxiliary) > 16:
            raise ValueError("the declaration is out of bounds")
        if kind == "bit" and (metric != "hamming" or dimension % 8) or kind != "bit" and metric not in V.METRICS:
            raise ValueError("the metric doesn't fit the element type")
        self.spark, self.path, self.dimension, self.kind, self.metric = spark, path, dimension, kind, metric
        self.key, self.partition = key.split()[0], [c.split()[0] for c in partition]
        self.metadata, self.auxiliary = [c.split()[0] for c in metadata], [c.split()[0] for c in auxiliary]
        self.schema = ", ".join([key, *metadata, *auxiliary, f"embedding {self.TYPES[kind]}", *partition])

    def _versions(self) -> list[int]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(base):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in store.listStatus(base) if s.getPath().getName().startswith("v") and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def newest(self) -> int:
        """The version that a change begins from; 0 before the first."""
        return (self._versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")

    def _write(self, df: DataFrame, base: int) -> None:
        """df as the version after base."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = base + 1
        claim = path(f"{self.path}/_claim-v{at}")
        store = claim.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.createNewFile(claim):
            raise RuntimeError(f"another writer changes {self.path}")
        try:
            known = self._versions()  # after the claim: no other writer can add this version any more
            if known and known[-1] >= at:
                raise RuntimeError(f"another writer has changed {self.path}")
            df.write.mode("overwrite").partitionBy(*self.partition).parquet(f"{self.path}/v{at}")
        finally:
            store.delete(claim, False)
        for old in known[:-1]:
            store.delete(path(f"{self.path}/v{old}"), True)

    def checked(self, rows: DataFrame) -> DataFrame:
        """The rows in the declared types; wrong dimensions and absent metadata are errors."""
        names = [self.key, *self.metadata, *self.auxiliary, "embedding", *self.partition]
        size = F.octet_length("embedding") * 8 if self.kind == "bit" else F.size("embedding")
        wrong = F.col("embedding").isNull() | (size != self.dimension)
        for c in self.metadata:
            wrong = wrong | F.col(c).isNull()
        rows = rows.select(*names).where(F.when(wrong, F.raise_error(F.lit("a row doesn't fit the declaration")).cast("boolean")).otherwise(True))
        return self.spark.createDataFrame([], self.schema).unionByName(rows)

    def upsert(self, rows: DataFrame, order: Column | None = None) -> None:
        """Inserts rows; those with a known key replace it. The last of a key in order wins."""
        last = Window.partitionBy(self.key).orderBy((F.monotonically_increasing_id() if order is None else order).desc())
        base = self.newest()
        rows = self.checked(rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"))
        self._write(self.read(base).join(rows, self.key, "left_anti").unionByName(rows), base)

    def update(self, rows: DataFrame) -> None:
        """Changes vector, metadata and auxiliary values of known keys; a null leaves a value as it is."""
        values = [c for c in rows.columns if c != self.key]
        if set(values) & set(self.partition):
            raise ValueError("partition columns can't change")
        new = rows.select(F.col(self.key), *[F.col(c).alias(f"_{c}") for c in values])
        base = self.newest()
        old = self.read(base)
        both = old.join(new, self.key, "left")
        self._write(self.checked(both.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])), base)

    def delete(self, keys: DataFrame) -> None:
        base = self.newest()
        self._write(self.read(base).join(keys.select(self.key), self.key, "left_anti"), base)

    def point(self, key) -> DataFrame:
        return self.read().where(F.col(self.key) == key)

    def drop(self) -> None:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        base.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(base, True)

    def prepare(self, model: str, known: tuple[str, int] | None) -> tuple[str, int]:
        """Empties the table where the embedding model or its dimension changed, so models never mix; returns the new identity."""
        now = (model, self.dimension)
        if known is not None and known != now:
            self._write(self.spark.createDataFrame([], self.schema), self.newest())
        return now

    def search(self, query: Sequence[float] | bytes, k: int, **options) -> DataFrame:
        for c in options.pop("filter_columns", ()):
            if c in self.auxiliary:
                raise ValueError(f"{c} is auxiliary and can't be filtered")
        if self.kind == "bit":
            _check_k(k)
            df = self.read() if options.get("where") is None else self.read().where(options["where"])
            return df.withColumn("distance", V.hamming("embedding", F.lit(bytes(query)))).orderBy(F.asc_nulls_last("distance"), self.key).limit(k).where("distance is not null")
        return knn(self.read(), query, k, self.metric, key=self.key, **options)
