"""Vector queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import vector as V
from quire.operators import knn as K
from quire.operators.pruned import CodeTable, PivotTable

from .registry import query, scratch, table

IDS = tuple(range(0, 400, 7))
PAIRS = "SELECT a.vec_id, unnest(range(0, 64)) AS pos, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One row, found by its key."""
    row = embeddings(spark, d).where(F.col("vec_id") == vec_id).select("embedding").first()
    return row[0]


def _knn_sql(distance: str, where: str = "true", having: str = "true", k: int = 10) -> str:
    return f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, round({distance}, 4) + 0.0 AS distance FROM embeddings, q WHERE {where})
SELECT vec_id, distance FROM d WHERE {having} ORDER BY distance, vec_id LIMIT {k}"""


def _sum(term: str) -> str:
    return f"list_sum(list_transform(list_zip(embedding, q), lambda p: {term}))"


L2 = f"sqrt({_sum('(p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)')})"
L1 = _sum("abs(p[1]::DOUBLE - p[2]::DOUBLE)")
COSINE = f"1 - {_sum('p[1]::DOUBLE * p[2]::DOUBLE')} / (sqrt({_sum('p[1]::DOUBLE * p[1]::DOUBLE')}) * sqrt({_sum('p[2]::DOUBLE * p[2]::DOUBLE')}))"
HAMMING = _sum("CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END")


def _near(spark: SparkSession, d: str, **options) -> DataFrame:
    return K.knn(embeddings(spark, d), query_vector(spark, d), 10, decimals=4, **options).select("vec_id", "distance")


@query(_knn_sql(L2))
def knn_l2(spark, d):
    return _near(spark, d)


@query(_knn_sql(L1))
def knn_l1(spark, d):
    return _near(spark, d, metric="l1")


@query(_knn_sql(COSINE))
def knn_cosine(spark, d):
    return _near(spark, d, metric="cosine")


@query(f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, CAST({HAMMING} AS INTEGER) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""")
def knn_hamming(spark, d):
    bits = V.quantize_binary(F.array(*[F.lit(x) for x in query_vector(spark, d)]))
    return embeddings(spark, d).select("vec_id", V.hamming(V.quantize_binary("embedding"), bits).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query(_knn_sql(L2, where="label = 3"))
def knn_metadata_filter(spark, d):
    return _near(spark, d, where=F.col("label") == 3)


@query(_knn_sql(L2, where="label > 5 AND label <> 7"))
def knn_partition(spark, d):
    """A stored table with partitions, of which those that the predicate excludes aren't read."""
    t = K.VectorTable(spark, scratch(spark), 64, key="vec_id bigint", partition=["label int"])
    t.upsert(embeddings(spark, d).select("vec_id", "embedding", F.col("label").cast("int").alias("label")))
    return t.search(query_vector(spark, d), 10, decimals=4, where=(F.col("label") > 5) & (F.col("label") != 7)).select("vec_id", "distance")


@query(_knn_sql(L2, where="vec_id IN (SELECT doc_id FROM documents WHERE lang > 'de' AND lang <> 'fr' AND source >= 'src1')"))
def knn_text_metadata(spark, d):
    """Text metadata, compared in plain byte order."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    own = embeddings(spark, d).join(docs, "vec_id")
    near = K.knn(own, query_vector(spark, d), 10, decimals=4, where=(F.col("lang") > "de") & (F.col("lang") != "fr") & (F.col("source") >= "src1"))
    return near.select("vec_id", "distance")


@query(_knn_sql(L2, where=f"vec_id IN ({', '.join(map(str, IDS))})"))
def knn_rowid_in(spark, d):
    return _near(spark, d, ids=IDS)


@query(_knn_sql(L2, where="vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_ids_table(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return _near(spark, d, ids=good)


@query(_knn_sql(L2, having="distance > 0.5 AND distance <= 10.0"))
def knn_distance_range(spark, d):
    return _near(spark, d, distance_range=[(">", 0.5), ("<=", 10.0)])


_BATCH = """
WITH d AS (SELECT q.vec_id AS query_id, b.vec_id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 4) AS distance
           FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _queries(base: DataFrame) -> DataFrame:
    return base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_BATCH)
def knn_batch(spark, d):
    base = embeddings(spark, d)
    return K.knn_batch(_queries(base), base, 10, decimals=4)


@query(_BATCH)
def knn_pivots(spark, d):
    """The same from a stored table in parts around pivots, of which only those are read that may hold a neighbour."""
    base = embeddings(spark, d)
    near = PivotTable(spark, scratch(spark))
    near.build(base)
    return near.search(_queries(base), 10, decimals=4)


@query(_BATCH)
def knn_codes(spark, d):
    """The same from stored int8 codes, with distances computed only where these leave it open."""
    base = embeddings(spark, d)
    coded = CodeTable(spark, scratch(spark))
    coded.build(base)
    return coded.search(_queries(base), 10, decimals=4)


@query("SELECT vec_id, label FROM embeddings")
def vector_scan(spark, d):
    return embeddings(spark, d).select("vec_id", "label")


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS length FROM embeddings WHERE vec_id = 17")
def vector_point(spark, d):
    return embeddings(spark, d).where("vec_id = 17").select("vec_id", "label", V.length("embedding").alias("length"))


def _pairs(spark, d) -> DataFrame:
    """Every vector with the next: (vec_id, x, y)."""
    e = embeddings(spark, d)
    left = e.select("vec_id", F.col("embedding").alias("x"))
    return left.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


def _spread(df: DataFrame, value) -> DataFrame:
    return df.select("vec_id", F.posexplode(value).alias("pos", "value"))


@query(f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(x[pos + 1] + y[pos + 1] AS DOUBLE), 5) AS value FROM ({PAIRS})")
def vec_add(spark, d):
    return _spread(_pairs(spark, d), V.add("x", "y")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query(f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(x[pos + 1] - y[pos + 1] AS DOUBLE), 5) AS value FROM ({PAIRS})")
def vec_sub(spark, d):
    return _spread(_pairs(spark, d), V.sub("x", "y")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("""SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((embedding[pos + 1]::DOUBLE / n)::FLOAT::DOUBLE, 5) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS pos, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings)""")
def vec_normalize(spark, d):
    """The elements are single-precision numbers, as those of the vectors are."""
    return _spread(embeddings(spark, d), V.normalize("embedding")).withColumn("value", F.round(F.col("value").cast("double"), 5) + 0.0)


@query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(embedding[pos + 9] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(0, 16)) AS pos FROM embeddings)")
def vec_slice(spark, d):
    return _spread(embeddings(spark, d), V.slice_of("embedding", 8, 24)).withColumn("value", F.col("value").cast("double"))


@query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(embedding[pos + 1] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS pos FROM embeddings)")
def vec_each(spark, d):
    return _spread(embeddings(spark, d), F.col("embedding")).withColumn("value", F.col("value").cast("double"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS length, 'float32' AS type FROM embeddings")
def vec_length(spark, d):
    e = embeddings(spark, d)
    return e.select("vec_id", V.length("embedding").alias("length"), F.lit(V.type_name(dict(e.dtypes)["embedding"])).alias("type"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda v: printf('%.6f', v::DOUBLE)), ',') || ']' AS json FROM embeddings")
def vec_to_json(spark, d):
    return embeddings(spark, d).select("vec_id", V.to_json("embedding").alias("json"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: round(v::DOUBLE, 6))), 4) AS total FROM embeddings")
def vec_from_json(spark, d):
    back = V.from_json(V.to_json("embedding", half_up=True), "double")
    return embeddings(spark, d).select("vec_id", F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(greatest(-128, least(127, trunc((embedding[pos + 1]::DOUBLE + 1.0) / (2.0 / 255.0) - 128.0))) AS INTEGER) AS value
FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS pos FROM embeddings)""")
def quantize_int8(spark, d):
    return _spread(embeddings(spark, d), V.quantize_int8("embedding")).withColumn("value", F.col("value").cast("int"))


@query("""SELECT vec_id, string_agg(printf('%02X', CAST(byte AS INTEGER)), '' ORDER BY b) AS bits FROM (
SELECT vec_id, b, sum(CASE WHEN embedding[b * 8 + j + 1] > 0 THEN 1 << j ELSE 0 END) AS byte
FROM (SELECT vec_id, embedding, b, unnest(range(0, 8))::INTEGER AS j FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS b FROM embeddings)) GROUP BY vec_id, b) GROUP BY vec_id""")
def quantize_binary(spark, d):
    return embeddings(spark, d).select("vec_id", F.hex(V.quantize_binary("embedding")).alias("bits"))


@query("""SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(embedding[pos + 1]::DOUBLE), 5) + 0.0 AS mean
FROM (SELECT label, embedding, unnest(range(0, 64)) AS pos FROM embeddings) GROUP BY label, pos""")
def centroid_by_label(spark, d):
    return K.centroids(embeddings(spark, d)).withColumn("mean", F.round("mean", 5) + 0.0)


@query("""WITH m AS (SELECT label, pos, avg(embedding[pos + 1]::DOUBLE) AS mean FROM (SELECT label, embedding, unnest(range(0, 64)) AS pos FROM embeddings) GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM m GROUP BY label)
SELECT label, CAST(pos AS INTEGER) AS pos, round(mean / size, 4) + 0.0 AS value FROM m JOIN n USING (label)""")
def mean_pool(spark, d):
    pooled = K.mean_pool(embeddings(spark, d), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4) + 0.0)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings WHERE vec_id % 7 <> 0")
def vector_upsert(spark, d):
    """A stored table: rows go in, known keys are replaced, the last of a key wins, some keys go again."""
    t = K.VectorTable(spark, scratch(spark), 64, key="vec_id bigint", metadata=["label int"])
    e = embeddings(spark, d).select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    t.upsert(e)
    changed = e.where("vec_id % 3 = 0").withColumn("n", F.explode(F.array(F.lit(50), F.lit(100))))
    t.upsert(changed.withColumn("label", F.col("label") + F.col("n")), order=F.col("n"))
    t.delete(e.where("vec_id % 7 = 0").select("vec_id"))
    return t.read().select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("""SELECT vec_id, list_sum(list_transform(embedding, lambda v: CAST(greatest(-128, least(127, trunc(v::DOUBLE * 10))) AS BIGINT))) AS total FROM embeddings""")
def vec_construct_int8(spark, d):
    """int8 vectors from JSON text; numbers out of range are errors."""
    text = F.to_json(F.transform("embedding", lambda v: F.greatest(F.lit(-128), F.least(F.lit(127), (v.cast("double") * 10).cast("int")))))
    return embeddings(spark, d).select("vec_id", F.aggregate(V.int8(text), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:16], lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), ',') || ']' AS bits FROM embeddings")
def vec_construct_bit(spark, d):
    """Bit vectors from bytes, shown as JSON, lowest bit first."""
    raw = V.quantize_binary(F.slice("embedding", 1, 16))
    return embeddings(spark, d).select("vec_id", V.bits_to_json(V.bit(raw)).alias("bits"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS size FROM embeddings")
def vector_sql_functions(spark, d):
    """The functions registered for SQL."""
    V.register(spark)
    embeddings(spark, d).createOrReplaceTempView("quire_vectors")
    return spark.sql("SELECT vec_id, round(sqrt(vector_dot(embedding, embedding)), 5) AS size FROM quire_vectors")
