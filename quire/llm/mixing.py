"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate: its target share of the total size over
its present share. A document's number of copies inverts the Poisson
distribution of that mean at a number in [0, 1) hashed from seed and key, so it
depends on nothing else and comes out the same at every run and partitioning.
The document is exploded by its count and all copies are shuffled globally by a
second hash, with the number of the row beside it, so that rows with null or
equal keys don't meet in one partition.

The table of rates has a row for each source. It is written and read again, so
Spark knows its size when it plans the join: small ones are broadcast, others
sort-merge joined, where adaptive execution splits a hot source. A rate beyond
PART is split into equal parts whose counts are drawn independently and added,
which is exact for this distribution.

Defined cases: a null source is a source of its own; a null text has size 0; a
source of size 0, or without a weight, or with a weight of 0 is left out; a
null key hashes as the word null; rows with equal keys get equal counts; the
texts move whole; an empty table gives an empty result; all columns of the
input are kept, and one that has the name of an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Largest rate whose distribution is inverted in one piece.
PART = 500.0
#: Hex digits of the hash that make a number: 52 bits, exact as a double.
DIGITS = 13
SEED = "mix-1"


def hashed(*parts: Column) -> Column:
    """A whole number below 2**52 from the MD5 of the parts, joined by colons."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, DIGITS), 16, 10).cast("long")


def root_weights(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Weights (source, weight) that go with the square root of a source's size in characters."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("double")
    return df.groupBy(F.col(source).alias("source")).agg(F.sqrt(F.sum(size)).alias("weight"))


def rates(df: DataFrame, weights: DataFrame, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate, parts, cdf): the mean repetitions of each source and the distribution of one part."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("double")
    sizes = stored(df.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size")).where("size > 0"))
    weights = weights.select(F.col("source").alias("_w"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
    both = sizes.join(weights, F.col("source").eqNullSafe(F.col("_w"))).drop("_w")
    total, all_weights = both.agg(F.coalesce(F.sum("size"), F.lit(1.0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    rate = F.lit(epochs) * (F.col("weight") / F.lit(all_weights)) * F.lit(total) / F.col("size")
    out = both.select("source", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    out = out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step, lambda s: s["cdf"]))
    return out.select("source", "rate", "parts", "cdf")


def poisson_mix(df: DataFrame, weights: DataFrame, epochs: float = 1.0, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df's rows, each as often as its source's rate says, in a random order.

    Adds rate, n_copies, copy (from 1) and shuffle_key, by which the rows are
    dealt to partitions at random and sorted in each: the partitions in turn
    are a random order of all rows.
    """
    own = ("_mix_source", "_mix_rate", "_mix_parts", "_mix_cdf")
    table = stored(rates(df, weights, epochs, source, text).toDF(*own))
    rows = df.drop("rate", "n_copies", "copy", "shuffle_key", "_mix_row", *own).withColumn("_mix_row", F.monotonically_increasing_id())
    rows = rows.join(table, F.col(source).eqNullSafe(F.col("_mix_source")))
    unit = lambda i: hashed(F.lit(seed), F.col(key), i) / F.lit(float(1 << 4 * DIGITS))
    # Through an array of one, so that the hash is computed once for each part.
    one = lambda i: F.get(F.transform(F.array(unit(i)), lambda u: F.size(F.filter("_mix_cdf", lambda c: c <= u))), F.lit(0))
    count = F.aggregate(F.sequence(F.lit(0), F.col("_mix_parts") - 1), F.lit(0), lambda n, i: n + one(i))
    rows = rows.withColumns({"rate": F.col("_mix_rate"), "n_copies": count}).where("n_copies > 0").drop(*own)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", hashed(F.lit(seed), F.col(key), F.col("copy"), F.lit("order")))
    return rows.repartition("shuffle_key", "_mix_row").drop("_mix_row").sortWithinPartitions("shuffle_key", key, "copy")


#: DuckDB SQL for poisson_mix with root_weights, without the texts.
ORACLE = f"""
WITH sizes AS (SELECT source, sum(CAST(coalesce(length(text), 0) AS DOUBLE)) AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, sqrt(size) AS weight FROM sizes WHERE size > 0),
total AS (SELECT sum(size) AS total, sum(weight) AS all_weights FROM weighed),
rate AS (SELECT source, (weight / all_weights) * total / size AS rate FROM weighed, total),
pmf AS (SELECT source, rate, k, exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - lgamma(k + 1)) AS p
        FROM rate, range(0, 200) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
doc AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0'), 1, {DIGITS}) AS BIGINT) / {1 << 4 * DIGITS}.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, c.rate, CAST(count(*) FILTER (WHERE c.c <= d.u) AS INTEGER) AS n_copies
            FROM doc d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, source, round(rate, 6) AS rate, n_copies, CAST(copy AS INTEGER) AS "copy",
       CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy || ':order'), 1, {DIGITS}) AS BIGINT) AS shuffle_key
FROM counted, range(1, 200) r(copy) WHERE copy <= n_copies
"""
