"""The operators as queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, elkan, langid, merkle, mixing, neardup, repeats, secrets, sstable, tokencount, toxicity, transport, urlfilter
from .common import table


#: The curated rules of the query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = transport.store_text(table(spark, sf_dir, "documents"))
    read = transport.read_media(media)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        transport.feature().alias("feature"),
    )


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mixing.poisson_mix(documents, mixing.root_weights(documents))
    return mixed.select("doc_id", "text", "source", F.round("rate", 6).alias("rate"), "n_copies", "copy", "shuffle_key")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    return decontaminate.contamination(decontaminate.find_items(index, table(spark, sf_dir, "benchmark")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_spans(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(documents.where(~F.col("held_out")))
    return langid.identify(documents, model, keep=("held_out",))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=85)


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = sstable.write_shards(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return sstable.read_shards(spark, folder, shards).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and its proofs against rows of which a third is tampered with: A-Z of their texts lower-cased."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    seen = merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS[:-1]], changed)
    rows = merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), keep={"seen": seen}))
    rows = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.fold(F.col("seen")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out())
    labels = toxicity.labelled(table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(documents, toxicity.train(documents.where(~F.col("held_out")), labels), keep=("doc_id", "held_out"))


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elkan.with_totals(*elkan.cluster(table(spark, sf_dir, "embeddings")))
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_transport, op3_poisson_mix, op4_decontaminate, op5_repeats, op6_secrets, op7_token_counts, op8_language, op9_superminhash, op10_sstable, op11_merkle, op12_toxicity, op13_elkan)}

ORACLES: dict[str, str] = {"op3_poisson_mix": mixing.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op5_repeats": repeats.ORACLE, "op9_superminhash": neardup.oracle(3, 85), "op11_merkle": merkle.ORACLE, "op13_elkan": elkan.oracle()}
