"""The corpus pipeline: from documents to mixed, deduplicated and clean token shards.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents. Stages that remove rows tell them apart by an
identifier of their own, stored with the rows, so null and repeated doc_ids are
judged row by row. The defined cases of each stage are those of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm import decontaminate, langtables, mixing, neardup, sstable
from quire.llm.common import scratch, shared_folder, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a unique _row, stored so that it stays the same however often it is read."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))


def without(docs: DataFrame, judged: Callable[[], DataFrame]) -> DataFrame:
    """Numbered docs without the rows that judged() names.

    These are written first, so that the join is planned by their size; what was
    stored to find them goes then.
    """
    path = shared_folder(docs.sparkSession)
    with scratch():
        rows = stored(judged(), path=path)
    return docs.join(rows, "_row", "left_anti").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels show, and that language where a row has none.

    All labelled documents make the model and say how familiar a text of a known
    language is, each judged by those of the other folds. Documents without
    letters go, and those far less familiar than the labelled ones are: other
    languages, random letters. A low score alone is no ground, as a clean text of
    one new word has it too, and texts under five words are never called
    unfamiliar. Where nothing is labelled there is no model to judge by, and all stay.
    """
    docs = numbered(docs)
    judged = langtables.judge(docs, "_row")
    if judged is None:
        return docs.select(*COLUMNS)
    gone = (F.col("words") == 0) | (F.col("enough") & (F.col("known") < langtables.usual(judged)))
    changed = stored(judged.select("_row", gone.alias("gone"), "lang_pred").where("gone OR lang_pred IS NOT NULL"))
    kept = docs.join(changed, "_row", "left").where("gone IS NULL OR NOT gone")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id, nulls last: five words, similarity 0.8."""
    docs = numbered(docs)
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("key"), "text")
    return without(docs, lambda: neardup.near_duplicates(keyed, key="key").where("NOT kept").select("key._row"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't contain benchmark passages: one window of an item is enough, however long the document."""
    docs = numbered(docs)

    def judged() -> DataFrame:
        found = decontaminate.find_items(decontaminate.build_index(docs, key="_row"), table(spark, sf_dir, "benchmark"))
        return decontaminate.contamination(found, key="_row").where("n_hit > 0").select("_row")

    return without(docs, judged)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight says, in random order."""
    return mixing.poisson_mix(docs, mixing.root_weights(docs)).select(*COLUMNS)


def places(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs and the place of each row in the order of their files: part, file of a part, row. Other tables are stored first, in the order that they have."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema
    except AnalysisException:
        return numbered(docs), F.col("_row")
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    return docs, F.shiftleft(number(r"part-(\d+)"), 43) + F.shiftleft(number(r"\.c(\d+)"), 33) + F.col("_metadata.row_index")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, in the order of the mix, read back from their files.

    A row's key is its place in the mix, so its copies stay as far apart as that
    has dealt them. Beside the shards lies the table `places` (doc_id, lang, place),
    by which the entries of a document or of a language are found; lang is what the
    language stage has found, and the result has it too.
    """
    docs, place = places(docs)
    folder, shards = sstable.write_shards(docs.select(place.alias("place"), "text"), "byte_bpe_50k.json", key="place")
    docs.select("doc_id", "lang", place.alias("place")).write.parquet(f"{folder}/places")
    read = sstable.read_shards(spark, folder, shards).withColumnRenamed("key", "place")
    return read.join(spark.read.parquet(f"{folder}/places"), "place").select("doc_id", "lang", "place", "start", "n_tokens", "ids_crc32", "shard")


STAGES = [("language_id", language_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mix", mix_stage), ("token_shards", shard_stage)]

#: SQL can't express language scores and tokens; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. What a stage has stored on its way goes as soon as its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark)
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch():
            docs = stored(stage(spark, docs, sf_dir), path=path)
    return docs
