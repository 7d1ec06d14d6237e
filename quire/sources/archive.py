"""A library as an archive: tables and a manifest, switched at once.

An export writes its tables beside those of the last one and then the manifest
as the folder's newest state, which names them: a job that fails before that
leaves the archive as it was, and readers see one export or the other. Tables of
exports before the last two go.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from quire.operators.catalog import rebase

from .commits import Folder
from .schemas import MIGRATIONS, schema, tables_after

FORMAT = 1


def export(tables: dict[str, DataFrame], folder: str, source_folder: str) -> dict:
    """Writes the tables and then the manifest."""
    spark = next(iter(tables.values())).sparkSession
    store = Folder(spark, folder)
    number, last = store.state()
    at = store.fresh("tables")
    for name, df in tables.items():
        df.write.parquet(store.at(f"{at}/{name}"))
    count = spark.read.parquet(store.at(f"{at}/document")).count() if "document" in tables else 0
    manifest = {"appliedMigrations": [n for n, _ in MIGRATIONS], "documentCount": count, "exportDate": datetime.now(UTC).isoformat(timespec="seconds"), "formatVersion": FORMAT, "sourceFolderPath": source_folder, "tables": sorted(tables), "at": at}
    store.commit(number, manifest)
    for name in store.names("tables"):
        if name not in (at, last.get("at")):
            store.delete(name)
    return manifest


def load(spark: SparkSession, folder: str, source_folder: str | None = None) -> dict[str, DataFrame]:
    """The archive's tables, their paths moved below another source folder where one is given.

    A missing manifest, a later format and unknown migrations are errors.
    """
    store = Folder(spark, folder)
    manifest = store.state()[1]
    if not manifest:
        raise FileNotFoundError(f"{folder} holds no archive")
    folder = store.at(manifest["at"])
    if manifest["formatVersion"] > FORMAT:
        raise ValueError(f"the archive has format {manifest['formatVersion']}, known is {FORMAT}")
    known = tables_after(manifest["appliedMigrations"])
    out = {n: spark.read.schema(schema(n)).parquet(f"{folder}/{n}") if n in known else spark.read.parquet(f"{folder}/{n}") for n in manifest["tables"]}
    if source_folder is not None:
        old = manifest["sourceFolderPath"]
        for name, column in (("document", "file_path"), ("source_folder", "path"), ("collection", "source_folder")):
            if name in out and column in out[name].columns:
                out[name] = out[name].withColumn(column, rebase(column, old, source_folder))
    return out
