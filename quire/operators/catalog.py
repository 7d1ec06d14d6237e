"""The catalog: search, overview, statistics, membership, trees; and its changes.

Tables follow the logical schema in quire.sources.schemas. Changes are functions
from tables to tables; writing them is the caller's step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import blank_to_null, stem

STATUSES = ("recognized", "needsReview", "duplicateCandidate", "ignored")
NO_AUTHOR = "￿"


def names_in_order(position: str = "position", name: str = "name") -> Column:
    """The names of a group by position, as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position, name))), lambda x: x[name])


def authors_by_work(work_creator: DataFrame, creator: DataFrame) -> DataFrame:
    """(work_id, authors) by position; every role counts."""
    return work_creator.join(creator, "creator_id").groupBy("work_id").agg(names_in_order().alias("authors"))


def contains_folded(column: Column, query: str) -> Column:
    """Substring test that folds the case of ASCII letters; what the user types holds no wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(column, upper, lower), F.lit(query.translate(str.maketrans(upper, lower))))


def matching_works(work: DataFrame, work_creator: DataFrame, creator: DataFrame, query: str) -> DataFrame:
    """Works whose title, subtitle or any author contains the query, in no order; all works for a blank one.

    The matching authors come first: the join is then a semi-join on their works.
    """
    query = query.strip()
    if not query:
        return work
    by_author = work_creator.join(creator.where(contains_folded(F.col("name"), query)), "creator_id").select("work_id").distinct()
    own = contains_folded(F.col("title"), query)
    if "subtitle" in work.columns:
        own = own | F.coalesce(contains_folded(F.col("subtitle"), query), F.lit(False))
    return work.join(by_author.withColumn("_by", F.lit(True)), "work_id", "left").where(own | F.col("_by")).drop("_by")


def search_works(work: DataFrame, work_creator: DataFrame, creator: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The first of matching_works by title."""
    return matching_works(work, work_creator, creator, query).orderBy("title", "work_id").limit(limit)


def overview(document: DataFrame, edition: DataFrame, work: DataFrame, authors: DataFrame) -> DataFrame:
    """Documents with edition and work, by first author, title and year; documents without an edition are left out."""
    rows = document.join(edition, "edition_id").join(work, "work_id").join(authors, "work_id", "left")
    return rows.orderBy(F.coalesce(F.get("authors", F.lit(0)), F.lit(NO_AUTHOR)), "title", F.coalesce("year", F.lit("")), "document_id")


def stats(document: DataFrame, status: str = "status") -> DataFrame:
    """Total and the counts of three statuses, in one pass."""
    return document.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(n) for s, n in (("recognized", "recognized"), ("needsReview", "needs_review"), ("duplicateCandidate", "duplicates"))])


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def membership(items: DataFrame, work: str = "work_id", collection: str = "collection_id") -> DataFrame:
    return items.groupBy(work).agg(F.array_sort(F.collect_set(collection)).alias("collections"))


def orphans(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parents that no child names; null names count for none."""
    return parent.join(child.select(key), key, "left_anti")


def orphan_creators(creator: DataFrame, work_creator: DataFrame, edition_creator: DataFrame) -> DataFrame:
    return orphans(orphans(creator, work_creator, "creator_id"), edition_creator, "creator_id")


def subtree_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, parent, name, depth) of every folder on the way to each path; parent is null at the top."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.nullif(F.array_join(F.slice(parts, 1, n - 1), "/"), F.lit("")).alias("parent"), F.get(parts, n - 1).alias("name"), n.alias("depth")))).alias("s"))
    return steps.select("s.*").where("name is not null").distinct()


def _doubled(rows: DataFrame, folder: str, most: int, rounds: list | None = None) -> DataFrame:
    """rows (id, up[, path, depth]) after each pointer was followed as far as it goes, or for so many rounds: a table below folder for each."""
    spark, k = rows.sparkSession, 0
    while True:
        rows.write.parquet(f"{folder}/{k}")
        rows = spark.read.parquet(f"{folder}/{k}")
        still = rows.where("up is not null").count()
        if not still or k >= most:
            return rows
        k += 1
        if rounds is not None:
            rounds.append(still)
        above = rows.select([F.col(c).alias(f"_{c}") for c in rows.columns])
        both = rows.where("up is not null").join(above, F.col("up") == F.col("_id"))
        more = [F.concat_ws("/", "_path", "path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth")] if "path" in rows.columns else []
        rows = rows.where("up is null").unionByName(both.select("id", F.col("_up").alias("up"), *more))


def walk(nodes: DataFrame, folder: str, rounds: list | None = None) -> DataFrame:
    """(id, path, depth, is_cyclic) of nodes (id, parent, name): names from the top down, by pointer doubling.

    Each round joins every node to the one that it points to and takes over its
    path and its pointer, so a pointer spans twice as many levels as before, and
    the rounds, each a table below the new folder, are the logarithm of the depth. A
    parent that isn't there makes a root. What stands on a cycle or below one
    still points somewhere after as many rounds as the number of nodes allows;
    that is found out by pointers alone, before paths are made, and such nodes
    have none. rounds, if given, gets the number of open pointers of each.
    """
    known = nodes.select(F.col("id").alias("_there"))
    rows = nodes.join(known, F.col("parent") == F.col("_there"), "left").select("id", F.col("_there").alias("up"), F.col("name").alias("path"), F.lit(1).alias("depth"))
    ends = _doubled(rows.select("id", "up"), f"{folder}/ends", nodes.count().bit_length() + 1)
    cyclic = ends.where("up is not null").select("id")
    paths = _doubled(rows.join(cyclic, "id", "left_anti"), f"{folder}/paths", 64, rounds)
    none = cyclic.select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("depth"), F.lit(True).alias("is_cyclic"))
    return paths.select("id", "path", "depth", F.lit(False).alias("is_cyclic")).unionByName(none)


def under(path: Column | str, root: str) -> Column:
    """Whether a path is the root or below it; the root's own characters are no wildcards."""
    c = F.col(path) if isinstance(path, str) else path
    root = root.rstrip("/")
    return (c == root) | F.startswith(c, F.lit(root + "/"))


def rebase(path: Column | str, old: str, new: str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(under(c, old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)


def reading_order(annotations: DataFrame, page: str = "page", created: str = "date_created", *ties: str, document: str = "document_id") -> DataFrame:
    """annotations with their place in the reading of their document: by page, those without one last, then as they were made."""
    order = Window.partitionBy(document).orderBy(F.asc_nulls_last(page), created, *ties)
    return annotations.withColumn("place", F.row_number().over(order))


# Changes of curation state.


def classify(is_duplicate: Column, is_solid: Column) -> Column:
    """(status, confidence) of a newly ingested document; being a copy comes first."""
    state = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    return F.when(is_duplicate, state("duplicateCandidate", "low")).when(is_solid, state("recognized", "probable")).otherwise(state("needsReview", "low"))


def set_status(document: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The status of the listed documents; confidence becomes high only with `recognized`."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    marked = document.join(ids.select("document_id").distinct().withColumn("_m", F.lit(True)), "document_id", "left")
    new = {"status": F.when(F.col("_m"), status).otherwise(F.col("status"))}
    if status == "recognized":
        new["confidence"] = F.when(F.col("_m"), "high").otherwise(F.col("confidence"))
    return marked.withColumns(new).drop("_m").select(*document.columns)


def _overwritten(edition: DataFrame, changes: DataFrame, fields: tuple[str, ...], confidence: str) -> DataFrame:
    new = changes.select("edition_id", F.lit(True).alias("_m"), *[blank_to_null(c).alias(f"_{c}") for c in fields])
    both = edition.join(new, "edition_id", "left")
    values = {c: F.when(F.col("_m"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    values |= {"status": F.when(F.col("_m"), "recognized").otherwise(F.col("status")), "confidence": F.when(F.col("_m"), confidence).otherwise(F.col("confidence"))}
    return both.withColumns(values).select(*edition.columns)


def edit(edition: DataFrame, changes: DataFrame) -> DataFrame:
    """A person's edit: year, publisher, language and ISBN are overwritten, even by nothing; sure from then on."""
    return _overwritten(edition, changes, ("year", "publisher", "language", "isbn13"), "high")


def accept(edition: DataFrame, proposals: DataFrame) -> DataFrame:
    """A validated proposal: as an edit, the DOI too, but only where nobody has been sure before."""
    free = proposals.join(edition.where("confidence != 'high'").select("edition_id"), "edition_id", "left_semi")
    return _overwritten(edition, free, ("year", "publisher", "language", "isbn13", "doi"), "probable")


def merge(document: DataFrame, ids: DataFrame, edition_id: str) -> DataFrame:
    """All listed documents move to one edition, recognized and sure."""
    marked = document.join(ids.select("document_id").distinct().withColumn("_m", F.lit(True)), "document_id", "left")
    new = {"edition_id": F.when(F.col("_m"), edition_id).otherwise(F.col("edition_id")), "status": F.when(F.col("_m"), "recognized").otherwise(F.col("status")), "confidence": F.when(F.col("_m"), "high").otherwise(F.col("confidence"))}
    return marked.withColumns(new).select(*document.columns)


def detach(document: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document, new editions, new works): listed documents get a work and an edition named by their file."""
    marked = document.join(ids.select("document_id").distinct().withColumn("_m", F.lit(True)), "document_id", "left")
    own = F.sha2(F.concat(F.lit("edition:"), F.col("document_id").cast("string")), 256)
    new = marked.where("_m").select("document_id", own.alias("edition_id"), F.sha2(F.concat(F.lit("work:"), F.col("document_id").cast("string")), 256).alias("work_id"), stem(F.col("file_name")).alias("title"))
    state = {"status": F.lit("needsReview"), "confidence": F.lit("low")}
    moved = marked.withColumns({"edition_id": F.when(F.col("_m"), own).otherwise(F.col("edition_id"))} | {c: F.when(F.col("_m"), v).otherwise(F.col(c)) for c, v in state.items()}).select(*document.columns)
    return moved, new.select("edition_id", "work_id").withColumns(state), new.select("work_id", "title").withColumns(state)


def upsert_annotations(annotations: DataFrame, rows: DataFrame) -> DataFrame:
    """Annotations with rows put in place of those of the same id; what is put in is modified now, and created now where it isn't known when."""
    now = F.current_timestamp()
    stamps = {"date_created": F.coalesce("date_created", now) if "date_created" in rows.columns else None, "date_modified": now}
    rows = rows.withColumns({c: v for c, v in stamps.items() if c in annotations.columns and v is not None})
    return annotations.join(rows.select("annotation_id"), "annotation_id", "left_anti").unionByName(rows)


def first_of_group(df: DataFrame, group: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(order))
