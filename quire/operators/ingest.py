"""Ingest: duplicates, the difference between scan and catalog, the plan of changes, pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.text import parse_file_name

from . import catalog

EXTRACTABLE = ("pdf", "epub", "txt", "md")


def duplicate_groups(files: DataFrame, digest: str = "content_hash", path: str = "path") -> DataFrame:
    """(digest, paths) of contents held more than once, paths in order; by first path. A null digest is no group."""
    groups = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.array_sort(F.collect_list(path)).alias("paths"))
    return groups.where(F.size("paths") > 1).orderBy(F.get("paths", F.lit(0)))


def duplicate_members(files: DataFrame, digest: str = "content_hash", path: str = "path") -> DataFrame:
    """(path): all but the first of each group, a window over digests."""
    n = F.row_number().over(Window.partitionBy(digest).orderBy(path))
    return files.where(F.col(digest).isNotNull()).select(path, n.alias("_n")).where("_n > 1").drop("_n")


def diff(known: DataFrame, scanned: DataFrame, path: str = "path") -> DataFrame:
    """(path, change): added, kept or removed."""
    both = known.select(path).distinct().withColumn("_k", F.lit(True)).join(scanned.select(path).distinct().withColumn("_s", F.lit(True)), path, "full")
    change = F.when(F.col("_k") & F.col("_s"), "kept").when(F.col("_k"), "removed").otherwise("added")
    return both.select(path, change.alias("change"))


def plan(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row for each path: its change, guess and new state. scanned: (path, file_name, content_hash)."""
    copies = duplicate_members(scanned).withColumn("is_copy", F.lit(True))
    rows = diff(known, scanned).join(scanned, "path", "left").join(copies, "path", "left")
    rows = rows.withColumn("guess", parse_file_name("file_name"))
    solid = (F.col("guess.confidence") == "structured") & F.col("guess.author").isNotNull()
    state = catalog.classify(F.coalesce("is_copy", F.lit(False)), F.coalesce(solid, F.lit(False)))
    return rows.select("path", "change", "file_name", "content_hash", "guess", F.when(F.col("change") == "added", state).alias("state"))


def report(planned: DataFrame, unsupported: int = 0) -> DataFrame:
    """The counters of an ingest in one pass."""
    n = lambda c: F.count_if(c)
    added = F.col("change") == "added"
    return planned.agg(
        n(F.col("change") != "removed").alias("scanned"),
        n(added).alias("added"),
        n(F.col("change") == "kept").alias("kept"),
        n(F.col("change") == "removed").alias("removed"),
        *[n(added & (F.col("state.status") == s)).alias(a) for s, a in (("recognized", "recognized"), ("needsReview", "needs_review"), ("duplicateCandidate", "duplicates"))],
        F.lit(unsupported).cast("long").alias("unsupported"),
    )


def new_records(planned: DataFrame, library: str = "") -> dict[str, DataFrame]:
    """Rows of work, creator, work_creator, edition and document for what was added; ids derive from content, so repeating gives the same."""
    added = planned.where("change = 'added'")
    ident = lambda kind, c: F.sha2(F.concat(F.lit(f"{library}:{kind}:"), c), 256)
    base = added.select("*", ident("work", F.col("path")).alias("work_id"), ident("edition", F.col("path")).alias("edition_id"), ident("document", F.col("path")).alias("document_id"))
    author = F.col("guess.author")
    people = base.where(author.isNotNull())
    return {
        "work": base.select("work_id", F.col("guess.title").alias("title"), F.col("guess.year").alias("date"), "state.*"),
        "edition": base.select("edition_id", "work_id", "guess.publisher", "guess.year", "guess.language", "guess.isbn13", "guess.doi", "state.*"),
        "document": base.select("document_id", "edition_id", F.col("path").alias("file_path"), "file_name", "content_hash", "state.*"),
        "creator": people.select(ident("creator", author).alias("creator_id"), author.alias("name")).distinct(),
        "work_creator": people.select("work_id", ident("creator", author).alias("creator_id"), F.lit("author").alias("role"), F.lit(0).alias("position")),
    }


def pending(pages: DataFrame, indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages without a vector yet."""
    return pages.join(indexed.select(*keys), list(keys), "left_anti")


def pending_documents(document: DataFrame) -> DataFrame:
    """Documents to extract, in no order."""
    return document.where(~F.col("is_extracted") & F.col("format").isin(*EXTRACTABLE))


def pending_extraction(document: DataFrame) -> DataFrame:
    """Documents to extract, by file name."""
    return pending_documents(document).orderBy("file_name", "document_id")


#: What goes when the row goes that it names: table, key, named table.
DEPENDENTS = (("document_page", "document_id", "document"), ("annotation", "document_id", "document"), ("edition_creator", "edition_id", "edition"), ("work_creator", "work_id", "work"), ("collection_item", "work_id", "work"))


def cascade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without rows that name a document, edition or work that is gone; a document whose edition is gone stays without one."""
    out = dict(tables)
    for name, key, of in DEPENDENTS:
        if name in out and of in out:
            out[name] = out[name].join(out[of].select(key), key, "left_semi")
    if "document" in out and "edition" in out:
        there = out["edition"].select(F.col("edition_id").alias("_e"))
        docs = out["document"].join(there, F.col("edition_id") == F.col("_e"), "left")
        out["document"] = docs.withColumn("edition_id", F.col("_e")).select(*tables["document"].columns)
    return out


def collect_orphans(tables: dict[str, DataFrame], creators: bool = False) -> dict[str, DataFrame]:
    """The tables without editions that no document names and works that no edition names, and on demand creators that nothing names."""
    out = dict(tables)
    out["edition"] = out["edition"].join(out["document"].select("edition_id").where("edition_id is not null"), "edition_id", "left_semi")
    out["work"] = out["work"].join(out["edition"].select("work_id"), "work_id", "left_semi")
    out = cascade(out)
    if creators:
        named = out["work_creator"].select("creator_id")
        if "edition_creator" in out:
            named = named.union(out["edition_creator"].select("creator_id"))
        out["creator"] = out["creator"].join(named, "creator_id", "left_semi")
    return out


def apply_plan(tables: dict[str, DataFrame], planned: DataFrame, library: str = "") -> dict[str, DataFrame]:
    """The catalog after an ingest: vanished files out, new ones in, orphans collected, folders as collections.

    tables: those of the schema that new_records fills, with any columns beyond
    theirs. Ids derive from content, so applying a plan twice changes nothing. The
    result refers to its inputs several times: pass stored tables and store it.
    """
    out = dict(tables)
    gone = planned.where("change = 'removed'").select(F.col("path").alias("file_path"))
    out["document"] = out["document"].join(gone, "file_path", "left_anti")
    for name, rows in new_records(planned, library).items():
        keys = [c for c in rows.columns if c.endswith("_id")][: 2 if name == "work_creator" else 1]
        fresh = rows.join(out[name].select(*keys), keys, "left_anti")
        out[name] = out[name].unionByName(fresh, allowMissingColumns=True)
    return collect_orphans(out)


def collections(documents: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(collection, collection_item) of the folders between root and each document: (work_id, file_path)."""
    below = F.substring("file_path", len(root.rstrip("/")) + 2, 1 << 30)
    folder = F.regexp_replace(below, "/?[^/]*$", "")
    rows = documents.where(catalog.under("file_path", root)).select("work_id", folder.alias("path")).where("path != ''")
    ident = lambda p: F.sha2(F.concat(F.lit(f"collection:{root}:"), p), 256)
    tree = catalog.subtree_paths(rows).select(ident(F.col("path")).alias("collection_id"), "name", F.when(F.col("parent").isNotNull(), ident(F.col("parent"))).alias("parent_id"), F.concat_ws("/", F.lit(root.rstrip("/")), "path").alias("source_folder"))
    return tree, rows.select(ident(F.col("path")).alias("collection_id"), "work_id").distinct()


def replace_pages(document: DataFrame, document_page: DataFrame, pages: DataFrame, recognized: bool = False, treated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(document, document_page) after an extraction: the documents' pages replaced, marked as extracted.

    treated: the documents (document_id) that were read, be it without a page:
    their old pages go too, and they are marked. Without it they are those of pages.
    recognized: the pages come from character recognition, which is no longer
    needed then; blank pages are left out and numbers kept.
    """
    if recognized:
        pages = pages.where(F.trim("content") != "")
    done = pages.select("document_id")
    done = (done if treated is None else done.unionByName(treated.select("document_id"))).distinct()
    kept = document_page.join(done, "document_id", "left_anti").unionByName(pages.select(*document_page.columns))
    marked = document.join(done.withColumn("_m", F.lit(True)), "document_id", "left")
    new = {"is_extracted": F.coalesce("_m", "is_extracted")}
    if recognized:
        new["needs_ocr"] = F.when(F.col("_m"), False).otherwise(F.col("needs_ocr"))
    return marked.withColumns(new).select(*document.columns), kept
