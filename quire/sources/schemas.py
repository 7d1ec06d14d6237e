"""The tables of a library and their versions.

Identifiers are strings; years and dates are text, as sources give them.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STATE = "status string NOT NULL, confidence string NOT NULL"

#: Schema of each table, as Spark DDL.
TABLES = {
    "creator": "creator_id string NOT NULL, name string NOT NULL, sort_name string",
    "work": f"work_id string NOT NULL, title string NOT NULL, subtitle string, original_language string, date string, discipline string, notes string, {_STATE}",
    "work_creator": "work_id string NOT NULL, creator_id string NOT NULL, role string, position int NOT NULL",
    "edition": f"edition_id string NOT NULL, work_id string NOT NULL, title string, publisher string, year string, language string, isbn13 string, doi string, {_STATE}",
    "edition_creator": "edition_id string NOT NULL, creator_id string NOT NULL, role string, position int NOT NULL",
    "document": f"document_id string NOT NULL, edition_id string, file_path string NOT NULL, file_name string NOT NULL, file_size bigint NOT NULL, content_hash string, format string NOT NULL, date_added timestamp NOT NULL, needs_ocr boolean NOT NULL, is_extracted boolean NOT NULL, {_STATE}",
    "collection": "collection_id string NOT NULL, name string NOT NULL, parent_id string, source_folder string",
    "collection_item": "collection_id string NOT NULL, work_id string NOT NULL",
    "source_folder": "folder_id string NOT NULL, path string NOT NULL, date_added timestamp NOT NULL",
    "document_page": "document_id string NOT NULL, page_number int NOT NULL, content string NOT NULL",
    "annotation": "annotation_id string NOT NULL, document_id string NOT NULL, page int, cfi string, quote string NOT NULL, prefix string, suffix string, note string, color string, project_id string, date_created timestamp NOT NULL, date_modified timestamp NOT NULL",
}
#: Migrations in order, each with the tables that it adds.
MIGRATIONS = (
    ("1_ontology", ("creator", "work", "work_creator", "edition", "edition_creator", "document", "collection", "collection_item", "source_folder")),
    ("2_pages", ("document_page",)),
    ("3_annotations", ("annotation",)),
)
#: Values of the columns that hold one of a few words.
VALUES = {
    "status": ("recognized", "needsReview", "duplicateCandidate", "ignored"),
    "confidence": ("high", "probable", "low"),
    "format": ("pdf", "epub", "mobi", "azw3", "djvu", "txt", "md", "docx", "rtf"),
    "role": ("author", "translator", "editor", "prefacer", "commentator"),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def tables_after(applied: list[str]) -> list[str]:
    """Tables that exist once the named migrations have run; unknown names are errors."""
    known = dict(MIGRATIONS)
    if unknown := sorted(set(applied) - known.keys()):
        raise ValueError(f"unknown migrations: {', '.join(unknown)}")
    return [t for name, tables in MIGRATIONS if name in applied for t in tables]


def pending_migrations(applied: list[str]) -> list[str]:
    return [name for name, _ in MIGRATIONS if name not in applied]
