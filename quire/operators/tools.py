"""The tools that an assistant may call on a library; arguments and results are text."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from . import catalog, fulltext

HITS, PAGE_CHARS = 8, 4_000

# The reserved names of tools, those of the first version before the others.
FIRST_NAMES = ("search_catalog", "search_fulltext", "semantic_search", "read_page", "open_document", "create_artifact", "propose_metadata")
LATER_NAMES = ("create_link", "list_annotations", "read_memory", "write_memory")


class Answer(NamedTuple):
    """What a call gives back: a text, and what an interface is asked to do, which nothing here does."""

    text: str
    command: dict | None = None


class Toolbox:
    """Dispatches calls by name. pages: (document_id, page_number, content); documents: (document_id, title, status[, authors array])."""

    def __init__(self, pages: DataFrame, documents: DataFrame):
        self.pages, self.documents = pages, documents
        self.tools: dict[str, Callable[[dict], Answer]] = {"search_library": self._search, "read_page": self._read, "open_document": self._open, "library_stats": self._stats}

    def call(self, name: str, arguments: str) -> Answer:
        """Unknown tools and wrong arguments are answers too, so that the caller can mend them."""
        if name not in self.tools:
            return Answer(f"unknown tool: {name}")
        try:
            given = json.loads(arguments or "{}")
        except ValueError:
            return Answer("the arguments aren't JSON")
        if not isinstance(given, dict):
            return Answer("the arguments must be an object")
        try:
            return self.tools[name](given)
        except (KeyError, TypeError, ValueError) as e:
            return Answer(f"missing or wrong argument: {e}")

    def execute(self, name: str, arguments: str) -> str:
        return self.call(name, arguments).text

    def _search(self, given: dict) -> Answer:
        query = given["query"]
        if not isinstance(query, str):
            raise TypeError("query must be text")
        keys, named = list(fulltext.PASSAGE), self.documents
        if "authors" not in named.columns:
            named = named.withColumn("authors", F.array().cast("array<string>"))
        best = fulltext.bm25(self.pages, query, None, keys, "content").join(named.select("document_id", "title", "authors"), "document_id").orderBy(F.desc("score"), *keys).limit(HITS)
        marked = fulltext.snippet(self.pages.join(F.broadcast(best.select(*keys)), keys, "left_semi"), query, keys, "content")
        rows = best.join(marked, keys).orderBy(F.desc("score"), *keys).collect()  # as many as HITS
        by = lambda r: f" ({', '.join(r.authors)})" if r.authors else ""
        said = lambda r: r.snippet.replace("\n", " ")
        return Answer("\n".join(f"[{r.document_id} p. {r.page_number}] {r.title}{by(r)}: {said(r)}" for r in rows) or "nothing found")

    def _read(self, given: dict) -> Answer:
        document, page = given["document_id"], int(given["page"])
        row = self.pages.where((F.col("document_id") == document) & (F.col("page_number") == page)).select(F.substring("content", 1, PAGE_CHARS)).first()
        return Answer(row[0] if row and row[0] else f"document {document} has no page {page}")

    def _open(self, given: dict) -> Answer:
        document, page = given["document_id"], int(given["page"])
        row = self.documents.where(F.col("document_id") == document).select("title").first()
        if row is None:
            return Answer(f"no document {document}")
        return Answer(f"opened « {row[0]} » at page {page}", {"open_document": document, "page": page, "highlight": given.get("highlight")})

    def _stats(self, given: dict) -> Answer:
        return Answer(json.dumps(catalog.stats(self.documents).first().asDict(), sort_keys=True))
