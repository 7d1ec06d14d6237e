"""The vector index of pages: what embeds texts, and bringing the index up to date."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ingest
from .knn import VectorTable

#: Characters of a page that are embedded.
EMBEDDED = 1_500
BATCH = 64


class EmbeddingProvider(Protocol):
    """Embeds texts; one instance serves all tasks of a worker, so it must pickle."""

    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text; None where a text can't be embedded."""


def embed_pages(pages: DataFrame, provider: EmbeddingProvider, content: str = "content") -> DataFrame:
    """(document_id, page_number, embedding) of the pages that could be embedded, BATCH texts a call."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                vectors = pa.array(provider.embed(b.column("text").to_pylist()), pa.list_(pa.float32()))
                kept = vectors.is_valid()
                yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept), vectors.filter(kept)], names=["document_id", "page_number", "embedding"])

    rows = pages.select("document_id", "page_number", F.substring(content, 1, EMBEDDED).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(embed, f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, embedding array<float>")


def index_pending(pages: DataFrame, table: VectorTable, provider: EmbeddingProvider, known: tuple[str, int] | None = None) -> tuple[str, int]:
    """Embeds the pages that the table lacks and adds them; returns the model's identity to keep beside the table.

    The table's key is `page`, made of document and page number. Another model
    or dimension than known empties the table first.
    """
    identity = table.prepare(provider.model, known)
    key = F.concat_ws("/", F.col("document_id").cast("string"), F.col("page_number").cast("string")).alias("page")
    missing = ingest.pending(pages.select("*", key), table.read(), ["page"])
    vectors = embed_pages(missing, provider)
    table.upsert(vectors.select(key, "document_id", "page_number", "embedding"))
    return identity
