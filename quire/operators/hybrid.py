"""Hybrid search: rank fusion of lexical and vector candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions import text as T

from . import fulltext, knn

CONSTANT, CANDIDATES, LIMIT = 60, 40, 20


def ranked(df: DataFrame, order: Sequence, keys: Sequence[str]) -> DataFrame:
    """(keys, rank) of a list cut to its candidates already: a window over that many rows."""
    return df.select(*keys, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(lists: Sequence[DataFrame], keys: Sequence[str], limit: int = LIMIT, constant: int = CONSTANT, decimals: int = 8) -> DataFrame:
    """(keys, score) by reciprocal ranks: the sum of 1 / (constant + rank), best first, ties by key."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    out = every.groupBy(*keys).agg(F.round(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))), decimals).alias("score"))
    return out.orderBy(F.desc("score"), *keys).limit(limit)


def hybrid_search(pages: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float] | None, limit: int = LIMIT, candidates: int = CANDIDATES, key: str = "doc_id", content: str = "text", vector_key: str = "vec_id", metric: str = "l2") -> DataFrame:
    """(key, score): the best of both lists; without terms or without a query vector that list is empty."""
    lexical = ranked(fulltext.bm25(pages, query, candidates, [key], content), [F.desc("score"), key], [key])
    if query_vector is None:
        return fuse([lexical], [key], limit)
    near = knn.knn(vectors.select(F.col(vector_key).alias(key), "embedding"), query_vector, candidates, metric, key=key, decimals=4)
    return fuse([lexical, ranked(near, ["distance", key], [key])], [key], limit)


def search_pages(
    pages: DataFrame, vectors: DataFrame, document: DataFrame, edition: DataFrame, work: DataFrame, work_creator: DataFrame, creator: DataFrame, query: str, query_vector: Sequence[float] | None, limit: int = LIMIT, candidates: int = CANDIDATES, metric: str = "l2", decimals: int = 4
) -> DataFrame:
    """(document_id, page_number, score, title, authors, excerpt), best first.

    pages: (document_id, page_number, content); vectors: (document_id,
    page_number, embedding). The best passages of works and the nearest pages are
    fused by page; of the winners those without a work go. An excerpt is the
    snippet of a page found by its words, else the page's first characters, else
    empty. A blank query finds nothing.
    """
    keys, works = fulltext.PASSAGE, fulltext.of_works(document, edition, work)
    lexical = fulltext.ranked_passages(pages, works, query, candidates)
    lists = [ranked(lexical, [F.desc("score"), *keys], keys)]
    if query_vector is not None and query.strip():
        near = vectors.select(F.struct(*keys).alias("page"), "embedding")
        near = knn.knn(near, query_vector, candidates, metric, key="page", decimals=decimals).select("page.*", "distance")
        lists.append(ranked(near, ["distance", *keys], keys))
    best = fuse(lists, keys, limit)
    # Twice candidates rows at most are broadcast; texts are read for them only.
    own = pages.join(F.broadcast(best), list(keys), "left_semi").select(*keys, "content")
    shown = fulltext.snippet(own.join(F.broadcast(lexical.select(*keys)), list(keys), "left_semi"), query, keys, "content")
    hits = F.broadcast(best).join(works, "document_id").join(F.broadcast(own), list(keys), "left").join(F.broadcast(shown), list(keys), "left")
    return fulltext.with_authors(hits, work_creator, creator).select(*keys, "score", "title", "authors", T.excerpt("snippet", "content").alias("excerpt")).orderBy(F.desc("score"), *keys)
