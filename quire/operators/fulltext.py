"""Full-text search: postings, BM25, snippets, passages with their works.

A search text without words finds nothing, in each of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T

from . import catalog
from .scanning import spread

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
CANDIDATES, SNIPPET_WORDS = 40, 12


def postings(pages: DataFrame, keys: Sequence[str] = ("doc_id",), content: str = "text") -> DataFrame:
    """(keys, term, tf): how often each term stands in each page. A derived table to store, partitioned or sorted by term."""
    return spread(pages.select(*keys, content)).select(*keys, F.explode(T.tokens(content)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def lengths(pages: DataFrame, keys: Sequence[str] = ("doc_id",), content: str = "text") -> DataFrame:
    return spread(pages.select(*keys, content)).select(*keys, F.size(T.tokens(content)).cast("long").alias("dl"))


def bm25(pages: DataFrame, query: str, limit: int | None = CANDIDATES, keys: Sequence[str] = ("doc_id",), content: str = "text", decimals: int = 6) -> DataFrame:
    """(keys, score): pages with all terms of the query, the last of which is a prefix; best first.

    One pass over the pages: term frequencies of the few query terms are counted
    inside each page, without exploding words; what is left of a page, its key
    and a few numbers, is shuffled once and read twice, for the statistics, which
    are one row, and for the scores. Scores are rounded, ties go to the least
    key. No terms, no rows.
    """
    terms = T.match_terms(query)
    words = spread(pages.select(*keys, content)).select(*keys, T.tokens(content).alias("words"))
    if not terms:
        return words.select(*keys, F.lit(0.0).alias("score")).where(F.lit(False))
    fits = lambda i, w: F.startswith(w, F.lit(terms[i])) if i == len(terms) - 1 else w == terms[i]
    count = lambda i: F.size(F.filter("words", lambda w: fits(i, w))).cast("double").alias(f"tf{i}")
    counted = words.select(*keys, F.size("words").cast("double").alias("dl"), *[count(i) for i in range(len(terms))]).repartition(*keys)
    # The greatest key isn't needed, but with it both readers ask for the same columns, and so share the shuffle.
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), F.max(F.struct(*keys)).alias("_key"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    every = counted.crossJoin(F.broadcast(stats.where("n > 0 AND _key is not null")))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.expr(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    out = every.select(*keys, F.when(hit, F.round(score, decimals)).alias("score")).where("score is not null")
    return out if limit is None else out.orderBy(F.desc("score"), *keys).limit(limit)


def bm25_indexed(index: DataFrame, doc_lengths: DataFrame, query: str, limit: int = CANDIDATES, keys: Sequence[str] = ("doc_id",), decimals: int = 6) -> DataFrame:
    """The same over stored postings: reads the query terms' rows only."""
    terms = T.match_terms(query)
    if not terms:
        return doc_lengths.select(*keys, F.lit(0.0).alias("score")).where(F.lit(False))
    stats = doc_lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    parts = None
    for i, t in enumerate(terms):
        fits = F.startswith("term", F.lit(t)) if i == len(terms) - 1 else F.col("term") == t
        own = index.where(fits).groupBy(*keys).agg(F.sum("tf").cast("double").alias("tf")).withColumn("i", F.lit(i))
        parts = own if parts is None else parts.unionByName(own)
    df = parts.groupBy("i").agg(F.count("*").cast("double").alias("df"))
    scored = parts.join(F.broadcast(df), "i").join(doc_lengths, list(keys)).crossJoin(F.broadcast(stats))  # as many rows as terms, and one
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = scored.groupBy(*keys).agg(F.round(F.sum(one), decimals).alias("score"), F.count("*").alias("found")).where(F.col("found") == len(terms))
    return out.select(*keys, "score").orderBy(F.desc("score"), *keys).limit(limit)


def snippet(pages: DataFrame, query: str, keys: Sequence[str] = ("doc_id",), content: str = "text", words: int = SNIPPET_WORDS, marks: tuple[str, str, str] = ("«", "»", "…")) -> DataFrame:
    """(keys, snippet) of the pages with a hit: a window of words as they stand in the text, hits marked, dots where text is left out.

    Of the windows that begin with a hit the one with the most different terms
    is taken, then that with the most hits, then the first.
    """
    terms = T.match_terms(query)
    rows = spread(pages.select(*keys, content))
    if not terms:
        return rows.select(*keys, F.lit("").alias("snippet")).where(F.lit(False))
    last = len(terms) - 1
    is_hit = lambda w: F.startswith(w, F.lit(terms[last])) | w.isin(terms[:last]) if last else F.startswith(w, F.lit(terms[last]))
    fits = lambda w: F.array_compact(F.array(*[F.when(F.startswith(w, F.lit(t)) if i == last else w == t, i) for i, t in enumerate(terms)]))
    hits = F.filter(F.transform(T.tokens(content), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda h: is_hit(h["word"]))
    # Through explode, so that the hits aren't looked for again after the filter.
    rows = rows.select(*keys, content, F.explode(F.filter(F.array(hits), lambda h: F.size(h) > 0)).alias("hits"))

    def window(h, i):
        """How good the window that begins with a hit is, and where."""
        own = F.filter(F.slice("hits", i + 1, F.lit(words)), lambda x: x["at"] < h["at"] + words)
        return F.struct(F.size(F.array_distinct(F.flatten(F.transform(own, lambda x: fits(x["word"]))))).alias("terms"), F.size(own).alias("hits"), (-h["at"]).alias("before"))

    word = r"[\u0300-\u036f]*[\p{L}\p{M}\p{N}&&[^\u0300-\u036f]][\p{L}\p{M}\p{N}]*"  # what is a word when folded
    rows = rows.select(*keys, (-F.array_max(F.transform("hits", window))["before"]).alias("at"), F.transform("hits", lambda h: h["at"]).alias("hits"), F.regexp_extract_all(content, F.lit(word), F.lit(0)).alias("words"), F.split(content, word).alias("gaps"))
    shown = F.transform(F.slice("words", F.col("at") + 1, F.lit(words)), lambda w, i: F.concat(F.when(i == 0, F.when(F.col("at") == 0, F.get("gaps", F.lit(0))).otherwise(marks[2])).otherwise(F.get("gaps", F.col("at") + i)), F.when(F.array_contains("hits", F.col("at") + i), F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w)))
    end = F.when(F.col("at") + words < F.size("words"), marks[2]).otherwise(F.element_at("gaps", -1))
    return rows.select(*keys, F.concat(F.array_join(shown, ""), end).alias("snippet"))


def of_works(document: DataFrame, edition: DataFrame, work: DataFrame) -> DataFrame:
    """(document_id, work_id, title) of the documents that have an edition and a work."""
    return document.select("document_id", "edition_id").join(edition.select("edition_id", "work_id"), "edition_id").join(work.select("work_id", "title"), "work_id").select("document_id", "work_id", "title")


def with_authors(hits: DataFrame, work_creator: DataFrame, creator: DataFrame) -> DataFrame:
    """hits, as many as a limit lets through, with the authors of their works in order; none is an empty list."""
    works = hits.select("work_id").distinct()
    authors = catalog.authors_by_work(work_creator.join(F.broadcast(works), "work_id", "left_semi"), creator)
    none = F.array().cast("array<string>")
    return hits.join(F.broadcast(authors), "work_id", "left").withColumn("authors", F.coalesce("authors", none))


PASSAGE = ("document_id", "page_number")


def ranked_passages(pages: DataFrame, works: DataFrame, query: str, limit: int = CANDIDATES) -> DataFrame:
    """(document_id, page_number, score, work_id, title) of the best pages of documents with a work; works: of_works()."""
    return bm25(pages, query, None, PASSAGE, "content").join(works, "document_id").orderBy(F.desc("score"), *PASSAGE).limit(limit)


def search_passages(pages: DataFrame, document: DataFrame, edition: DataFrame, work: DataFrame, work_creator: DataFrame, creator: DataFrame, query: str, limit: int = CANDIDATES) -> DataFrame:
    """(document_id, page_number, score, snippet, title, authors), best first.

    pages: (document_id, page_number, content). Documents without an edition or
    a work are left out before the limit. Texts are read again for the winners
    only, authors for their works.
    """
    best = ranked_passages(pages, of_works(document, edition, work), query, limit)
    own = pages.join(F.broadcast(best.select(*PASSAGE)), list(PASSAGE), "left_semi")
    hits = best.join(F.broadcast(snippet(own, query, PASSAGE, "content")), list(PASSAGE))
    return with_authors(hits, work_creator, creator).select(*PASSAGE, "score", "snippet", "title", "authors").orderBy(F.desc("score"), *PASSAGE)
