"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents into segments of about SEGMENT bytes of text, so
its construction shuffles nothing: each task numbers the words of its segment
and stores, for every term, the delta-coded list of positions, and for every
document its first position and number of words. Positions of neighbouring
documents are GAP apart, so no phrase crosses from one into the next.

A search brings the lists of the terms asked for together by segment. There
each window of a test item takes the shortest list among its terms and
intersects it with the other lists, adjusted by their offsets, from rare to
frequent; it ends as soon as nothing is left. What is left are the exact
places of the phrase. With a slop above 0 (proximity) an occurrence is any
choice of ascending places of the terms, in their order, with slop other words
at most between two that follow each other; all words from its first to its last
are hit. That depends on neither segments nor the order in which lists are
read: the rarest list only says where the others need to be looked at.

Test items are taken in blocks of BLOCK_WORDS words, one broadcast each; a pass
over the index looks for TOGETHER blocks, one after another in each segment, so
any number of items can be searched with bounded memory. Segments bound what a
task holds, however frequent a term is.

Defined cases: a null or empty text has no words and a row without hits; an
item without words matches nothing; an item shorter than a window is one window
of its own length; items with equal texts all count; items with equal identifiers
count once, with the windows of all their texts; documents with equal keys
keep a row each; a null item identifier is the word null; a document longer
than a segment is a segment of its own; an empty index or item table gives
empty or hitless rows; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import batched, count, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, batch_of, stored

WINDOW = 13
SEGMENT = 8 << 20
GAP, MAX_SLOP = 64, 16
BLOCK_WORDS, TOGETHER = 200_000, 4
ROWS = 20_000

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: (segment, term, postings, key, first, n_words).

    A row with the empty term stands for a document; the others hold the
    positions of a term, as little-endian 32-bit differences.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        held: list[tuple[object, list[bytes]]] = []
        size, kind = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            segment = f"{part}-{next(number)}"
            terms: defaultdict[bytes, int] = defaultdict(count().__next__)
            lengths = np.array([len(w) for _, w in held], np.int64)
            firsts = np.cumsum(lengths + GAP) - lengths - GAP
            n = int(lengths.sum())
            ids = np.fromiter((i for _, w in held for i in map(terms.__getitem__, w)), np.int32, n)
            places = np.arange(n, dtype=np.int64) + np.repeat(np.arange(len(held)) * GAP, lengths)
            order = np.argsort(ids, kind="stable")
            places = places[order].astype(np.int32)
            ends = np.cumsum(np.bincount(ids, minlength=len(terms)))
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            deltas = np.diff(places, prepend=np.int32(0))
            deltas[starts] = places[starts]
            names = list(terms)
            for at in range(0, len(names), ROWS):
                m = min(ROWS, len(names) - at)
                bounds = (np.concatenate((starts[at : at + m], ends[at + m - 1 : at + m])) - starts[at]) * 4
                lists = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(deltas[starts[at] : ends[at + m - 1]].astype("<i4").tobytes())])
                yield batch_of({"segment": pa.array([segment] * m), "term": pa.array(names[at : at + m], pa.binary()), "postings": lists, "key": pa.nulls(m, kind), "first": pa.nulls(m, pa.int64()), "n_words": pa.nulls(m, pa.int64())})
            m = len(held)
            yield batch_of({"segment": pa.array([segment] * m), "term": pa.array([b""] * m, pa.binary()), "postings": pa.nulls(m, pa.binary()), "key": pa.array([k for k, _ in held], kind), "first": pa.array(firsts), "n_words": pa.array(lengths)})
            held.clear()

        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.append((k, words_of(t)))
                size += len(t or b"") + 64
                if size >= SEGMENT:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return stored(arrow_map(rows, index, f"segment string, term binary, postings binary, key {key_type}, first bigint, n_words bigint"))


class Block(NamedTuple):
    """Test items: their identifiers, terms, and windows of equal length as rows of term numbers with their items."""

    names: list[str]
    terms: list[bytes]
    windows: list[tuple[np.ndarray, list[list[int]]]]


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Block]:
    """The items in blocks of about BLOCK_WORDS words, from one sorted pass; a partition of them is held at a time."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    letters = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-letters // (6 * BLOCK_WORDS)))
    ordered = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(n)).alias("block"), "key", "text").orderBy("block", "key", "text")
    found_any = False
    for _, own_rows in groupby(ordered.toLocalIterator(), lambda r: r.block):
        terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        found: dict[int, dict[tuple[int, ...], list[int]]] = {}
        names: list[str] = []
        for name, same in groupby(own_rows, lambda r: r.key):
            own_windows = set()
            for _, _, t in same:
                if ids := [terms[w] for w in words_of(t.encode())]:
                    size = min(window, len(ids))
                    own_windows |= {tuple(ids[j : j + size]) for j in range(len(ids) - size + 1)}
            for w in own_windows:
                found.setdefault(len(w), {}).setdefault(w, []).append(len(names))
            names += [name] * bool(own_windows)
        found_any = True
        yield Block(names, list(terms), [(np.array(list(w), np.int32), list(w.values())) for w in found.values()])
    if not found_any:
        yield Block([], [], [])


class Segment:
    """The lists of one segment."""

    def __init__(self, postings: dict[bytes, bytes]):
        self.raw = postings
        self.lists: dict[bytes, np.ndarray] = {}

    def positions(self, term: bytes) -> np.ndarray:
        got = self.lists.get(term)
        if got is None:
            got = self.lists[term] = np.cumsum(np.frombuffer(self.raw[term], "<i4"))
        return got

    def phrase(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the occurrences of terms in sequence."""
        order = sorted(range(len(terms)), key=lambda o: len(self.raw[terms[o]]))
        base = self.positions(terms[order[0]]).astype(np.int64) - order[0]
        for o in order[1:]:
            own, want = self.positions(terms[o]), base + o
            base = base[own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want]
            if not len(base):
                break
        return base, base + len(terms) - 1

    def near(self, terms: list[bytes], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals whose union is what all occurrences cover that leave slop words at most between terms."""
        reach, n = slop + 1, len(terms)
        rare = min(range(n), key=lambda o: len(self.raw[terms[o]]))
        anchor = self.positions(terms[rare]).astype(np.int64)
        lists = []
        for o, t in enumerate(terms):  # what lies too far from every anchor is in no occurrence
            own = self.positions(t).astype(np.int64)
            i = np.searchsorted(anchor, own - max(o - rare, 0) * reach)
            lists.append(own[anchor[np.minimum(i, len(anchor) - 1)] <= own + max(rare - o, 0) * reach] if o != rare else anchor)
        for o in range(1, n):  # those that the terms before lead to
            lists[o] = self._reached(lists[o - 1], lists[o], reach)
        low, high = [], []
        for o in range(n - 2, -1, -1):  # and from which the terms after go on
            after, own = lists[o + 1], lists[o]
            last = np.searchsorted(after, own + reach, "right") - 1
            going = np.zeros(len(own), bool) if not len(after) else (last >= 0) & (after[np.maximum(last, 0)] > own)
            lists[o], last = own[going], last[going]
            low.append(lists[o])
            high.append(after[last])
        if n == 1:
            return anchor, anchor
        return np.concatenate(low), np.concatenate(high)

    @staticmethod
    def _reached(before: np.ndarray, own: np.ndarray, reach: int) -> np.ndarray:
        """Those of own that have one of before at most reach words ahead of them."""
        if not len(before) or not len(own):
            return own[:0]
        last = np.searchsorted(before, own) - 1
        return own[(last >= 0) & (own - before[np.maximum(last, 0)] <= reach)]


def _search(rows: pa.Table, blocks: Iterator[Block], slop: int) -> dict[str, list]:
    """Hits and items of each document of a segment."""
    lists, docs = {}, []
    for term, postings, key, first, n in zip(*(rows.column(c).to_pylist() for c in ("term", "postings", "key", "first", "n_words")), strict=True):
        if term:
            lists[term] = postings
        else:
            docs.append((first, n, key))
    docs.sort(key=lambda d: d[0])
    firsts, lengths = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
    total = int(firsts[-1] + lengths[-1]) if docs else 0
    cover = np.zeros(total + 1, np.int32)
    found: dict[int, set[str]] = {}
    segment = Segment(lists)
    for block in blocks:
        here = np.array([t in lists for t in block.terms], bool)
        for windows, owners in block.windows:
            for i in np.flatnonzero(here[windows].all(axis=1)).tolist():
                terms = [block.terms[t] for t in windows[i].tolist()]
                low, high = segment.near(terms, slop) if slop else segment.phrase(terms)
                if len(low):
                    np.add.at(cover, low, 1)
                    np.add.at(cover, high + 1, -1)
                    for d in set((np.searchsorted(firsts, low, "right") - 1).tolist()):
                        found.setdefault(d, set()).update(block.names[x] for x in owners[i])
    hit = np.cumsum(cover) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    runs: dict[int, list[dict[str, int]]] = {}
    for a, b in edges.reshape(-1, 2).tolist():
        d = int(np.searchsorted(firsts, a, "right")) - 1
        runs.setdefault(d, []).append({"start": a - int(firsts[d]), "end": b - int(firsts[d])})
    return {"key": [d[2] for d in docs], "ordinal": list(range(len(docs))), "n_words": lengths.tolist(), "hits": [runs.get(i, []) for i in range(len(docs))], "items": [sorted(found.get(i, ())) for i in range(len(docs))]}


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _searcher(shared, slop: int):
    def search(rows: pa.Table) -> pa.Table:
        got = _search(rows, (s.value for s in shared), slop)
        segment = pa.array(rows.column("segment").slice(0, 1).to_pylist() * len(got["key"]), pa.string())
        return pa.table({"segment": segment, "ordinal": pa.array(got["ordinal"], pa.int32()), "key": pa.array(got["key"], rows.schema.field("key").type), "n_words": pa.array(got["n_words"], pa.int64()), "hits": pa.array(got["hits"], _RUNS), "items": pa.array(got["items"], pa.list_(pa.string()))})

    return search


def find_items(index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(key, n_words, hits, items) for each document of the index.

    hits: maximal runs [start, end) of words inside any occurrence of a window;
    items: sorted identifiers, as strings, of the items with such windows.
    """
    if not 0 <= slop <= MAX_SLOP:
        raise ValueError(f"slop must be from 0 to {MAX_SLOP}")
    spark, key_type = index.sparkSession, index.schema["key"].dataType.simpleString()
    schema = f"segment string, ordinal int, key {key_type}, n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>"
    parts = []
    for blocks in batched(item_blocks(items, item_key, item_text, window), TOGETHER):
        search = _searcher([spark.sparkContext.broadcast(b) for b in blocks], slop)
        terms = sorted(set().union(*(b.terms for b in blocks)))
        asked = spark.createDataFrame([(bytearray(t),) for t in [b"", *terms]], "term binary")  # of TOGETHER blocks: bounded
        parts.append(index.join(F.broadcast(asked), "term", "left_semi").groupBy("segment").applyInArrow(search, schema))
    if len(parts) == 1:
        return parts[0].drop("segment", "ordinal")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("segment", "ordinal").agg(F.any_value("key").alias("key"), F.any_value("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        "hits",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, h: F.when((F.size(acc) > 0) & (h["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], h["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(h))),
    )
    return merged.select("key", "n_words", joined.alias("hits"), "items")


def contamination(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the query from find_items: contaminated where at least a twentieth of the words is hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: DuckDB SQL for the query.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT item_id, w, least({WINDOW}, len(w)) AS size FROM (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, coalesce({_WORDS}, []) AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM item)),
docwin AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM item))),
hit AS (SELECT d.doc_id, d.size, d.i, x.item_id FROM docwin d JOIN win x ON d.size = x.size AND d.s = x.s),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
