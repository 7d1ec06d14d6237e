"""Maximal repeat groups with all their occurrences, from the common-prefix interval trees of a distributed suffix array.

A repeat is maximal where the bytes before its occurrences are diverse and so
are the bytes after them; the ends of a text differ from everything. Only
suffixes that can begin one are sorted:

1. Every string of LENGTH bytes that occurs twice is known by its anchor (see
   quire.llm.repeats) and its place beside it. Distinct contexts are cut into
   these strings, which are counted together with the bytes before them; a
   string with diverse bytes before it begins the suffixes of a place of its own.
2. The suffixes of a place are compared REACH bytes at a time, by hashes: where
   all are equal, they go on together, at twice the reach.
3. Where they differ, one suffix of each kind is fetched and sorted. A stack
   scan over their common prefixes gives the tree of intervals; an interval
   with diverse bytes before it is a maximal repeat, and all suffixes of its
   kinds are its occurrences. Equal suffixes at the end of the reach go on as a
   place of their own; at the end of their texts they are a repeat themselves.
4. A place with more than CAP kinds, or CAP_BYTES bytes of them, isn't
   collected: its common prefix is the least and the greatest kind's, found by
   aggregation; it is split by the byte after that until its parts are small,
   with the same result.

Defined cases: those of quire.llm.repeats; a repeat is listed once, with every
occurrence in every row, overlapping ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, stored
from .repeats import LENGTH, _asked_contexts, _opened, _rows_out, anchors, common, contexts, intervals, packed_blocks

CAP, CAP_BYTES = 4_096, 8 << 20
#: Bytes compared at once, at first and at most.
REACH, MOST_REACH = 512, 1 << 16
#: What stands before the first byte of a text.
START = 256

BEFORE = ("n bigint", "least int", "most int", "starts bigint")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, before, block, n): the distinct contexts of each block with the bytes before them."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for i, data, numbers, sizes in _opened(b):
                found, begins = anchors(numbers, sizes), np.cumsum(sizes) - sizes
                first = found[2]
                before = np.where(np.isin(first, begins), START, numbers[first - 1].astype(np.int64)) if len(first) else first
                counts: dict[tuple[int, int, int], int] = {}
                for pair in zip(found[0].view(np.int64).tolist(), contexts(data, found).view(np.int64).tolist(), before.tolist(), strict=True):
                    counts[pair] = counts.get(pair, 0) + 1
                block = b.column("block")[i].as_py()
                yield from ((*pair, block, n) for pair, n in counts.items())

    return _rows_out(rows(), ("anchor", "context", "before", "block", "n"), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, at, string, n, least, most, starts): the strings of LENGTH bytes of each context."""
    digest = xxhash.xxh3_64_intdigest

    def rows() -> Iterator[tuple]:
        for b in batches:
            for anchor, context, place, raw, *edge in zip(*(b.column(c).to_pylist() for c in ("anchor", "context", "place", "bytes", "n", "least", "most", "starts")), strict=True):
                view = memoryview(raw)
                for i in range(len(raw) - LENGTH + 1):
                    own = edge if not i else (edge[0], raw[i - 1], raw[i - 1], 0)
                    yield anchor, context, i - place, digest(view[i : i + LENGTH]) - (1 << 63), *own

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return _rows_out(rows(), ("anchor", "context", "at", "string", "n", "least", "most", "starts"), kinds)


def _diverse() -> Column:
    """Whether what stands before occurrences is diverse; two texts' starts are."""
    return (F.col("least") != F.col("most")) | (F.col("starts") > 1)


def _counted() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("starts").alias("starts")]


def _occurrences(kind: pa.DataType):
    """(node, block, doc, key, start, before) of the strings that a block was asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i, data, numbers, sizes in _opened(b):
                asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for m in b.column("asked")[i].as_py():
                    asked.setdefault((m["anchor"], m["context"]), []).append((m["at"], m["node"]))
                found, keys, ends, block = anchors(numbers, sizes), b.column("keys")[i].as_py(), np.cumsum(sizes), b.column("block")[i].as_py()
                for pair, p in zip(zip(found[0].view(np.int64).tolist(), contexts(data, found).view(np.int64).tolist(), strict=True), found[1].tolist(), strict=True):
                    for at, node in asked.get(pair, ()):
                        d = int(np.searchsorted(ends, p, "right"))
                        start = p + at - int(ends[d] - sizes[d])
                        yield node, block, d, keys[d], start, data[p + at - 1] if start else START

    return lambda batches: _rows_out(rows(batches), ("node", "block", "doc", "key", "start", "before"), (pa.int64(), pa.int64(), pa.int32(), kind, pa.int64(), pa.int32()))


def _after(reach: int):
    """(node, block, doc, start, right, size, ended): the next bytes of the suffixes that a block was asked for, as a hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i, data, _, sizes in _opened(b):
                begins, view, block = (np.cumsum(sizes) - sizes).tolist(), memoryview(data), b.column("block")[i].as_py()
                for m in b.column("asked")[i].as_py():
                    at, end = begins[m["doc"]] + m["start"] + m["depth"], begins[m["doc"]] + int(sizes[m["doc"]])
                    size = min(reach, end - at)
                    ended = size < reach
                    yield m["node"], block, m["doc"], m["start"], xxhash.xxh3_64_intdigest(view[at : at + size], ended) - (1 << 63), size, ended

    return lambda batches: _rows_out(rows(batches), ("node", "block", "doc", "start", "right", "size", "ended"), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, right, bytes) of the kinds that a block was asked for."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for i, data, _, sizes in _opened(b):
                begins = (np.cumsum(sizes) - sizes).tolist()
                for m in b.column("asked")[i].as_py():
                    at = begins[m["doc"]] + m["start"] + m["depth"]
                    yield m["node"], m["right"], data[at : at + m["size"]]

    return _rows_out(rows(), ("node", "right", "bytes"), (pa.int64(), pa.int64(), pa.binary()), 500)


FOUND = "top bigint, right bigint, group bigint, length bigint"


def _tree(rows: pa.Table) -> pa.Table:
    """The repeats of a place, from its kinds: (top, right, group, length), a row for each kind of each; group null where a kind goes on."""
    kinds = sorted(zip(*(rows.column(c).to_pylist() for c in ("bytes", "ended", "top", "right", "n", "least", "most", "starts")), strict=True))
    node, depth = rows.column("node")[0].as_py(), rows.column("depth")[0].as_py()
    out: list[tuple] = []

    def emit(length: int, first: int, last: int) -> None:
        own = kinds[first : last + 1]
        if depth + length >= LENGTH and (min(k[5] for k in own) != max(k[6] for k in own) or sum(k[7] for k in own) > 1):
            group = xxhash.xxh3_64_intdigest(f"{node}:{length}:{first}") - (1 << 63)
            out.extend((k[2], k[3], group, depth + length) for k in own)

    lcp = [common(a[0], b[0]) for a, b in zip(kinds, kinds[1:], strict=False)]
    for length, first, last in intervals(lcp):
        emit(length, first, last)
    if lcp and min(lcp) == 0:
        emit(0, 0, len(kinds) - 1)
    for i, (raw, ended, top, right, n, least, most, starts) in enumerate(kinds):
        if n < 2 or least == most and starts < 2:
            continue
        if not ended:
            out.append((top, right, None, None))
        elif max([0, *lcp[max(i - 1, 0) : i], *lcp[i : i + 1]]) < len(raw) or len(kinds) == 1:  # else an interval holds it
            emit(len(raw), i, i)
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("top", "right", "group", "length"), cols, strict=True)})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, common) from the least and the greatest kind."""
    for b in batches:
        n = [common(x, y) for x, y in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int32())], names=["node", "common"])


def _split(kinds: DataFrame) -> DataFrame:
    """What FOUND says, of places of any size."""
    done: list[DataFrame] = []
    while True:
        sizes = stored(kinds.groupBy("node").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("bytes")).alias("held")))
        large = (F.col("kinds") > CAP) | ((F.col("held") > CAP_BYTES) & (F.col("kinds") > 1))
        hot = sizes.where(large).select("node")
        last = hot.isEmpty()
        small = kinds if last else kinds.join(sizes.where(~large).select("node"), "node", "left_semi")
        done.append(stored(small.groupBy("node").applyInArrow(_tree, FOUND)))
        if last:
            return _all(done)
        own = stored(kinds.join(hot, "node", "left_semi"))
        span = own.groupBy("node").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"), *_counted())
        span = stored(span)
        span = span.join(stored(arrow_map(span.select("node", "low", "high"), _shared, "node bigint, common int")), "node")
        span = stored(span.select("node", "common", _diverse().alias("diverse")))
        own = stored(own.join(span, "node"))
        length = (F.col("depth") + F.col("common")).alias("length")
        done.append(stored(own.where(F.col("diverse") & (F.col("depth") + F.col("common") >= LENGTH)).select("top", "right", F.xxhash64("node", F.lit("split")).alias("group"), length)))
        rest = own.where(F.octet_length("bytes") > F.col("common"))
        byte = F.substring("bytes", F.col("common") + 1, F.lit(1))
        kinds = stored(rest.select(F.xxhash64("node", byte).alias("node"), "top", "right", "n", "least", "most", "starts", "ended", F.substring("bytes", F.col("common") + 2, F.octet_length("bytes")).alias("bytes"), (F.col("depth") + F.col("common") + 1).alias("depth")))


def _all(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every


def _begun(blocks: DataFrame, kind) -> DataFrame:
    """The stored table (node, block, doc, key, start, before): all suffixes that can begin a maximal repeat, by their place."""
    edges = arrow_map(blocks, _edges, "anchor bigint, context bigint, before int, block bigint, n bigint")
    often = stored(edges.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"))
    some = stored(edges.join(often, "anchor"))  # of two scans, so that Spark may split a hot anchor
    is_start = F.when(F.col("before") == START, F.col("n")).otherwise(0)
    each = stored(some.groupBy("anchor", "context").agg(F.min("block").alias("home"), F.sum("n").alias("n"), F.min("before").alias("least"), F.max("before").alias("most"), F.sum(is_start).alias("starts")))
    asked = each.groupBy(F.col("home").alias("block")).agg(F.collect_list(F.struct("anchor", "context")).alias("asked"))  # of one block: bounded
    sent = stored(arrow_map(blocks.join(stored(asked), "block").select("block", "sizes", "data", "asked"), _asked_contexts, "anchor bigint, context bigint, place int, bytes binary"))
    windows = stored(arrow_map(sent.join(each.drop("home"), ["anchor", "context"]), _windows, "anchor bigint, context bigint, at int, string bigint, " + ", ".join(BEFORE)))
    first = stored(windows.groupBy("anchor", "at", "string").agg(*_counted()).where((F.col("n") > 1) & _diverse()).select("anchor", "at", "string"))
    wanted = stored(windows.join(first, ["anchor", "at", "string"]).select("anchor", "context", "at", F.xxhash64("anchor", "at", "string").alias("node")))
    asked = some.select("anchor", "context", "block").distinct().join(wanted, ["anchor", "context"]).groupBy("block").agg(F.collect_list(F.struct("anchor", "context", "at", "node")).alias("asked"))
    rows = arrow_map(blocks.join(stored(asked), "block").select("block", "keys", "sizes", "data", "asked"), _occurrences(to_arrow_type(kind)), f"node bigint, block bigint, doc int, key {kind.simpleString()}, start bigint, before int")
    return stored(rows)


def repeat_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, length, key, start): the maximal repeats of LENGTH bytes and more, with all their occurrences, in bytes."""
    blocks = packed_blocks(df, key, text)
    kind = blocks.schema["keys"].dataType.elementType
    live = _begun(blocks, kind).withColumn("depth", F.lit(0).cast("bigint"))
    out: list[DataFrame] = []
    reach, place = REACH, ["node", "block", "doc", "start"]
    while not live.isEmpty():
        asked = stored(live.groupBy("block").agg(F.collect_list(F.struct("node", "doc", "start", "depth")).alias("asked")))  # suffixes of one block
        after = stored(arrow_map(blocks.join(asked, "block").select("block", "sizes", "data", "asked"), _after(reach), "node bigint, block bigint, doc int, start bigint, right bigint, size int, ended boolean"))
        rows = stored(live.join(after, place))
        is_start = (F.col("before") == START).cast("bigint")
        kinds = stored(rows.groupBy("node", "right").agg(F.count("*").alias("n"), F.min("before").alias("least"), F.max("before").alias("most"), F.sum(is_start).alias("starts"), F.any_value("ended").alias("ended"), F.any_value("size").alias("size"), F.any_value("depth").alias("depth"), F.min(F.struct("block", "doc", "start")).alias("home")))
        alone = stored(kinds.groupBy("node").agg(F.count("*").alias("kinds")))
        # Places whose suffixes are all equal go on as they are; the kinds of the others are fetched.
        same = kinds.join(alone.where("kinds = 1").select("node"), "node", "left_semi").where("NOT ended").select("node", "right", F.col("node").alias("next"))
        parts = stored(kinds.join(alone, "node").where("kinds > 1 OR ended"))
        asked = stored(parts.groupBy(F.col("home.block").alias("block")).agg(F.collect_list(F.struct("node", "right", "home.doc", "home.start", "depth", "size")).alias("asked")))
        raw = stored(arrow_map(blocks.join(asked, "block").select("block", "sizes", "data", "asked"), _fetched, "node bigint, right bigint, bytes binary"))
        fetched = stored(parts.join(raw, ["node", "right"]).select("node", F.col("node").alias("top"), "right", "n", "least", "most", "starts", "ended", "bytes", "depth"))
        found = _split(fetched)
        groups = found.where("group is not null").select(F.col("top").alias("node"), "right", "group", "length")
        out.append(stored(rows.join(groups, ["node", "right"]).select("group", F.col("length").cast("int").alias("length"), F.col("key").alias(key), "start")))
        further = found.where("group is null").select(F.col("top").alias("node"), "right", F.xxhash64("top", "right").alias("next"))
        going = stored(same.unionByName(further))
        live = stored(rows.join(going, ["node", "right"]).select(F.col("next").alias("node"), "block", "doc", "key", "start", "before", (F.col("depth") + reach).alias("depth")))
        reach = min(2 * reach, MOST_REACH)
    return _all(out) if out else df.sparkSession.createDataFrame([], f"group bigint, length int, {key} {kind.simpleString()}, start bigint")
