"""Repeated passages by a sparse enhanced suffix array with its common-prefix interval tree.

Removes every byte covered by a string of LENGTH bytes that starts at more than
one place of the corpus. Each such string is found through the anchor in it: of
its K-byte grams the one with the least hash, the rightmost of equals. Equal
strings have the same anchor at the same offset, so only suffixes that start at
anchors are needed, about one in 85 positions.

1. Documents are packed into blocks of about BLOCK bytes. An anchor's context is
   the union of the strings that it stands for. Each block sends one row for
   each distinct (anchor, context) hash, so copies combine before the shuffle.
2. A context that occurs twice is covered whole. Contexts that share only their
   anchor are sent once each, from one block, and meet by anchor.
3. There the suffixes from the anchor are sorted and their common prefixes
   give, by a stack scan, the tree of intervals: sets of occurrences with a
   common right extension. In each interval the left extensions are sorted too;
   an occurrence's longest left extension shared with any other of the interval,
   beyond which they are diverse, with the interval's right extension is a
   maximal repeat; it counts from LENGTH bytes.
4. An anchor with more than CAP contexts is not collected: the strings of its
   contexts are hashed and counted by aggregation, which gives the same answer.
5. What was found returns to the blocks, which mark and cut.

Contexts and hot anchors' strings are known by two hashes of 64 bits, the
anchor's and their own; among those of one anchor the first is the same, so
there 64 bits tell them apart. Copies never move; contexts that share only
their anchor are compared by their bytes. quire.llm.repeatgroups lists the maximal repeats.

Defined cases: a null or empty text, or one under LENGTH bytes, keeps all its
bytes; overlapping occurrences count; matches don't cross documents; rows with
equal keys or texts keep a row each (equal texts of LENGTH bytes are removed in
all of them); a very long text is a block of its own; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, batch_of, stored

LENGTH, K = 200, 32
BLOCK, CAP = 2 << 20, 4_096
PLACES = (1 << 31) - 1


@functools.cache
def _byte_hashes() -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([i])) for i in range(256)), np.uint64)


@functools.cache
def _odd(i: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"step {i}".encode()) | 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the K-byte grams at each place, by doubling."""
    h, width = _byte_hashes()[data], 1
    while width < K:
        h = h[:-width] * _odd(width) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _odd(0)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, with the first and last start of the strings that it stands for.

    data: documents of the given sizes one after another.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty
    h = gram_hashes(data)
    mask = np.uint64(PLACES)
    packed = h & ~mask
    packed |= mask - np.arange(len(h), dtype=np.uint64)
    least = sliding_least(packed, length - K + 1)
    ends = np.cumsum(sizes)
    long = sizes >= length
    starts, counts = (ends - sizes)[long], sizes[long] - length + 1
    total = int(counts.sum())
    if not total:
        return empty.astype(np.uint64), empty, empty, empty
    at = np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    place = (mask - (least[at] & mask)).astype(np.int64)
    new = np.empty(total, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [total])) - 1
    return h[place[first]], place[first], at[first], at[last]


def contexts(data: bytes, found: tuple[np.ndarray, ...], length: int = LENGTH) -> np.ndarray:
    """A hash for each anchor's context and the anchor's place in it."""
    _, place, first, last = found
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a : b + length], p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(place))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval, children before parents; lcp[i] is between i and i + 1."""
    stack = [(0, 0)]
    for i, n in enumerate([*lcp, 0]):
        first = i
        while stack[-1][0] > n:
            depth, first = stack.pop()
            yield depth, first, i
        if n > stack[-1][0]:
            stack.append((n, first))


def covered(group: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context (anchor's place in it, bytes) the merged ranges around the anchor that repeat in another context."""
    m = len(group)
    right, left = [c[at:] for at, c in group], [c[:at][::-1] for at, c in group]
    found: list[list[tuple[int, int]]] = [[] for _ in group]
    if m == 2:
        r, n = common(*right), common(*left)
        if r + n >= length:
            found[0].append((-n, r))
            found[1].append((-n, r))
        return found
    order = sorted(range(m), key=right.__getitem__)
    rank = [0] * m
    for i, x in enumerate(sorted(range(m), key=left.__getitem__)):
        rank[x] = i
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    longest = max(map(len, left))
    for depth, a, b in intervals(lcp):
        if depth + longest < length:
            continue
        own = sorted(order[a : b + 1], key=rank.__getitem__)
        near = [common(left[x], left[y]) for x, y in zip(own, own[1:], strict=False)]
        for i, x in enumerate(own):
            n = max(near[i - 1] if i else 0, near[i] if i < len(near) else 0)
            if n + depth >= length:
                found[x].append((-n, depth))
    return [_merged(f) for f in found]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def packed_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """The stored table (block, keys, sizes, data): the documents' bytes, compressed by the block."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        keys, texts, size, kind = [], [], 0, None

        def flush() -> pa.RecordBatch:
            out = {"block": pa.array([part << 32 | n], pa.int64()), "keys": pa.array([keys], pa.list_(kind)), "sizes": pa.array([list(map(len, texts))], pa.list_(pa.int64())), "data": pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())}
            return batch_of(out)

        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if keys and size + len(t or b"") > BLOCK:
                    yield flush()
                    keys, texts, size, n = [], [], 0, n + 1
                keys.append(k)
                texts.append(t or b"")
                size += len(t or b"") + 64
        if keys:
            yield flush()

    return stored(arrow_map(rows, pack, f"block bigint, keys array<{rows.schema['key'].dataType.simpleString()}>, sizes array<bigint>, data binary"), "snappy")


def _opened(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Row number, bytes, the same as numbers, and sizes of each block in a batch."""
    for i in range(b.num_rows):
        data = zstandard.decompress(b.column("data")[i].as_py())
        yield i, data, np.frombuffer(data, np.uint8), np.array(b.column("sizes")[i].as_py(), np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, data, numbers, sizes in _opened(b):
            found = anchors(numbers, sizes)
            pairs = np.stack((found[0], contexts(data, found)), axis=1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(pairs)))
            own = np.ascontiguousarray(pairs[first].T)
            for at in range(0, len(first), 10_000):
                s = slice(at, at + 10_000)
                yield batch_of({"anchor": _signed(own[0, s]), "context": _signed(own[1, s]), "block": pa.array([b.column("block")[i].as_py()] * len(n[s]), pa.int64()), "n": pa.array(np.minimum(n[s], 2), pa.int32())})


def _asked_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that a block was asked for: (anchor, context, place, bytes)."""
    for b in batches:
        for i, data, numbers, sizes in _opened(b):
            asked = {(x["anchor"], x["context"]) for x in b.column("asked")[i].as_py() or ()}
            found = anchors(numbers, sizes)
            hashes, ctx = found[0].view(np.int64).tolist(), contexts(data, found).view(np.int64).tolist()
            rows = []
            for pair, p, first, last in zip(zip(hashes, ctx, strict=True), *(x.tolist() for x in found[1:]), strict=True):
                if pair in asked:
                    asked.remove(pair)
                    rows.append((*pair, p - first, data[first : last + LENGTH]))
            for at in range(0, len(rows), 2_000):
                cols = list(zip(*rows[at : at + 2_000], strict=True))
                yield batch_of(dict(zip(("anchor", "context", "place", "bytes"), (pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)), strict=True)))


def _anchor_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[tuple[int, bytes]]]]:
    """Anchor, context hashes and contexts of rows that come sorted by anchor; those with one left out."""
    anchor, names, group = None, [], []
    for b in batches:
        for h, c, p, raw in zip(*(b.column(x).to_pylist() for x in ("anchor", "context", "place", "bytes")), strict=True):
            if h != anchor:
                if len(group) > 1:
                    yield anchor, names, group
                anchor, names, group = h, [], []
            names.append(c)
            group.append((p, raw))
    if len(group) > 1:
        yield anchor, names, group


def _rows_out(rows: Iterator[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...], size: int = 5_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield batch_of({n: pa.array(c, k) for n, c, k in zip(names, zip(*part, strict=True), kinds, strict=True)})


def _ranges_by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (anchor, context, start, end) of contexts that come sorted by anchor."""
    rows = ((h, name, a, z) for h, names, group in _anchor_groups(batches) for name, ranges in zip(names, covered(group), strict=True) for a, z in ranges)
    return _rows_out(rows, ("anchor", "context", "start", "end"), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of each context, hashed: (anchor, context, whole, start, string)."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        for h, c, p, raw, whole in zip(*(b.column(x).to_pylist() for x in ("anchor", "context", "place", "bytes", "whole")), strict=True):
            view, n = memoryview(raw), len(raw) - LENGTH + 1
            hashes = np.array([digest(view[i : i + LENGTH]) for i in range(n)], np.uint64)
            yield batch_of({"anchor": pa.array([h] * n, pa.int64()), "context": pa.array([c] * n, pa.int64()), "whole": pa.array([whole] * n, pa.bool_()), "start": pa.array(range(-p, n - p), pa.int32()), "string": _signed(hashes)})


def _cut(kind: pa.DataType):
    runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, numbers, sizes in _opened(b):
                marks: dict[tuple[int, int], list[tuple[int, int] | None]] = {}
                for m in b.column("marks")[i].as_py() or ():
                    marks.setdefault((m["anchor"], m["context"]), []).append(None if m["start"] is None else (m["start"], m["end"]))
                step = np.zeros(len(data) + 1, np.int32)
                if marks:
                    found = anchors(numbers, sizes)
                    for pair, p, first, last in zip(zip(found[0].view(np.int64).tolist(), contexts(data, found).view(np.int64).tolist(), strict=True), *(x.tolist() for x in found[1:]), strict=True):
                        for m in marks.get(pair, ()):
                            a, z = (first, last + LENGTH) if m is None else (p + m[0], p + m[1])
                            step[a] += 1
                            step[z] -= 1
                gone = np.cumsum(step[:-1]) > 0
                keys, at = b.column("keys")[i].as_py(), 0
                rows: tuple[list, list, list] = ([], [], [])
                for size in sizes.tolist():
                    own = gone[at : at + size]
                    if own.any():
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).reshape(-1, 2)
                        rows[1].append([{"start": x, "end": y} for x, y in edges.tolist()])
                        rows[2].append(numbers[at : at + size][~own].tobytes())
                    else:
                        rows[1].append([])
                        rows[2].append(data[at : at + size])
                    rows[0].append(size)
                    at += size
                for j in range(0, len(keys), 256):
                    s = slice(j, j + 256)
                    yield batch_of({"key": pa.array(keys[s], kind), "n_bytes": pa.array(rows[0][s], pa.int64()), "spans": pa.array(rows[1][s], runs), "kept": pa.array(rows[2][s], pa.binary())})

    return cut


class Evidence(NamedTuple):
    """What the blocks hold in common."""

    blocks: DataFrame
    #: (anchor, context, block, n) of anchors that occur more than once
    places: DataFrame
    #: (anchor, context, whole, home, contexts): whole where the context itself repeats
    contexts: DataFrame
    #: (anchor, context, place, bytes, whole) of anchors with several contexts, up to CAP, and beyond
    few: DataFrame
    many: DataFrame


def evidence(df: DataFrame, key: str, text: str) -> Evidence:
    blocks = packed_blocks(df, key, text)
    rows = arrow_map(blocks, _anchor_rows, "anchor bigint, context bigint, block bigint, n int")
    often = rows.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    some = stored(rows.join(stored(often), "anchor"))  # of two scans, so that Spark may split a hot anchor
    each = stored(some.groupBy("anchor", "context").agg((F.sum("n") > 1).alias("whole"), F.min("block").alias("home")))
    sides = stored(each.groupBy("anchor").agg(F.count("*").alias("contexts")))
    each = stored(each.join(sides, "anchor").where("whole OR contexts > 1"))
    asked = each.where("contexts > 1").groupBy(F.col("home").alias("block")).agg(F.collect_list(F.struct("anchor", "context")).alias("asked"))
    sent = arrow_map(blocks.join(asked, "block").select("block", "sizes", "data", "asked"), _asked_contexts, "anchor bigint, context bigint, place int, bytes binary")
    size = each.where("contexts > 1").select("anchor", "context", "contexts", "whole")
    sent = stored(sent.join(size, ["anchor", "context"]))
    own = ("anchor", "context", "place", "bytes", "whole")
    few = sent.where(F.col("contexts") <= CAP).select(*own).repartition("anchor").sortWithinPartitions("anchor")
    return Evidence(blocks, some, each, few, sent.where(F.col("contexts") > CAP).select(*own))


def _hot_strings(e: Evidence) -> DataFrame:
    """(anchor, context, start, string) of the strings of LENGTH bytes that several contexts of a hot anchor hold, or one that repeats."""
    many = arrow_map(e.many, _strings, "anchor bigint, context bigint, whole boolean, start int, string bigint")
    twice = many.groupBy("anchor", "string").agg(F.min("context").alias("least"), F.max("context").alias("most"), F.bool_or("whole").alias("whole"))
    twice = twice.where("least != most OR whole").select("anchor", "string")
    return many.join(twice, ["anchor", "string"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) for each row of df: the removed ranges of bytes and the remaining bytes."""
    e = evidence(df, key, text)
    ranges = arrow_map(e.few, _ranges_by_anchor, "anchor bigint, context bigint, start int, end int")
    hot = _hot_strings(e).select("anchor", "context", "start", (F.col("start") + LENGTH).alias("end"))
    ranges = stored(ranges.unionByName(hot))
    places, none = e.places.select("block", "anchor", "context"), F.lit(None).cast("int")
    whole = places.join(e.contexts.where("whole").select("anchor", "context"), ["anchor", "context"]).select("block", "anchor", "context", none.alias("start"), none.alias("end"))
    part = places.join(e.contexts.where("NOT whole").select("anchor", "context"), ["anchor", "context"], "left_semi").join(ranges, ["anchor", "context"]).select("block", "anchor", "context", "start", "end")
    marks = whole.unionByName(part).groupBy("block").agg(F.collect_list(F.struct("anchor", "context", "start", "end")).alias("marks"))
    kind = e.blocks.schema["keys"].dataType.elementType
    out = arrow_map(e.blocks.join(marks, "block", "left").select("keys", "sizes", "data", "marks"), _cut(to_arrow_type(kind)), f"key {kind.simpleString()}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("key", key)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least so many bytes: (length, sorted (text, start) of all occurrences).

    The same scan over the full suffix array of a few texts: an interval is a
    right-maximal repeat; it is maximal where the bytes before its occurrences
    are diverse (a text's start differs from everything).
    """
    suffixes = sorted(((t, i) for t, x in enumerate(texts) for i in range(len(x))), key=lambda s: texts[s[0]][s[1] :])
    lcp = [common(texts[t][i:], texts[u][j:]) for (t, i), (u, j) in zip(suffixes, suffixes[1:], strict=False)]
    out = []
    for depth, a, b in intervals(lcp):
        own = suffixes[a : b + 1]
        if depth >= least and len({texts[t][i - 1] if i else -1 - t for t, i in own}) > 1:
            out.append((depth, sorted(own)))
    return sorted(out)


#: DuckDB SQL for the query: every string of LENGTH bytes is compared.
ORACLE = f"""
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
str AS (SELECT doc_id, i, md5(array_slice(t, i + 1, i + {LENGTH})) AS h FROM (SELECT doc_id, t, unnest(range(0, n - {LENGTH - 1})) AS i FROM doc)),
hit AS (SELECT doc_id, i FROM str WHERE h IN (SELECT h FROM str GROUP BY h HAVING count(*) > 1)),
edge AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true) AS new FROM hit),
run AS (SELECT doc_id, i, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM run GROUP BY doc_id, r),
side AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT s.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(hex(t), 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(hex(any_value(t)), 2 * max(z) + 1) AS kept FROM side s JOIN doc d ON s.doc_id = d.doc_id GROUP BY s.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN kept IS NULL THEN t ELSE unhex(kept) END) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""
