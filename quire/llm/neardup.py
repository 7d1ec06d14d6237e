"""Near-duplicate documents: SuperMinHash signatures, banding, verification, components.

Signatures. Every shingle of a set holds a random permutation of the slots;
its rank j puts the value j + r, r uniform in [0, 1), into the slot at place j,
and a slot keeps the least value. Ranks are taken for all shingles at once, one
rank a round; the rounds end early, once every slot holds less than the next
rank. Large sets need one round.

Candidates. Bands of ROWS slots; their number makes the chance to miss a pair
at the threshold less than MISS. Documents with equal sets count as one class
from here on, so exact copies never meet in a bucket.

Links. In each bucket every class is compared with the bucket's first, which is
linear in the bucket's size; the full sets decide. Components of these links
settle most buckets. In a bucket that still holds several components the
classes outside the largest one are compared with all others: a block of those
outside with a block of all in each task, blocks having about CAP classes and
CAP_SHINGLES shingles. So no pair that shares a bucket stays undecided, and no
group is ever expanded into all its pairs or collected into one task.

Components grow by alternating large-star and small-star steps, each written to
the shared folder. What a bucket or a class has in common is written before it
is joined, so each join stands on two scans and adaptive execution can split a
hot bucket or a hub. Joins with a table of texts, classes or buckets ask for a
sort-merge join; those of the star steps and of the components' last names leave
it to Spark, which broadcasts a side while its stored table is small.

Defined cases: a null or empty text, or one without words, has no shingles and
is its own component; fewer words than a shingle form one shingle; rows with
equal texts are linked; a component is named by its least key, nulls left out
(a component of rows with null keys has a null name and all are kept); rows
with equal keys keep a row each; an empty table gives an empty result; very
long texts are used whole; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, batch_of, resident, stored

SHINGLE, THRESHOLD = 5, 80
ROWS, MISS = 4, 1e-5
#: Classes and shingles in a block of a bucket.
CAP, CAP_SHINGLES = 512, 1 << 19
#: Shared shingles that are counted at once.
AT_ONCE = 1 << 21
#: Words whose hash a worker remembers before it starts anew.
REMEMBERED = 250_000

# The constants of the 64-bit mixer.
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def bands_for(threshold: int) -> int:
    """Bands so that a pair of just this similarity (in hundredths) shares one, but for a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** ROWS)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text in UTF-8 as sorted 64-bit hashes; A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split() if text else []
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    if not size:
        return w
    n = len(w) - size + 1
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = mixed(x + w[i : i + n])
    return np.unique(x)


def signature(x: np.ndarray, slots: int) -> np.ndarray:
    """The SuperMinHash signature of hashed elements: rank in the upper, fraction in the lower 32 bits."""
    out = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    order, every = None, np.arange(len(x))
    for j in range(slots):
        r = mixed(x ^ mixed(np.array([j], np.uint64)))
        at = (j + (((r & low) * np.uint64(slots - j)) >> half)).astype(np.intp)
        if j == 0:
            place, first = at, at
        else:
            if order is None:  # the permutations so far: slot 0 and the first place swapped
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(x), 1))
                order[every, first] = 0
                order[:, 0] = first
            place = order[every, at].astype(np.intp)
            order[every, at] = order[:, j]
            order[:, j] = place
        np.minimum.at(out, place, np.uint64(j << 32) | (r >> half))
        if int(out.max()) < (j + 1) << 32:
            break
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band, its number included."""
    s = sig.reshape(-1, ROWS)
    x = np.arange(len(s), dtype=np.uint64)
    for i in range(ROWS):
        x = mixed(x + s[:, i])
    return x


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether the sets' intersection is at least threshold hundredths of their union."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(both) - shared)


def signed(df: DataFrame, key: str, text: str, size: int, threshold: int) -> DataFrame:
    """The stored table (key, n_shingles, digest of the set, bands, packed text)."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    slots = ROWS * bands_for(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = resident("words", WordHashes), zstandard.ZstdCompressor(3).compress
        for b in batches:
            n, digest, bands, packed = [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                x = shingles(t, size, hashes)
                n.append(len(x))
                digest.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                bands.append(band_hashes(signature(x, slots)).view(np.int64) if len(x) else None)
                packed.append(pack(t) if len(x) else None)
            yield batch_of({"key": b.column(0), "n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "packed": pa.array(packed, pa.binary())})

    return stored(arrow_map(rows, sign, f"key {rows.schema['key'].dataType.simpleString()}, n_shingles bigint, digest binary, bands array<bigint>, packed binary"), "snappy")


def compared(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    at = lambda side: texts.select(F.col("digest").alias(side), F.col("packed").alias(f"packed_{side}")).hint("merge")
    both = pairs.join(at("b"), "b").join(at("a"), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = resident("words", WordHashes), zstandard.ZstdDecompressor().decompress
        last, own = None, None  # rows with one a stand together after the join
        for rows in batches:
            keep = []
            for a, x, y in zip(*(rows.column(c).to_pylist() for c in ("a", "packed_a", "packed_b")), strict=True):
                if a != last:
                    last, own = a, shingles(unpack(x), size, hashes)
                keep.append(similar(own, shingles(unpack(y), size, hashes), threshold))
            yield batch_of({c: rows.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return arrow_map(both.select("a", "b", "packed_a", "packed_b"), verify, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(digest, component) for every class with a link: the least digest that it reaches."""
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        check = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == state or not check[0]:
            break
        state = check
        # Large star: each class's larger neighbours move to the least class around it.
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        links = stored(around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # Small star: each class and its smaller neighbours move to the least of these.
        least = stored(links.groupBy("u").agg(F.min("v").alias("m")))
        moved = links.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("l"))
        links = stored(moved.select(F.col("l.v").alias("u"), F.col("l.m").alias("v")).where("u != v").distinct())
    return links.select(F.col("u").alias("digest"), F.col("v").alias("component"))


def _undecided(size: int, threshold: int):
    """Links between components in a block pair of a bucket: of the classes that ask, with all there."""

    def link(rows: pa.Table) -> pa.Table:
        digest, root = rows.column("digest").to_pylist(), rows.column("component").to_pylist()
        hashes, unpack = resident("words", WordHashes), zstandard.ZstdDecompressor().decompress
        sets = [shingles(unpack(p), size, hashes) for p in rows.column("packed").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, term = np.unique(flat, return_inverse=True)
        order = np.argsort(term, kind="stable")
        owners, ends = owner[order], np.cumsum(np.bincount(term))
        starts, first = np.concatenate(([0], ends[:-1])), np.cumsum(sizes) - sizes
        roots = np.unique(np.array(root, object), return_inverse=True)[1]
        found: list[tuple[bytes, bytes]] = []
        for i in np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False)).tolist():
            own = term[first[i] : first[i] + sizes[i]]
            lengths, shared = ends[own] - starts[own], np.zeros(len(sets), np.int64)
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(lengths) // AT_ONCE)) + 1):
                n = lengths[part]
                places = np.repeat(starts[own[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared += np.bincount(owners[places], minlength=len(sets))
            near = np.flatnonzero((100 * shared >= threshold * (sizes[i] + sizes - shared)) & (roots != roots[i]))
            for j in near.tolist():
                if roots[j] != roots[i]:
                    found.append((digest[i], digest[j]))
                    roots[roots == roots[j]] = roots[i]
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return link


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of df; threshold in hundredths."""
    sets = signed(df, key, text, size, threshold)
    classes = stored(sets.where("digest is not null").groupBy("digest").agg(F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")))  # copies combine before they move
    banded = classes.select("digest", "n_shingles", F.explode("bands").alias("bucket"))
    some = F.xxhash64("digest")
    shared = stored(banded.groupBy("bucket").agg(F.count("*").alias("classes"), F.min(some).alias("first")).where("classes > 1"))
    members = stored(banded.join(shared.hint("merge"), "bucket").select("bucket", "digest", "n_shingles", (some == F.col("first")).alias("star")))
    one = sets.where("digest is not null").groupBy("digest").agg(F.any_value("packed").alias("packed"))
    texts = stored(one.join(stored(members.select("digest").distinct()).hint("merge"), "digest", "left_semi"), "snappy")
    stars = members.where("star").select("bucket", F.col("digest").alias("a"))
    pairs = members.join(stars.hint("merge"), "bucket").where("digest != a").select("a", F.col("digest").alias("b")).distinct()
    known = stored(components(compared(pairs, texts, size, threshold)))

    # Buckets with classes of several components, one of those with equal classes.
    placed = stored(members.join(known.hint("merge"), "digest", "left").select("bucket", "digest", "n_shingles", F.coalesce("component", "digest").alias("component")))
    where = F.xxhash64("component")
    each = placed.groupBy("bucket", where.alias("where")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.sum(some.cast("decimal(38,0)")).alias("all"))
    left = each.groupBy("bucket").agg(F.max_by("where", "n").alias("largest"), F.max("n").alias("most"), F.max_by("shingles", "n").alias("most_shingles"), F.count("*").alias("components"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.sum("all").alias("all"))
    blocks = lambda n, shingles: F.greatest(F.lit(1), F.ceil(F.greatest(n / CAP, shingles / CAP_SHINGLES))).cast("int")
    left = left.where("components > 1 AND n > 2").groupBy("n", "shingles", "all").agg(*[F.min_by(c, "bucket").alias(c) for c in ("largest", "most", "most_shingles")], F.min("bucket").alias("bucket"))
    left = stored(left.select("bucket", "largest", blocks(F.col("n"), F.col("shingles")).alias("of_all"), blocks(F.col("n") - F.col("most"), F.col("shingles") - F.col("most_shingles")).alias("outside")))
    asks, i, j = where != F.col("largest"), F.pmod(some, F.col("of_all").cast("long")).cast("int"), F.pmod(some, F.col("outside").cast("long")).cast("int")
    deal = lambda i, j, asks: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), asks.alias("asks"))
    own = F.transform(F.sequence(F.lit(0), F.col("outside") - 1), lambda x: deal(i, x, asks & (j == x)))
    asked = F.transform(F.filter(F.sequence(F.lit(0), F.col("of_all") - 1), lambda x: x != i), lambda x: deal(x, j, F.lit(True)))
    dealt = stored(placed.join(left.hint("merge"), "bucket").withColumn("at", F.explode(F.when(asks, F.concat(own, asked)).otherwise(own))).select("bucket", "at.i", "at.j", "at.asks", "digest", "component"))
    more = dealt.join(texts.hint("merge"), "digest").groupBy("bucket", "i", "j").applyInArrow(_undecided(size, threshold), "a binary, b binary")
    at = lambda side: known.select(F.col("digest").alias(side), F.col("component").alias(f"{side}_at"))
    more = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
    final = components(more).select(F.col("digest").alias("component"), F.col("component").alias("final"))

    named = sets.select("key", "n_shingles", "digest").join(known.hint("merge"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    # Both sides are written, so that the joins stand on plain scans and Spark may split a hot component.
    named = stored(named.join(stored(final), "component", "left").select("key", "n_shingles", F.coalesce("final", "component").alias("component")))
    linked = named.where("component is not null")
    least = stored(linked.groupBy("component").agg(F.min("key").alias("component_id")))
    alone = named.where("component is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    out = linked.join(least.hint("merge"), "component").select("key", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(size: int, threshold: int) -> str:
    """DuckDB SQL for near_duplicates over documents: all pairs that share a shingle, and all that each document reaches."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {threshold} * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM sets UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) ON id = doc_id
"""
