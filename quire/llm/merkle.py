"""A Merkle manifest of a dataset: a tree for each group of rows, one tree over their roots, and a proof for every row.

The rows of a group are its leaves in ascending order; while more than one node
is left, every ARITY consecutive ones become the hash of their digests, and what
is left is the group's subroot. The subroots, in order of their groups, are
joined in the same way to the root. Digests are lowercase hex SHA-256 and are
hashed as that text.

Building goes bottom-up, a table for each level, written to the shared folder:
a parent holds its digest and those of its children (`run`). Proving goes
top-down over these tables: the root's proof is empty, and at each level the
children are joined to their parents, where each one puts its siblings, left and
right of it, before the suffix that the parent has inherited. So a step shuffles
the nodes of one level, an eighth of those below, and a leaf's proof is made
once, when the leaves are read. fold() walks such a proof from any digest up.

Places are given without bringing a group together: keys are dealt by range,
each partition numbers its own rows, and the sizes of the partitions (a row for
each of them) say where it begins. A group is a range of places, so a group that
holds most rows is many partitions like any other.

Defined cases: a null field hashes as `-`, other than an empty one, which is
`0:`; a null group is a group of its own and the first; null keys come first in
their group; rows of one group with one key stand in order of their digests, and
equal rows take places beside each other; an empty table has an empty manifest
without a root; one leaf is its own subroot and one subroot is the root, with an
empty proof, whose hash is that of the empty text; texts are hashed whole; other
columns aren't read, and the results have none of their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

ARITY = 8
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row number holds its partition's number above this bit.
PARTITION_BITS = 33
_PROOF = "array<struct<left:string,right:string>>"


class Manifest(NamedTuple):
    """levels: of the groups' trees, from the leaves up; top: those of the tree over the subroots; groups: (group, tree, n)."""

    levels: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: str | None


def leaf_digest(*fields: Column) -> Column:
    """Hash of the fields, each with its length in UTF-8 bytes before it, so that no two rows have one text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`, the number of each row in this order from 0, stored."""
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", PARTITION_BITS)
    sizes = rows.groupBy(part.alias("_part")).count()
    first = sizes.select("_part", F.expr("sum(count) OVER (ORDER BY _part) - count").alias("_first"))
    # A row for each partition: its number of rows is that of the tasks, whatever the data are.
    rows = rows.withColumn("_part", part).join(F.broadcast(first), "_part")
    own = F.col("_n") - F.shiftleft(F.col("_part"), PARTITION_BITS)
    return rows.withColumn("place", F.col("_first") + own).drop("_n", "_part", "_first")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """leaves: (tree, pos, n, digest, ...), n the number of the tree's nodes at this level. Trees that are down to one node end there."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = levels[-1].where("n > 1")
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        up = nodes.groupBy("tree", F.expr(f"pos DIV {ARITY}").alias("pos")).agg(F.expr(f"(max(n) + {ARITY - 1}) DIV {ARITY}").alias("n"), run.alias("run"))
        levels.append(stored(up.withColumn("digest", F.sha2(F.concat_ws("", "run"), 256))))
        most = -(-most // ARITY)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the trees' last nodes."""
    out = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        out = out.union(level.where("n = 1").select("tree", "digest"))
    return out


def _push(levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """The leaves with `proof` and what else seeds has for their tree; seeds: (tree, proof, ...), what the tree's root inherits."""
    more = [c for c in seeds.columns if c not in ("tree", "proof")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        own = [F.col(c) for c in level.columns]
        out = level.where("n = 1").join(seeds, "tree").select(*own, "proof", *more)
        if above is not None:
            up = above.select("tree", F.col("pos").alias("_parent"), F.col("run").alias("_run"), F.col("proof").alias("_suffix"), *more)
            i = (F.col("pos") % ARITY).cast("int")
            left, right = F.concat_ws("", F.slice("_run", 1, i)), F.concat_ws("", F.slice("_run", i + 2, ARITY))
            inner = level.where("n > 1").withColumn("_parent", F.expr(f"pos DIV {ARITY}")).join(up, ["tree", "_parent"])
            proof = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("_suffix"))
            out = out.unionByName(inner.select(*own, proof.alias("proof"), *more))
        above = stored(out) if k else out
    return above


def build(df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of df; leaves have the key as `key`, their digest and the columns of keep."""
    keep = keep or {}
    leaf = leaf_digest(*[F.col(f) for f in fields])
    # Written before they are sorted, so that the sampling of ranges doesn't hash the texts once more.
    rows = stored(df.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("digest"), *[c.alias(f"keep_{n}") for n, c in keep.items()]))
    rows = placed(rows, "group", "key", "digest")
    groups = rows.groupBy("group").agg(F.min("place").alias("_begin"), F.count(F.lit(1)).alias("n"))
    groups = stored(placed(groups, "group").withColumnRenamed("place", "tree"))
    leaves = rows.join(groups.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")))
    leaves = stored(leaves.select("tree", (F.col("place") - F.col("_begin")).alias("pos"), "n", "digest", "key", *[f"keep_{n}" for n in keep]))
    levels = _levels(leaves)
    n = groups.count()
    # A subroot for each group, written once more: the tree over them reads it at every level.
    subroots = stored(_roots(levels).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"), "digest"))
    top = _levels(subroots)
    root = _roots(top).first()
    return Manifest(levels, top, groups.select("group", "tree", "n"), root and root["digest"])


def proofs(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof, kept columns) of every leaf. A proof has the left and right siblings of each level, from the leaf up."""
    spark = manifest.groups.sparkSession
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(_PROOF).alias("proof"))
    tops = _push(manifest.top, start)
    seeds = stored(tops.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "proof"))
    leaves = _push(manifest.levels, seeds)
    kept = [F.col(c).alias(c.removeprefix("keep_")) for c in leaves.columns if c.startswith("keep_")]
    return leaves.select("key", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"), "proof", *kept)


def proof_digest(proof: str = "proof") -> Column:
    """Hash of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda p: F.concat(p["left"], p["right"]))), 256)


def fold(digest: Column, proof: str = "proof") -> Column:
    """The root that a digest comes to with these siblings; a level without any is a run of one, which is hashed too."""
    return F.aggregate(proof, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


#: Levels that the SQL is written out for: ARITY ** LOWER rows a group, ARITY ** UPPER groups.
LOWER, UPPER = 8, 4


def _sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda c, b: {step}))"


def _sql_levels(name: str, depth: int) -> str:
    return ",\n".join(
        f"{name}{k + 1} AS (SELECT tree, pos // {ARITY} AS pos, any_value((n + {ARITY - 1}) // {ARITY}) AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, list(digest ORDER BY pos) AS run FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // {ARITY})"
        for k in range(depth)
    )


def _sql_walk(name: str, depth: int, rows: str, at: str, last: str) -> str:
    """Steps that join rows (tree, at, proof, folded, ...) with their runs, level by level; the last has the name last."""
    steps = []
    for k in range(depth):
        i = f"CAST((w.{at} // {ARITY**k}) % {ARITY} AS INTEGER)"
        left, right = f"coalesce(array_to_string(p.run[1:{i}], ''), '')", f"coalesce(array_to_string(p.run[{i} + 2:], ''), '')"
        steps.append(f"{last if k == depth - 1 else f'{name}_w{k}'} AS (SELECT w.* REPLACE (CASE WHEN p.run IS NULL THEN w.proof ELSE w.proof || {left} || {right} END AS proof, CASE WHEN p.run IS NULL THEN w.folded ELSE sha256({left} || w.folded || {right}) END AS folded) FROM {rows if k == 0 else f'{name}_w{k - 1}'} w LEFT JOIN {name}{k + 1} p ON p.tree = w.tree AND p.pos = w.{at} // {ARITY ** (k + 1)})")
    return ",\n".join(steps)


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in (*FIELDS[:-1], text)) + ")"


#: DuckDB SQL for the query: rows of documents, of which every third or so, by the CRC-32 of its key, is tampered with.
ORACLE = f"""
WITH tampered AS (SELECT *, CASE WHEN {_sql_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents),
hashed AS (SELECT doc_id, lang, {_sql_leaf("text")} AS digest, {_sql_leaf("changed")} AS folded FROM tampered),
lower0 AS (SELECT doc_id, digest, folded, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
{_sql_levels("lower", LOWER)},
upper0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, digest FROM ({" UNION ALL ".join(f"SELECT tree, digest FROM lower{k} WHERE n = 1" for k in range(LOWER + 1))})),
{_sql_levels("upper", UPPER)},
root AS ({" UNION ALL ".join(f"SELECT digest AS root FROM upper{k} WHERE n = 1" for k in range(UPPER + 1))}),
started AS (SELECT tree, pos, doc_id, digest AS leaf, '' AS proof, folded FROM lower0),
{_sql_walk("lower", LOWER, "started", "pos", "halfway")},
lifted AS (SELECT 0 AS tree, h.tree AS at, doc_id, leaf, u.digest AS subroot, proof, folded FROM halfway h JOIN upper0 u ON u.pos = h.tree),
{_sql_walk("upper", UPPER, "lifted", "at", "walked")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM walked, root
"""
