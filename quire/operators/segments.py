"""What the stored indexes share: immutable segments of pages, lists of dropped places, changes and merges.

A segment holds the pages of one change in order of their keys. A page has a
place in it, and SLOT neighbouring places make a slot; an index has a row for
each of its terms and slot, so no frequent term makes a large row (a slot of more
than HELD characters has several). The pages keep what blocks are made of, so a
task makes the blocks of its pages alone, no posting is ever shuffled, and
merge() makes them anew. Rows are sorted by term in runs, each of about HELD
characters of pages, so by the minima and maxima of Parquet's pages a search
reads those that may have its terms. A page that goes is written to a list of
dropped places, and merge() makes one segment of what is left, file by file, in the
tasks that read it: texts move to another task only where the list is too long to be
broadcast, and then once. The newest state (quire.sources.commits) names what belongs to the
index, so a reader sees a change whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.sources.commits import Folder

#: Places in a slot, as a power of two.
SLOT_BITS = 10
#: Characters of pages of which a task makes blocks at once.
HELD = 4 << 20


def _runs(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Slots, places in them and texts of pages, about so many characters together; pages without text are left out."""
    own: list[tuple[int, int, str]] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[2]:
                own.append(row)
                size += len(row[2])
                if size >= held:
                    yield np.array([r[0] for r in own]), np.array([r[1] for r in own], np.int32), [r[2] for r in own]
                    own, size = [], 0
    if own:
        yield np.array([r[0] for r in own]), np.array([r[1] for r in own], np.int32), [r[2] for r in own]


class Segments:
    """Sub-classes name their tables of blocks, what pages keep and how blocks are made of that."""

    blocks: Sequence[str] = ()
    #: The columns of a segment's pages that are made of the content; blocks are made of the last one.
    own: Sequence[str] = ()
    #: Numbers of the state that are sums over the live pages, with the column that is summed; null: a count of rows.
    sums: dict[str, Column | None] = {"n": None}

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("doc_id",), content: str = "text", slot_bits: int = SLOT_BITS):
        self.spark, self.keys, self.content, self.slot_bits = spark, list(keys), content, slot_bits
        self.folder = Folder(spark, path)

    def _prepared(self, pages: DataFrame) -> DataFrame:
        """(keys, own) of pages (keys, content)."""
        raise NotImplementedError

    def _maker(self, kind: str) -> tuple[Callable[[np.ndarray, np.ndarray, list[str]], dict[str, pa.Array]], str]:
        """What makes a run of blocks of slots, places and texts, and the schema of that."""
        raise NotImplementedError

    def _write_segment(self, rows: DataFrame) -> dict[str, str]:
        """Writes the tables of a segment; rows: (keys, own), a row for each key."""
        out = {"pages": self.folder.fresh("pages")} | {k: self.folder.fresh(k) for k in self.blocks}
        self._numbered(rows, out["pages"])
        for kind in self.blocks:
            blocks = self._made(kind, out["pages"]).select(F.lit(out["pages"]).alias("segment"), "*")
            blocks.write.option("compression", "zstd").parquet(self.folder.at(out[kind]))
        return out

    def _made(self, kind: str, pages: str) -> DataFrame:
        """The blocks of a segment's pages; each task makes those of the pages that it reads, so nothing is shuffled."""
        make, schema = self._maker(kind)
        held = HELD

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slots, ats, texts in _runs(batches, held):
                made = make(slots, ats, texts)
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

        return self._of(pages).select("slot", "at", self.own[-1]).mapInArrow(run, schema)

    # Changes.

    def change(self, pages: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Adds pages (keys and content), replacing those that have their keys, and removes the pages of the keys in gone; both at once."""
        number, state = self.folder.state()
        state = state or {"segments": [], "dropped": [], **dict.fromkeys(self.sums, 0)}
        new = dict(state)
        leaving = None if gone is None else gone.select(*self.keys)
        if pages is not None:
            last = Window.partitionBy(*self.keys).orderBy(F.desc_nulls_last(self.content))
            # Equal keys are in one range, so the texts are shuffled once.
            ranged = pages.select(*self.keys, self.content).repartitionByRange(*self.keys)
            single = ranged.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
            segment = self._write_segment(self._prepared(single).sortWithinPartitions(*self.keys))
            added = self._of(segment["pages"])
            new |= self._summed(added, new, 1)
            leaving = added.select(*self.keys) if leaving is None else leaving.union(added.select(*self.keys))
        if leaving is not None and state["segments"]:
            lost = self._live(state).join(leaving.distinct(), self.keys, "left_semi")
            name = self.folder.fresh("dropped")
            lost.select("segment", "slot", "at", *[c for c in lost.columns if c == "dl"]).write.parquet(self.folder.at(name))
            left = self._summed(self._of(name), new, -1)
            if left["n"] != new["n"]:
                new |= left | {"dropped": [*state["dropped"], name]}
        if pages is not None:
            new["segments"] = [*state["segments"], segment]
        self.folder.commit(number, new)

    def _summed(self, rows: DataFrame, state: dict, sign: int) -> dict[str, int]:
        own = rows.agg(*[(F.count(F.lit(1)) if c is None else F.coalesce(c, F.lit(0))).alias(n) for n, c in self.sums.items()]).first()
        return {n: state[n] + sign * own[n] for n in self.sums}

    def add(self, pages: DataFrame) -> None:
        self.change(pages)

    def remove(self, keys: DataFrame) -> None:
        self.change(gone=keys)

    def replace(self, of: DataFrame, keys: Sequence[str], pages: DataFrame) -> None:
        """The pages whose leading keys are in `of` go and pages come: a document's pages after it was extracted again."""
        state = self.folder.state()[1]
        known = self._live(state).join(of.select(*keys).distinct(), list(keys), "left_semi").select(*self.keys) if state.get("segments") else None
        self.change(pages, known)

    def merge(self) -> None:
        """One segment of the pages that are left; what the two newest states don't name goes."""
        number, state = self.folder.state()
        if not state.get("segments"):
            return
        # Live keys are distinct and stored in order, so the pages stay with the tasks that read them, and none are held to be sorted.
        segment = self._write_segment(self._live(state).select(*self.keys, *self.own))
        self.folder.commit(number, state | {"segments": [segment], "dropped": []})
        kept = [n for back in (0, 1) for s in (self.folder.state(back)[1],) for n in [*s.get("dropped", []), *(x for g in s.get("segments", []) for x in g.values())]]
        for kind in ("pages", *self.blocks, "dropped"):
            for name in self.folder.names(kind):
                if name not in kept:
                    self.folder.delete(name)

    # Tables.

    def _of(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*[self.folder.at(n) for n in names])

    def _numbered(self, rows: DataFrame, name: str) -> None:
        """Writes rows with a place each, by which those that follow one another in a task are neighbours."""
        placed = rows.withColumn("place", F.monotonically_increasing_id())
        placed.select("*", F.shiftright("place", self.slot_bits).alias("slot"), (F.col("place") % (1 << self.slot_bits)).cast("int").alias("at"), F.lit(name).alias("segment")).write.option("compression", "zstd").parquet(self.folder.at(name))

    def _place(self, at: str = "at") -> Column:
        return F.shiftleft("slot", self.slot_bits) + F.col(at)

    def _dropped(self, state: dict) -> DataFrame | None:
        """(segment, slot, gone): the places of each slot that don't count any more."""
        if not state["dropped"]:
            return None
        return self._of(*state["dropped"]).groupBy("segment", "slot").agg(F.collect_set("at").alias("gone"))

    def _live(self, state: dict) -> DataFrame:
        """(keys, ..., place, slot, at, segment) of the pages that the index holds."""
        pages = self._of(*[s["pages"] for s in state["segments"]])
        if not state["dropped"]:
            return pages
        return pages.join(self._of(*state["dropped"]).select("segment", "slot", "at"), ["segment", "slot", "at"], "left_anti")

    def _blocks(self, state: dict, kind: str) -> DataFrame:
        return self._of(*[s[kind] for s in state["segments"]])
