"""A full-text index that is kept: filled, changed, merged and searched.

Segments, slots and changes are those of quire.operators.segments. A segment has
`pages` (keys, place, number of words, the folded words) and `blocks`, a row for
each term and slot: the places with their term frequencies and page lengths, and in plain
columns how many they are, the greatest frequency and the least length. A
prefix is a range of terms.

A search takes three steps. The plain columns of the terms' blocks give the
document frequencies, corrected for dropped pages, and for each slot that has
all terms the greatest score that a page in it can reach. The slots with the
highest bounds are scored, which gives a score that the last hit has at least.
Then those slots are scored whose bound reaches it; the others' blocks aren't
read. The result is that of fulltext.bm25 over the pages that are in the index.

Defined cases: a search text without words finds nothing; a key that is added
again replaces its page; a key that isn't there can be removed; of pages with
one key in one change the last text in byte order stays; a null text is a page,
but not one of those whose mean length counts; an index without pages finds
nothing, and one to which none was ever added is an error, as its keys have no
types yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T

from .fulltext import B, CANDIDATES, K1, LEAST_IDF
from .segments import Segments

#: Slots that are scored first.
FIRST = 64


class Plan(NamedTuple):
    """What a search will read: the state, the terms' blocks, the slots with their bounds, and the score that hits have at least (None: any)."""

    state: dict
    blocks: DataFrame
    slots: DataFrame
    least: float | None
    idf: list[float]
    mean: float


class TextIndex(Segments):
    blocks = ("blocks",)
    own = ("dl", "words")

    @property
    def sums(self):
        return {"n": None, "sized": F.count("dl"), "length": F.sum("dl")}

    def _prepared(self, pages: DataFrame) -> DataFrame:
        rows = pages.select(*self.keys, T.tokens(self.content).alias("words"))
        dl = F.when(F.col("words").isNotNull(), F.size("words")).cast("long")
        return rows.select(*self.keys, dl.alias("dl"), F.array_join("words", " ").alias("words"))

    def _maker(self, kind: str) -> tuple[Callable[[np.ndarray, np.ndarray, list[str]], dict[str, pa.Array]], str]:
        def make(slots: np.ndarray, ats: np.ndarray, texts: list[str]) -> dict[str, pa.Array]:
            by_place = np.lexsort((ats, slots))
            slots, ats = slots[by_place], ats[by_place]
            words = pc.split_pattern(pa.array([texts[i] for i in by_place], pa.string()), " ")
            dls = pc.list_value_length(words).to_numpy().astype(np.int32)
            coded = words.flatten().dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            both, tfs = np.unique(rank[coded.indices.to_numpy()] * len(dls) + np.repeat(np.arange(len(dls)), dls), return_counts=True)
            term, page = np.divmod(both, len(dls))
            slot, tfs = slots[page], tfs.astype(np.int32)
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (slot[1:] != slot[:-1])))
            ends = pa.array(np.append(first, len(term)).astype(np.int32))
            listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x))
            out = {"term": coded.dictionary.take(pa.array(order[term[first]])), "slot": pa.array(slot[first]), "n": pa.array(np.diff(ends.to_numpy()))}
            out |= {"most": pa.array(np.maximum.reduceat(tfs, first)), "shortest": pa.array(np.minimum.reduceat(dls[page], first))}
            return out | {"ats": listed(ats[page]), "tfs": listed(tfs), "dls": listed(dls[page])}

        return make, "term string, slot bigint, n int, most int, shortest int, ats array<int>, tfs array<int>, dls array<int>"

    # Searches.

    def plan(self, query: str, limit: int = CANDIDATES, decimals: int = 6) -> Plan | None:
        """The first two steps of a search; None where nothing can be found."""
        state = self.folder.state()[1]
        terms = T.match_terms(query)
        if not terms or not state.get("segments") or not state["length"]:
            return None
        last = len(terms) - 1
        fits = [F.startswith("term", F.lit(t)) if i == last else F.col("term") == t for i, t in enumerate(terms)]
        any_fits = fits[0]
        for f in fits[1:]:
            any_fits = any_fits | f
        which = F.array_compact(F.array(*[F.when(f, i) for i, f in enumerate(fits)]))
        blocks = self._blocks(state, "blocks").where(any_fits).withColumn("i", F.explode(which))
        gone = self._dropped(state)
        # A prefix stands for several terms that share pages, and dropped pages don't count: only then places are read to count them.
        slots = self._counted(blocks.where(F.col("i") < last), gone, gone is not None) if last else None
        tail = self._counted(blocks.where(F.col("i") == last), gone, True)
        slots = (tail if slots is None else slots.unionByName(tail)).persist()
        try:
            df = {r["i"]: r["df"] for r in slots.groupBy("i").agg(F.sum("live").alias("df")).where("df > 0").collect()}  # a row for each term
            if len(df) <= last:
                return None
            n, mean = float(state["n"]), state["length"] / state["sized"]
            idf = [max(LEAST_IDF, math.log((n - df[i] + 0.5) / (df[i] + 0.5))) for i in range(len(terms))]
            weight = F.element_at(F.array(*[F.lit(x) for x in idf]), F.col("i") + 1)
            bound = weight * F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("shortest") / mean))
            bounded = slots.where("live > 0").groupBy("segment", "slot").agg(F.sum(bound).alias("bound"), F.count(F.lit(1)).alias("found")).where(F.col("found") == len(terms)).drop("found")
            first = bounded.orderBy(F.desc("bound"), "segment", "slot").limit(FIRST)
            blocks = blocks if gone is None else blocks.join(gone, ["segment", "slot"], "left")
            best = self._scored(blocks, first, idf, mean, decimals).orderBy(F.desc("score")).limit(limit)
            count, least = best.agg(F.count(F.lit(1)), F.min("score")).first()
        finally:
            slots.unpersist()
        return Plan(state, blocks, bounded, least if count == limit else None, idf, mean)

    def _counted(self, blocks: DataFrame, gone: DataFrame | None, places: bool) -> DataFrame:
        """(segment, slot, i, live, most, shortest): pages with term i in a slot, and what bounds their scores."""
        own = blocks.groupBy("segment", "slot", "i")
        bounds = (F.sum("most").cast("double").alias("most"), F.min("shortest").alias("shortest"))
        if not places:
            return own.agg(*bounds, F.sum("n").alias("live"))
        rows = own.agg(*bounds, F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
        if gone is not None:
            rows = rows.join(gone, ["segment", "slot"], "left").withColumn("ats", F.when(F.col("gone").isNull(), F.col("ats")).otherwise(F.array_except("ats", "gone")))
        return rows.select("segment", "slot", "i", "most", "shortest", F.size("ats").cast("long").alias("live"))

    def _scored(self, blocks: DataFrame, slots: DataFrame, idf: list[float], mean: float, decimals: int) -> DataFrame:
        """(segment, place, score) of the pages in slots that have all terms."""
        rows = blocks.join(slots, ["segment", "slot"], "left_semi")
        own = [F.col("gone")] if "gone" in blocks.columns else []
        rows = rows.select("segment", "slot", "i", *own, F.explode(F.arrays_zip("ats", "tfs", "dls")).alias("p"))
        if own:
            rows = rows.where("gone IS NULL OR NOT array_contains(gone, p.ats)")
        place = self._place("p.ats").alias("place")
        tf = [F.sum(F.when(F.col("i") == i, F.col("p.tfs"))).cast("double").alias(f"tf{i}") for i in range(len(idf))]
        rows = rows.groupBy("segment", "slot", place).agg(F.max("p.dls").cast("double").alias("dl"), *tf).where(" AND ".join(f"tf{i} IS NOT NULL" for i in range(len(idf))))
        score = F.lit(0.0)
        for i, w in enumerate(idf):
            score = score + F.lit(w) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        return rows.select("segment", "place", F.round(score, decimals).alias("score"))

    def search(self, query: str, limit: int = CANDIDATES, decimals: int = 6) -> DataFrame:
        """(keys, score): pages with all terms of the query, the last of which is a prefix; best first, ties by key."""
        plan = self.plan(query, limit, decimals)
        if plan is None:
            state = self.folder.state()[1]
            if not state.get("segments"):
                raise ValueError(f"there is no index at {self.folder.path}")
            return self._of(state["segments"][0]["pages"]).select(*self.keys, F.lit(0.0).alias("score")).where(F.lit(False))
        slots = self.reached(plan, decimals)
        hits = self._scored(plan.blocks, slots, plan.idf, plan.mean, decimals)
        if plan.least is not None:
            hits = hits.where(F.col("score") >= plan.least)
        pages = self._live(plan.state).select("segment", "place", *self.keys)
        return pages.join(hits, ["segment", "place"]).select(*self.keys, "score").orderBy(F.desc("score"), *self.keys).limit(limit)

    @staticmethod
    def reached(plan: Plan, decimals: int = 6) -> DataFrame:
        """The slots that the last step reads: rounding aside, those whose bound is below plan.least hold no hit."""
        return plan.slots if plan.least is None else plan.slots.where(F.col("bound") >= plan.least - 10.0**-decimals)
