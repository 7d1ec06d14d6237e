"""A stored index of page texts that finds the pages which contain a quote, by fingerprints.

Texts are normalised as they are compared. Of each WINDOW neighbouring runs of
RUN characters the one with the least hash is a fingerprint of the page
(winnowing): a quote of GUARANTEED = RUN + WINDOW - 1 characters or more holds
whole windows, whose fingerprints every page that contains it has too, so its
rarest fingerprint is a key of all its pages, and one that no page has says that
there is none. Shorter quotes take an exact way of the same form: a page's runs
of one, two and three characters are stored too, and such a quote is looked for
by its rarest one.

Segments, slots and changes are those of quire.operators.segments; `prints` and
`runs` have a row for each key and slot with the places that have it, and how
many, in runs sorted by key. A search makes the quotes' keys, reads the rows of these,
takes the rarest of each quote, and compares the folded texts of the pages that
come out. No text but the quotes is cut.

Defined cases: an empty quote, or one without letters and digits where texts are
normalised, is nowhere; equal quotes are looked for once; a null text is a page
that contains nothing; a key that is added again replaces its page; an index to
which nothing was ever added is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.text import normalized

from .segments import SLOT_BITS, Segments

RUN, WINDOW = 8, 13
GUARANTEED = RUN + WINDOW - 1
SHORT = (1, 2, 3)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a number over all 64 bits (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(text: str, n: int) -> np.ndarray:
    """The hash of each run of n characters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(code) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _FACTOR + code[i : len(code) - n + 1 + i]
    return _mixed(h)


def prints(text: str) -> np.ndarray:
    """The distinct fingerprints of a text; none for a text under GUARANTEED characters."""
    h = run_hashes(text, RUN)
    if len(h) < WINDOW:
        return np.empty(0, np.int64)
    least = h[: len(h) - WINDOW + 1].copy()
    for i in range(1, WINDOW):
        np.minimum(least, h[i : len(h) - WINDOW + 1 + i], out=least)
    return np.unique(least).view(np.int64)


def runs(text: str, sizes: Sequence[int] = SHORT) -> np.ndarray:
    """The distinct runs of a text of one to three characters, as hashes."""
    return np.unique(np.concatenate([run_hashes(text, n) for n in sizes])).view(np.int64)


def quote_runs(needle: str) -> np.ndarray:
    """The keys of a short quote: its longest runs."""
    return runs(needle, (min(len(needle), SHORT[-1]),))


def _hashed(rows: DataFrame, keep: Sequence[str], text: str, columns: dict[str, Callable[[str], np.ndarray]]) -> DataFrame:
    """rows with the hashes that each function gives of a text, as arrays."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            made = [pa.array([fn(t) for t in texts], pa.list_(pa.int64())) for fn in columns.values()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, *columns])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} array<long>" for c in columns)])
    return rows.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


class QuoteIndex(Segments):
    blocks = ("prints", "runs")
    own = ("folded",)

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("document_id", "page_number"), content: str = "content", slot_bits: int = SLOT_BITS, fold: Callable[[Column | str], Column] = normalized):
        super().__init__(spark, path, keys, content, slot_bits)
        self.fold = fold

    def _prepared(self, pages: DataFrame) -> DataFrame:
        return pages.select(*self.keys, self.fold(self.content).alias("folded"))

    def _maker(self, kind: str) -> tuple[Callable[[np.ndarray, np.ndarray, list[str]], dict[str, pa.Array]], str]:
        hashes = {"prints": prints, "runs": runs}[kind]

        def make(slots: np.ndarray, ats: np.ndarray, texts: list[str]) -> dict[str, pa.Array]:
            own = [hashes(t) for t in texts]
            keys, page = np.concatenate(own), np.repeat(np.arange(len(own)), [len(k) for k in own])
            order = np.lexsort((ats[page], slots[page], keys))
            keys, page = keys[order], page[order]
            slot = slots[page]
            changed = (keys[1:] != keys[:-1]) | (slot[1:] != slot[:-1])
            first = np.flatnonzero(np.append(True, changed)) if len(keys) else np.empty(0, np.int64)
            ends = np.append(first, len(keys)).astype(np.int32)
            return {"key": pa.array(keys[first]), "slot": pa.array(slot[first]), "n": pa.array(np.diff(ends)), "ats": pa.ListArray.from_arrays(pa.array(ends), pa.array(ats[page]))}

        return make, "key bigint, slot bigint, n int, ats array<int>"

    def found(self, needles: DataFrame) -> DataFrame:
        """(needle, keys, folded) of the pages that contain a needle; needles: (needle), folded and distinct."""
        state = self.folder.state()[1]
        if not state.get("segments"):
            raise ValueError(f"there is no index at {self.folder.path}")
        needles = needles.where("needle != ''")
        by = {"prints": (needles.where(F.length("needle") >= GUARANTEED), prints), "runs": (needles.where(F.length("needle") < GUARANTEED), quote_runs)}
        places = None
        for kind, (own, keys) in by.items():
            asked = _hashed(own, ("needle",), "needle", {"keys": keys}).select("needle", F.size("keys").alias("of"), F.explode("keys").alias("key"))
            blocks = self._blocks(state, kind)
            there = blocks.join(asked.select("key").distinct(), "key", "left_semi")
            often = there.groupBy("key").agg(F.sum("n").alias("df"))
            # A needle of which a key is nowhere is nowhere itself.
            rarest = asked.join(often, "key").groupBy("needle").agg(F.min(F.struct("df", "key"))["key"].alias("key"), F.count(F.lit(1)).alias("got"), F.max("of").alias("of")).where("got = of")
            hit = there.select("key", "segment", "slot", "ats").join(rarest.select("needle", "key"), "key").select("needle", "segment", "slot", F.explode("ats").alias("at"))
            places = hit if places is None else places.unionByName(hit)
        pages = self._live(state).select("segment", "slot", "at", *self.keys, "folded")
        return pages.join(places, ["segment", "slot", "at"]).where(F.contains("folded", F.col("needle"))).select("needle", *self.keys, "folded")

    def locate(self, quotes: DataFrame) -> DataFrame:
        """(quote_id, keys) of every page that contains a quote; quotes: (quote_id, quote)."""
        asked = quotes.select("quote_id", self.fold("quote").alias("needle"))
        return self.found(asked.select("needle").distinct()).drop("folded").join(asked, "needle").select("quote_id", *self.keys)
