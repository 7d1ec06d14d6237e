"""The model of langid learned from all labelled documents, in tables instead of in memory.

Words, their counts by language and their character n-grams are those of
langid, and so are scores and familiarity; nothing here is sampled. What grows
with the corpus stays in tables: a row for each word of any document, a row for
each n-gram of a learned word.

A text belongs to one of FOLDS folds by a hash, and is as familiar as the
labelled texts of the other folds make it. So all labelled documents are learned
from, familiarity is measured on all of them, and no text, labelled or not,
vouches for itself or for its copies. Languages are predicted from all folds.

Words meet documents in two ways with one result: the COMMON words of the most
documents are sent to the workers, which add them up; what is left is rows
(document, word), joined with the table of words. So no frequent word meets in
one task. Sums are of whole numbers, UNIT for one, so their order doesn't count.

Defined cases: those of langid; where no label has a word, judge() returns None.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, batch_of, resident, stored
from .langid import LEAST_WORDS, MAX_N, SHARE, SMOOTHING, TRIED, tokens, words_of

FOLDS, UNIT = 3, 1_000_000
#: Words that are sent to the workers, and the letters that one of these has at most.
COMMON, COMMON_LETTERS = 1 << 16, 64
#: Counts that a task holds before it passes them on.
HELD = 200_000
#: A count in one number: its folds in the lowest bits, occurrences above them, documents above these.
COUNT_AT, ROWS_AT = FOLDS, 48
COUNTS = "lang string, {} string, n bigint, rows bigint, folds int"


def _fold(text: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def _packed(own: dict[str | None, dict], name: str) -> pa.RecordBatch:
    """The counts by language, which are cleared."""
    langs, keys, sums = [], [], []
    for lang, counts in own.items():
        langs += [lang] * len(counts)
        keys += counts.keys()
        sums += counts.values()
    own.clear()
    got = {"lang": pa.array(langs, pa.string()), name: pa.array(keys, pa.binary()).cast(pa.string())}
    n, rows = [s % (1 << ROWS_AT) >> COUNT_AT for s in sums], [s >> ROWS_AT for s in sums]
    return batch_of(got | {"n": pa.array(n, pa.int64()), "rows": pa.array(rows, pa.int64()), "folds": pa.array([s % (1 << FOLDS) for s in sums], pa.int32())})


def _summed(counts: DataFrame, name: str) -> DataFrame:
    """One row (name, rows, folds, counts: a map by language) for each word or n-gram; one shuffle."""
    by_lang = counts.repartition(name).groupBy(name, "lang").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.bit_or("folds").alias("folds"))
    labelled = F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))
    return by_lang.groupBy(name).agg(F.sum("rows").alias("rows"), F.bit_or("folds").alias("folds"), F.map_from_entries(F.collect_list(labelled)).alias("counts"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, fold, text); the words of rows without a label have no folds."""
    own: dict[str | None, dict[bytes, int]] = {}
    for b in batches:
        for lang, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            counts = own.setdefault(lang, {})
            get, bit = counts.get, 0 if lang is None else 1 << fold
            for token, n in Counter(tokens(text)).items():
                add = (n << COUNT_AT) + (1 << ROWS_AT)
                for w in (token,) if token.isascii() else [w.encode() for w in words_of(token)]:
                    counts[w] = get(w, 0) + add | bit
        if sum(map(len, own.values())) > HELD:
            yield _packed(own, "word")
    yield _packed(own, "word")


def _cut(word: str, size: int) -> Iterator[Counter]:
    """The n-grams of a word, counted in pieces of at most HELD places, so that a very long word is never cut up at once."""
    s = f"^{word}$"
    for at in range(0, len(s) - size + 1, HELD):
        yield Counter(s[i : i + size] for i in range(at, min(at + HELD, len(s) - size + 1)))


def _count_grams(words: DataFrame, sizes: list[int]) -> DataFrame:
    """The n-grams of the learned words as (lang, gram, n, rows, folds), in parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, dict[bytes, int]] = {}
        for b in batches:
            for word, folds, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for size in sizes:
                    for piece in _cut(word, size):
                        grams = [(g.encode(), times) for g, times in piece.items()]
                        for lang, n in counts:
                            to = own.setdefault(lang, {})
                            for g, times in grams:
                                had = to.get(g, 0)
                                to[g] = ((had >> COUNT_AT) + times * n << COUNT_AT) | (had | folds) % (1 << FOLDS)
                        if len(word) > HELD and sum(map(len, own.values())) > HELD:
                            yield _packed(own, "gram")
            if sum(map(len, own.values())) > HELD:
                yield _packed(own, "gram")
        yield _packed(own, "gram")

    return arrow_map(words.where("folds > 0").select("word", "folds", "counts"), count, COUNTS.format("gram"))


def _spread(words: DataFrame, sizes: list[int]) -> DataFrame:
    """The n-grams of words as (id, size, gram, times): all sizes of words that weren't learned, TRIED letters of others."""

    def out(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * 4
        return batch_of({n: pa.array(c, t) for n, c, t in zip(("id", "size", "gram", "times"), cols, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for b in batches:
            for i, word, folds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for size in [TRIED] if folds else sizes:
                    for piece in _cut(word, size):
                        found += [(i, size, g, n) for g, n in piece.items()]
                        if len(found) >= HELD:
                            yield out(found)
                            found = []
        yield out(found)

    return arrow_map(words.select("id", "word", "folds"), spread, "id bigint, size int, gram string, times bigint")


def _scored(table: DataFrame, languages: list[str]) -> DataFrame:
    """table with scores: the log frequency of each row by language, among all learned rows, in UNITs."""
    learned = table.where("folds > 0")
    size = learned.count()
    totals = dict(learned.select(F.explode("counts").alias("lang", "n")).groupBy("lang").agg(F.sum("n")).collect())  # one row a language
    below = F.lit([float(totals[x] + SMOOTHING * size) for x in languages])
    score = F.zip_with(F.lit(languages), below, lambda x, all_: F.round(F.log((F.coalesce(F.element_at("counts", x), F.lit(0)) + SMOOTHING) / all_) * UNIT).cast("long"))
    return table.withColumn("scores", F.when(F.col("folds") > 0, score))


def learn(rows: DataFrame) -> tuple[list[str], DataFrame] | None:
    """The languages, and of all words of the rows (lang, fold, text): word, rows, known by fold, scores by language."""
    counted = arrow_map(rows.select("lang", "fold", "text"), _count_words, COUNTS.format("word"))
    words = stored(_summed(counted, "word").withColumn("id", F.monotonically_increasing_id()))
    languages = sorted(r[0] for r in words.select(F.explode("counts").alias("lang", "n")).select("lang").distinct().collect())
    if not languages:
        return None
    unseen = not words.where("folds = 0").isEmpty()
    sizes = list(range(1, MAX_N + 1)) if unseen else [TRIED]
    grams = stored(_scored(_summed(_count_grams(words, sizes), "gram"), languages).select("gram", "folds", "scores"))

    elsewhere = [F.col("folds").bitwiseAND(F.lit((1 << FOLDS) - 1 - (1 << f))) != 0 for f in range(FOLDS)]
    lacking = words.where(~F.array_min(F.array(*elsewhere)))
    met = _spread(lacking, sizes).join(grams, "gram", "left")
    shares = met.where(F.col("size") == TRIED).groupBy("id").agg(F.sum("times").alias("tried"), *(F.sum(F.when(e, F.col("times")).otherwise(0)).alias(f"hit{f}") for f, e in enumerate(elsewhere)))
    words = _scored(words, languages).join(shares, "id", "left")
    if unseen:
        by_size = met.join(words.where("folds = 0").select("id"), "id", "left_semi").where("scores IS NOT NULL").select("id", "size", "times", F.posexplode("scores").alias("i", "score"))
        by_size = by_size.groupBy("id", "i", "size").agg((F.sum(F.col("times") * F.col("score")) / F.sum("times")).alias("mean"))
        longest = by_size.groupBy("id", "i").agg(F.round(F.max_by("mean", "size")).cast("long").alias("score"))
        backoff = longest.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "score"))), lambda x: x["score"]).alias("backoff"))
        words = words.join(backoff, "id", "left").withColumn("scores", F.coalesce("scores", "backoff"))
    known = (F.when(e, F.lit(UNIT)).otherwise(F.round(F.col(f"hit{f}") * UNIT / F.col("tried"))).cast("long") for f, e in enumerate(elsewhere))
    return languages, stored(words.select("word", "rows", F.array(*known).alias("known"), "scores"))


def _common(words: DataFrame) -> DataFrame:
    """At most COMMON words, of the most documents; all of a power of two of these or none."""
    short = words.where(F.length("word") <= COMMON_LETTERS)
    sizes = short.groupBy(F.floor(F.log2("rows")).alias("power")).count().collect()  # a row for each power of two
    least, n = 1 << 62, 0
    for power, count in sorted(sizes, reverse=True):
        n += count
        if n > COMMON:
            break
        least = 1 << power
    return short.where(F.col("rows") >= least)


def judge(docs: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame | None:
    """One row (key, labelled, enough, words, known, lang_pred) for each row of docs, whose keys differ; stored.

    enough says whether a text has the words to be judged by known, lang_pred is
    null where there is a label or no word.
    """
    text_ = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), text_.alias("text"))
    rows = rows.select("key", "lang", _fold("text").alias("fold"), F.coalesce(F.size(F.split("text", r"\s+", LEAST_WORDS)) >= LEAST_WORDS, F.lit(False)).alias("enough"), "text")
    learned = learn(rows)
    if learned is None:
        return None
    languages, words = learned
    common = _common(words).select("word", "known", "scores").toArrow()
    at = {w.encode(): i for i, w in enumerate(common.column(0).to_pylist())}
    known_of = np.array(common.column(1).to_pylist(), np.int64).reshape(len(at), FOLDS)
    scores_of = np.array(common.column(2).to_pylist(), np.int64).reshape(len(at), len(languages))
    shared, identity = docs.sparkSession.sparkContext.broadcast((at, known_of, scores_of)), uuid.uuid4().hex

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums for each text, without a word, and one for each of its words that isn't common."""
        at, known_of, scores_of = resident(("common words", identity), lambda: shared.value)
        names = ("key", "labelled", "fold", "enough", "word", "n", "known", "scores")
        types = (pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * len(names)
            return batch_of({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

        found: list[tuple] = []
        for b in batches:
            for k, lang, fold, enough, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4).cast(pa.binary()).to_pylist(), strict=True):
                row, n_words, places, times = (k, lang is not None, fold, enough), 0, [], []
                for token, n in Counter(tokens(text)).items():
                    if (i := at.get(token)) is not None:
                        n_words += n
                        places.append(i)
                        times.append(n)
                        continue
                    for w in words_of(token):
                        n_words += n
                        if (i := at.get(w.encode())) is not None:
                            places.append(i)
                            times.append(n)
                        else:
                            found.append((*row, w, n, None, None))
                    if len(found) > HELD:
                        yield out(found)
                        found = []
                n, p = np.array(times, np.int64), np.array(places, np.intp)
                found.append((*row, None, n_words, int(n @ known_of[p, fold]), (n @ scores_of[p]).tolist() if lang is None else None))
                if len(found) > HELD:
                    yield out(found)
                    found = []
        yield out(found)

    parts = stored(arrow_map(rows, add_up, "key bigint, labelled boolean, fold int, enough boolean, word string, n bigint, known bigint, scores array<bigint>"))
    whole = parts.where("word IS NULL")
    rest = parts.where("word IS NOT NULL").drop("known", "scores").join(words.drop("rows"), "word")
    sums = whole.select("key", "labelled", "enough", F.col("n").alias("words"), "known")
    sums = sums.unionAll(rest.select("key", "labelled", "enough", F.lit(0).cast("long"), F.col("n") * F.element_at("known", F.col("fold") + 1)))
    sums = sums.groupBy("key").agg(F.first("labelled").alias("labelled"), F.first("enough").alias("enough"), F.sum("words").alias("words"), F.sum("known").alias("known"))
    scores = whole.where("NOT labelled AND n > 0").select("key", F.lit(1).cast("long").alias("n"), F.posexplode("scores").alias("i", "score"))
    scores = scores.unionAll(rest.where("NOT labelled").select("key", "n", F.posexplode("scores").alias("i", "score")))
    scores = scores.groupBy("key", "i").agg(F.sum(F.col("n") * F.col("score")).alias("score"))
    best = scores.groupBy("key").agg(F.max(F.struct("score", (-F.col("i")).alias("i")))["i"].alias("i"))
    best = best.select("key", F.element_at(F.lit(languages), 1 - F.col("i")).alias("lang_pred"))
    share = F.when(F.col("words") > 0, F.round(F.col("known") / UNIT / F.col("words"), 6)).otherwise(0.0)
    return stored(sums.join(best, "key", "left").select(F.col("key").alias(key), "labelled", "enough", "words", share.alias("known"), "lang_pred"))


def usual(judged: DataFrame) -> float:
    """The familiarity below which a text is unfamiliar, from all labelled texts of enough words; 0, which none lies below, where there are none."""
    middle = judged.where("labelled AND enough AND words > 0").agg(F.median("known")).first()[0]  # six digits: a million values at most
    return 0.0 if middle is None else SHARE * middle
