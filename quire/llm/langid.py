"""Language identification with a word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls
back to its character n-grams, from MAX_N characters down to one: the longest
length of which any n-gram is known decides, by the mean of their log
frequencies. A document's score is the mean over its words.

Beside the language there is `known`, how familiar a text is: a known word
counts 1, an unseen one the share of its TRIED-character n-grams that the model
has seen in any language; the mean over the words. Texts of languages that
weren't learned and random letters have a low one. calibrate() measures it on
labelled documents that the model didn't learn from, and unfamiliar() says
which texts lie below what these have.

The model comes from a bounded sample: MODEL_DOCS labelled documents, chosen by
a hash of their text (all where there are fewer). Each language gets an equal
share of them, and what one doesn't need goes to the others, so a rare language
stays whole beside a common one. All counts of the sample stay, with the n-grams
of all its words; the sample alone bounds the broadcast model.

Texts are cut into tokens at ASCII characters other than letters; a token's
words, scores and familiarity are remembered, so a frequent one costs a look-up.

Defined cases: a null text, or one without letters, is `und` with score 0 and
known 0, and so is every text where nothing is labelled; empty tables give empty
results; a null label isn't learned from; a tie goes to the first language in
order of name; repeated rows get equal results; very long texts are used whole;
other columns aren't read, and one that has the name of a result is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_map, batch_of, resident

MODEL_DOCS = 20_000
MAX_N = 5
#: Weight of a count that wasn't seen.
SMOOTHING = 0.5
#: Words up to which the evidence of a document adds up in its score.
EVIDENCE = 12
#: Length of the n-grams that tell whether an unseen word is familiar.
TRIED = 3
#: Labelled documents on which familiarity is calibrated, and the words that a text has at least to be judged by it.
CALIBRATION_DOCS, LEAST_WORDS = 5_000, 5
#: Texts are unfamiliar below this share of what half of the calibration texts have at least; a few wrong labels don't move it.
SHARE = 0.5
#: Tokens besides the model's words whose scores a worker remembers before it starts anew.
REMEMBERED = 250_000
#: Tokens of a text that are added up at once, in their order, so that equal texts have equal sums.
AT_ONCE = 1 << 18
#: Words whose n-grams are counted at once.
BUILT_AT_ONCE = 1 << 15

WORD = re.compile(r"[^\W\d_]+")
#: Lower-cases A-Z and turns every other ASCII character but letters into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def words_of(token: bytes) -> list[str]:
    """The words of a token: itself, unless it holds other than letters."""
    return WORD.findall(token.decode("utf-8", "replace").lower())


class Model(NamedTuple):
    """Words in UTF-8, as texts are cut, and n-grams, with their log frequencies by language."""

    languages: list[str]
    words: dict[bytes, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray


def _scores(c: np.ndarray) -> np.ndarray:
    c = c + SMOOTHING
    return np.log(c / c.sum(axis=0)).astype(np.float32)


def _gram_counts(words: list[str], n: np.ndarray, language: np.ndarray, k: int) -> tuple[list[str], np.ndarray]:
    """All n-grams of the words and their counts by language; a length at a time, each gram numbered by the one before it and a letter."""
    sizes = np.array([len(w) + 2 for w in words])
    text = "".join(f"^{w}$" for w in words)
    alphabet, letter = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    grams: list[str] = []
    parts, at, own = [], np.arange(len(text)), np.zeros(len(text), np.int64)
    for size in range(1, MAX_N + 1):
        fits = left[at] >= size
        at, own = at[fits], own[fits]
        _, first, own = np.unique(own * len(alphabet) + letter[at + size - 1], return_index=True, return_inverse=True)
        word = owner[at]
        parts.append(np.bincount(own * k + language[word], weights=n[word], minlength=len(first) * k).reshape(-1, k))
        grams += [text[i : i + size] for i in at[first].tolist()]
    return grams, np.concatenate(parts)


def build(counts: list[tuple[str, str, int]]) -> Model:
    """The model from (language, word, count)."""
    languages = sorted({x[0] for x in counts})
    k, words = len(languages), {}
    for _, word, _ in counts:
        words.setdefault(word.encode(), len(words))
    if not words:
        return Model(languages, words, {}, _scores(np.zeros((0, k))), _scores(np.zeros((0, k))))
    number = {x: i for i, x in enumerate(languages)}
    language, n = np.array([number[x[0]] for x in counts]), np.array([x[2] for x in counts], np.float64)
    seen = np.zeros((len(words), k))
    np.add.at(seen, ([words[x[1].encode()] for x in counts], language), n)
    grams: dict[str, int] = {}
    total = np.zeros((0, k))
    for at in range(0, len(counts), BUILT_AT_ONCE):
        part = slice(at, at + BUILT_AT_ONCE)
        names, found = _gram_counts([x[1] for x in counts[part]], n[part], language[part], k)
        row = np.fromiter((grams.setdefault(g, len(grams)) for g in names), np.intp, len(names))
        total = np.concatenate((total, np.zeros((len(grams) - len(total), k))))
        total[row] += found
    return Model(languages, words, grams, _scores(seen), _scores(total))


class Scorer:
    """Scores texts with a model.

    Each token has a row of summed scores, number of words and familiarity: the
    model's words for good, others until there are too many.
    """

    def __init__(self, model: Model):
        self.model = model
        self.at, self.more = dict(model.words), []
        self.rows = np.ones((len(model.words) + 1_024, len(model.languages) + 2), np.float32)
        self.rows[: len(model.words), :-2] = model.word_scores
        self.floor = model.gram_scores.min(axis=0) if len(model.gram_scores) else np.zeros(len(model.languages), np.float32)
        self.scores = np.concatenate((model.gram_scores, self.floor[None]))

    def _tried(self, word: str) -> tuple[list[int], float]:
        """The n-grams that decide for an unseen word, and the share of its n-grams that the model has."""
        s, get = f"^{word}$", self.model.grams.get
        n = min(TRIED, len(s))
        tried = [s[i : i + n] for i in range(len(s) - n + 1)]
        share = sum(map(self.model.grams.__contains__, tried)) / len(tried)
        for n in range(min(MAX_N, len(s)), 0, -1):
            if found := [g for i in range(len(s) - n + 1) if (g := get(s[i : i + n])) is not None]:
                return found, share
        return [len(self.scores) - 1], share

    def learn(self, new: list[bytes]) -> None:
        """Adds rows for tokens."""
        first, need = len(self.at), len(self.at) + len(new)
        self.more += new
        if need > len(self.rows):
            self.rows = np.concatenate((self.rows, np.ones((max(need - len(self.rows), need // 4), self.rows.shape[1]), np.float32)))
        grams: list[int] = []
        ends, owner, shares = [], [], []
        self.rows[first:need] = 0
        for i, token in enumerate(new, first):
            self.at[token] = i
            for w in (token.decode(),) if token.isascii() else words_of(token):
                self.rows[i, -2] += 1
                if (known := self.model.words.get(w.encode())) is not None:
                    self.rows[i, :-2] += self.model.word_scores[known]
                    self.rows[i, -1] += 1
                    continue
                found, share = self._tried(w)
                grams += found
                ends.append(len(grams))
                owner.append(i)
                shares.append(share)
        if owner:
            starts = np.array([0, *ends[:-1]])
            mean = np.add.reduceat(self.scores[grams].astype(np.float64), starts) / (np.array(ends) - starts)[:, None]
            np.add.at(self.rows[:, :-2], owner, mean)
            np.add.at(self.rows[:, -1], owner, shares)

    def __call__(self, texts: list[bytes | None]) -> list[tuple[str, float, float]]:
        """The language of each text, its score and how familiar the text is."""
        found = [tokens(t) for t in texts]
        if not self.model.languages:
            return [("und", 0.0, 0.0)] * len(texts)
        every = set().union(*found)
        if len(self.more) > REMEMBERED:
            for token in self.more:
                del self.at[token]
            self.more = []
        self.learn(sorted(every.difference(self.at)))
        return [self._judge(np.fromiter(map(self.at.__getitem__, f), np.intp, len(f))) for f in found]

    def _judge(self, at: np.ndarray) -> tuple[str, float, float]:
        total = sum((self.rows[at[i : i + AT_ONCE]].sum(axis=0, dtype=np.float64) for i in range(0, len(at), AT_ONCE)), np.zeros(self.rows.shape[1]))
        n = total[-2]
        if not n:
            return "und", 0.0, 0.0
        mean = total[:-2] / n
        weight = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        best = int(mean.argmax())
        return self.model.languages[best], round(float(weight[best] / weight.sum()), 6), round(float(total[-1] / n), 6)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", model_docs: int = MODEL_DOCS) -> Model:
    """A model from the rows with a text and a language; see the module for its bounds."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    have = dict(rows.groupBy("lang").count().collect())
    if sum(have.values()) > model_docs:
        steps, taken, left = 1 << 30, [], model_docs
        for i, (language, n) in enumerate(sorted(have.items(), key=lambda x: (x[1], x[0]))):
            share = min(n, max(1, left // (len(have) - i)))
            left -= share
            taken.append((language, math.ceil(steps * share / n)))
        limits = rows.sparkSession.createDataFrame(taken, "lang string, below bigint")  # one row a language
        rows = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("text"), F.lit(steps)) < F.col("below")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in own.items() for w, n in c.items()]
            own.clear()
            cols = list(zip(*flat, strict=True)) or [(), (), ()]
            return batch_of({"lang": pa.array(cols[0], pa.string()), "word": pa.array(cols[1], pa.string()), "n": pa.array(cols[2], pa.int64())})

        for b in batches:
            for language, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts = own.setdefault(language, Counter())
                for token, n in Counter(tokens(t)).items():
                    for w in words_of(token):
                        counts[w] += n
            if sum(map(len, own.values())) > 200_000:
                yield out()
        yield out()

    counted = arrow_map(rows, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    return build(list(zip(*(c.to_pylist() for c in found.columns), strict=True)))


class Sent(NamedTuple):
    """A model that the workers have, and what they know it by."""

    shared: Broadcast
    identity: str


def send(spark: SparkSession, model: Model) -> Sent:
    return Sent(spark.sparkContext.broadcast(model), uuid.uuid4().hex)


def identify(df: DataFrame, model: Model | Sent, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (key, columns in keep, lang_pred, score, known) for each row of df; a model that serves several calls is best broadcast by send()."""
    shared, identity = model if isinstance(model, Sent) else send(df.sparkSession, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(("language", identity), lambda: Scorer(shared.value))
        for b in batches:
            got = scorer(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist())
            found = {n: pa.array([g[i] for g in got], t) for i, (n, t) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()), ("known", pa.float64())))}
            yield batch_of(dict(zip(b.schema.names[:-1], b.columns[:-1], strict=True)) | found)

    rows = df.select(key, *keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return arrow_map(rows, predict, f"{schema}, lang_pred string, score double, known double")


def calibrate(labelled: DataFrame, model: Model | Sent, text: str = "text", lang: str = "lang", docs: int = CALIBRATION_DOCS) -> float:
    """The familiarity below which a text is unfamiliar, from labelled rows that the model didn't learn from.

    Measured on about docs of them (all where there are fewer), chosen by a hash
    of their text, with LEAST_WORDS words or more; 0, which no text lies below,
    where there are none.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))
    rows = rows.where(F.size(F.split("text", r"\s+")) >= LEAST_WORDS)
    n, steps = rows.count(), 1 << 30
    if n > docs:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < math.ceil(steps * docs / n))
    found = identify(rows.withColumn("id", F.lit(0)), model, key="id").where("lang_pred != 'und'")
    usual = found.agg(F.median("known")).first()[0]  # of a bounded sample
    return 0.0 if usual is None else SHARE * usual


def unfamiliar(least: float, text: str = "text") -> Column:
    """Whether a text of LEAST_WORDS words or more is less familiar than it takes; for the rows of identify with their text."""
    return (F.col("known") < least) & (F.size(F.split(text, r"\s+")) >= LEAST_WORDS)


def held_out(key: str = "doc_id") -> Column:
    """The third of the documents that no model learns from; a null key isn't among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
