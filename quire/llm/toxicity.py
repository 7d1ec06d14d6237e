"""Toxicity by weak supervision: many voters, a generative model of them, a linear classifier on its posterior labels.

Voters look at a text and vote toxic, clean or nothing: lexicons of insults,
patterns (an insult after a form of address, set phrases, letters written as
digits, shouting, courtesy), and lexicons induced from labelled rows, namely the words
and stems that are far more frequent in toxic ones. A stem is the beginning of a
word; one that several words of a text share is told from one that a single word
has, since inflected insults come in many forms. The labels themselves are one
more voter, silent where a row has none.

The generative model has a hidden class and, for each voter, a distribution of
its three votes for either class: its accuracy. Voters that depend on one another
within a class are found from their expected joint counts (conditional mutual
information) and tied in a tree (the maximum spanning forest), in which a
voter's votes depend on the class and on its parent: the correlations. It is
fitted by expectation and maximisation over the table of vote patterns, counted
over all rows that may be learned from; each step is one Spark aggregation
whose result has a fixed size.

The classifier, a logistic regression of Spark's ML library on the words and
stems of a text and its votes without the label's, is fitted to the posterior labels of at
most FIT rows of either likely class, picked by a hash, each with the weight of
those that it stands for. Every text is scored by it, whole.

Bounds, all of them on what a model is fitted to and parameters: LABELLED rows
of each label for the induced lexicons and INDUCED marks in them; FIT rows and
VOCABULARY features for the classifier. Counts of votes, and scores, cover all
rows.

Defined cases: a null text is an empty one, which is scored too; a text without
a known word has the score of the intercept; labels that are null aren't
learned from, and an identifier with several labels has the more frequent one,
toxic on a tie; a null identifier has no label and isn't held out; rows with one
identifier share its label and each get the score of their own text; equal texts
get equal scores; where nothing is labelled the voters alone make the model;
where all posterior labels agree every score is their share; an empty table gives an
empty result; other columns aren't read, and the result has none of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, batch_of, stored

LABELLED, INDUCED, FIT, VOCABULARY = 20_000, 400, 20_000, 16_384
#: Induced words are in so many toxic rows at least, so many times as often as in clean ones, and so many deviations beyond chance.
LEAST_ROWS, LEAST_RATIO, LEAST_Z = 5, 15.0, 4.0
#: Induced words are dealt to so many voters.
PARTS = 3
STEPS = 6
#: Added to each count of the model, as so many rows that vote by chance.
PRIOR = 1.0
#: Share of toxic rows from which the first step starts.
BASE_RATE = 0.1
#: Conditional mutual information, in nats, from which two voters are tied.
TIED = 1e-4
#: Rows of a word from which it is a feature; penalty of a weight.
LEAST_FEATURE, PENALTY = 5, 3e-5
#: Characters of a text that are cut into words at once, and longest word that is looked at.
PIECE, LONGEST = 1 << 20, 40
#: Lengths of stems, and numbers of a text's words from which one counts as more frequent.
STEMS, FORMS = (3, 4), (1, 2, 3)
#: Distinct marks that a task counts before it passes them on.
FLUSH = 200_000

SILENT, TOXIC, CLEAN = range(3)

LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumber dumbass imbecile imbeciles dimwit halfwit fool fools cretin brainless clueless braindead simpleton dunce nitwit airhead",
    "worth": "worthless useless loser losers failure nobody hopeless pointless incompetent lousy inferior waste reject",
    "dirt": "trash scum garbage vermin filth filthy parasite parasites rat rats pig pigs maggot maggots cockroach cockroaches rubbish scumbag subhuman",
    "disgust": "disgusting disgust pathetic vile revolting repulsive sickening gross hideous ugly nauseating despicable contemptible repugnant",
    "ridicule": "clown clowns joke buffoon freak freaks weirdo creep coward cowards crybaby laughingstock fraud liar liars hypocrite",
    "profane": "fuck fucking fucked fucker shit shitty bullshit asshole assholes bitch bitches bastard bastards dick prick damn crap piss cunt whore slut twat wanker",
    "threat": "kill hang shoot stab burn strangle destroy murder choke exterminate",
    "hatred": "hate hated despise loathe detest abhor",
    "german": "dumm dummkopf idioten arschloch scheiße scheisse schwachkopf trottel depp abschaum versager widerlich wertlos erbärmlich ekelhaft dreckig schlampe hurensohn vollidiot",
    "french": "idiote imbécile connard connasse salaud salope merde ordure débile nul minable dégoûtant pathétique pourri crétin abruti raclure clochard",
    "spanish": "idiotas estúpido estúpida imbécil mierda basura asqueroso asquerosa patético inútil escoria payaso perdedor puta puto pendejo cabrón repugnante tonto",
}
SETS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
#: Lexicons whose words are insults by themselves.
INSULTS = frozenset().union(*(SETS[n] for n in SETS if n not in ("threat", "hatred")))
ADDRESS = frozenset("you your youre yourself u ur du dein deine ihr euer tu toi ton vous votre tú eres usted vosotros".split())
PHRASES = ("shut up", "go to hell", "get lost", "kill yourself", "nobody likes you", "screw you", "go away", "drop dead", "halt die klappe", "ta gueule", "cállate")
COURTESY = frozenset("please thank thanks welcome sorry regards kindly appreciate bitte danke merci pardon gracias".split())

_WORD, _BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
_DISGUISED = re.compile(r"(?<![a-z0-9@$])[a-z]++[013457@$][a-z013457@$]*+")
_PLAIN = str.maketrans("013457@$", "oieastas")
_SHOUTED = re.compile(r"(?<![A-Z])[A-Z]{4,}+")
_NEAR = 4

#: Names of the voters, in order; the last is the label.
VOTERS = (*LEXICONS, "addressed", "phrase", "disguised", "shouted", "courtesy", *[f"induced{i}" for i in range(PARTS)], "label")


def pieces(text: str) -> Iterator[str]:
    """text in pieces that end beside a character that is no letter, so that a long text isn't cut up at once."""
    at = 0
    while len(text) - at > PIECE and (m := _BREAK.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def words(text: str) -> set[str]:
    """The distinct words of a text: runs of letters in lower case."""
    found: set[str] = set()
    for piece in pieces(text):
        found.update(w for w in set(_WORD.findall(piece.lower())) if len(w) <= LONGEST)
    return found


class Induced(NamedTuple):
    """Lexicons of marks, and the stems that they name."""

    parts: list[frozenset[str]]
    stems: frozenset[str]


NOTHING_INDUCED = Induced([frozenset()] * PARTS, frozenset())


def stems_of(found: Iterable[str]) -> frozenset[str]:
    return frozenset(m.split("*")[0] for m in found if "*" in m)


def stem_marks(found: set[str], stems: frozenset[str] | None = None) -> set[str]:
    """The stems of the words (of `stems` only, if given), each with the numbers of FORMS that its words reach: `walk*2`."""
    if stems is None:
        cut = [w[:n] for w in found for n in STEMS if len(w) > n]
    else:
        cut = [s for w in found for n in STEMS if len(w) > n and (s := w[:n]) in stems]
    return {f"{s}*{k}" for s, n in Counter(cut).items() for k in FORMS if n >= k}


def marks(found: set[str], stems: frozenset[str] | None = None) -> set[str]:
    """The words and their stems."""
    return found | stem_marks(found, stems)


def _near_address(text: str) -> bool:
    """True if an insult stands within _NEAR words of a form of address."""
    far = -_NEAR - 1
    addressed, insulted, i = far, far, 0
    for piece in pieces(text):
        for m in _WORD.finditer(piece.lower()):
            if m[0] in ADDRESS:
                addressed = i
            elif m[0] in INSULTS:
                insulted = i
            if min(addressed, insulted) >= 0 and abs(addressed - insulted) <= _NEAR:
                return True
            i += 1
    return False


def votes(text: str, found: set[str], induced: Induced, stems: set[str] | None = None) -> list[int]:
    """The votes of all voters but the label; stems: the text's stem_marks, of the induced lexicons' stems at least."""
    out = [TOXIC if not found.isdisjoint(own) else SILENT for own in SETS.values()]
    insulted = not found.isdisjoint(INSULTS)
    out.append(TOXIC if insulted and not found.isdisjoint(ADDRESS) and _near_address(text) else SILENT)
    low = None
    said = False
    for p in PHRASES:
        if all(w in found for w in p.split()):
            low = low if low is not None else " ".join(text.lower().split())
            said = said or p in low
    out.append(TOXIC if said else SILENT)
    hidden = any(c in text for c in "013457@$") and any(w.translate(_PLAIN) in INSULTS for piece in pieces(text) for w in set(_DISGUISED.findall(piece.lower())) if len(w) <= LONGEST)
    out.append(TOXIC if hidden else SILENT)
    out.append(TOXIC if "!!!" in text or next(islice(_SHOUTED.finditer(text), 4, None), None) else SILENT)
    out.append(CLEAN if not found.isdisjoint(COURTESY) else SILENT)
    stems = stem_marks(found, induced.stems) if stems is None else stems
    return out + [SILENT if found.isdisjoint(own) and stems.isdisjoint(own) else TOXIC for own in induced.parts]


# Labels and induced lexicons.


def labelled(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(_id, toxic) with one row for each labelled identifier."""
    share = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.avg((F.col(label) > 0).cast("double")).alias("share"))
    return share.select("_id", (F.col("share") >= 0.5).alias("toxic"))


def _picked(key: Column, share: Column) -> Column:
    """True for a share of the rows, by a hash."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30)


def _mark_counts(docs: DataFrame) -> DataFrame:
    """(mark, bad, good): toxic and other rows that have a mark; docs: (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = batch_of({"mark": pa.array([w for w, _ in keys], pa.string()), "toxic": pa.array([t for _, t in keys], pa.bool_()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                counts.update((w, toxic) for w in marks(words(text or "")))
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()

    return arrow_map(docs, run, "mark string, toxic boolean, n long").groupBy("mark").agg(F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("good"))


def induce(docs: DataFrame, labels: DataFrame) -> Induced:
    """PARTS lexicons of what marks toxic rows; docs: (_id, text), labels as labelled() gives them.

    At most LABELLED rows of each label are read, in the mean: a hash of the
    identifier picks them. Identifiers, not texts, are what is sent along.
    """
    of = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of) < 2:
        return NOTHING_INDUCED
    share = F.when(F.col("toxic"), min(1.0, LABELLED / of[True])).otherwise(min(1.0, LABELLED / of[False]))
    some = stored(labels.where(_picked(F.col("_id"), share)))
    rows = stored(docs.join(F.broadcast(some), "_id").select("text", "toxic"))  # 2 * LABELLED identifiers at most
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return NOTHING_INDUCED
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    ratio = (bad / n[True]) / (good / n[False])
    z = F.log(ratio) / F.sqrt(1 / bad + 1 / good)
    best = _mark_counts(rows).select("mark", "bad", ratio.alias("ratio"), z.alias("z")).where((F.col("bad") >= LEAST_ROWS) & (F.col("ratio") >= LEAST_RATIO) & (F.col("z") >= LEAST_Z))
    found = [r["mark"] for r in best.orderBy(F.desc(F.round("z", 6)), "mark").limit(INDUCED).collect()]
    return Induced([frozenset(found[i::PARTS]) for i in range(PARTS)], stems_of(found))


# The generative model.


class LabelModel(NamedTuple):
    """prior: log share of each class; tables[j][y, a, b]: log chance of voter j's vote b in class y where its parent votes a (all a alike without one)."""

    prior: np.ndarray
    tables: np.ndarray
    parent: tuple[int, ...]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The chance that rows of votes belong to the toxic class."""
        score = np.repeat(self.prior[None], len(v), axis=0)
        for j, p in enumerate(self.parent):
            score += self.tables[j][:, v[:, p] if p >= 0 else 0, v[:, j]].T
        top = np.exp(score - score.max(axis=1, keepdims=True))
        return top[:, 1] / top.sum(axis=1)


#: Chances of the votes silent, toxic and clean of a clean and of a toxic row, before anything was counted.
GUESS = {"courtesy": ((0.85, 0.001, 0.149), (0.95, 0.001, 0.049)), "label": ((0.60, 0.04, 0.36), (0.60, 0.36, 0.04))}
OTHER_GUESS = ((0.97, 0.02, 0.01), (0.70, 0.29, 0.01))


def first_guess() -> LabelModel:
    """Independent voters that are right more often than not."""
    tables = np.log(np.array([GUESS.get(name, OTHER_GUESS) for name in VOTERS]))[:, :, None, :].repeat(3, axis=2)
    return LabelModel(np.log(np.array([1 - BASE_RATE, BASE_RATE])), tables, (-1,) * len(VOTERS))


def row_key(key: str, text: str) -> Column:
    """Tells rows apart by what they hold, whenever they are read."""
    return F.xxhash64(F.col(key), F.col(text))


def cast_votes(docs: DataFrame, labels: DataFrame, induced: Induced) -> DataFrame:
    """(row, votes) of docs (_id, text): a digit for each voter, the label's last. Texts aren't shuffled to meet their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t or "" for t in b.column("text").to_pylist())
            yield batch_of({"_id": b.column("_id"), "row": b.column("row"), "votes": pa.array(["".join(map(str, votes(t, words(t), induced))) for t in texts], pa.string())})

    kind = docs.schema["_id"].dataType.simpleString()
    cast = stored(arrow_map(docs.select("_id", row_key("_id", "text").alias("row"), "text"), run, f"_id {kind}, row long, votes string"))
    label = F.when(F.col("toxic").isNull(), str(SILENT)).when(F.col("toxic"), str(TOXIC)).otherwise(str(CLEAN))
    return stored(cast.join(labels, "_id", "left").select("row", F.concat("votes", label).alias("votes")))


def patterns_of(cast: DataFrame) -> DataFrame:
    """(votes, n): how many rows vote so."""
    return stored(cast.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))


def _matrix(patterns: list[str]) -> np.ndarray:
    return np.frombuffer("".join(patterns).encode(), np.uint8).reshape(len(patterns), len(VOTERS)) - ord("0")


def expected(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    """[y, i, a, j, b]: expected rows of class y in which voter i votes a and voter j votes b. Its size doesn't depend on the data."""
    m = len(VOTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * m, 3 * m))
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("votes").to_pylist())
                one = np.zeros((len(v), m, 3))
                np.put_along_axis(one, v[:, :, None].astype(int), 1, axis=2)
                one = one.reshape(len(v), 3 * m)
                p, n = model.posterior(v), b.column("n").to_numpy()
                for y, w in enumerate((n * (1 - p), n * p)):
                    total[y] += (one * w[:, None]).T @ one
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield batch_of({"at": pa.array(at.astype(np.int32)), "n": pa.array(flat[at])})

    out = np.zeros(2 * 9 * m * m)
    for r in arrow_map(patterns, run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = round(r["n"], 6)
    return out.reshape(2, m, 3, m, 3)


def maximised(counts: np.ndarray, parent: tuple[int, ...]) -> LabelModel:
    m = len(parent)
    shares = np.array([counts[y, 0, :, 0, :].sum() for y in (0, 1)]) + PRIOR
    tables = np.zeros((m, 2, 3, 3))
    for j, p in enumerate(parent):
        own = np.stack([np.diag(counts[y, j, :, j, :]) for y in (0, 1)])[:, None, :]  # of either class, whatever a parent votes
        base = (own + PRIOR / 3) / (own.sum(axis=2, keepdims=True) + PRIOR)
        if p < 0:
            tables[j] = np.log(np.repeat(base, 3, axis=1))
        else:  # where a parent's vote is rare, the voter's own shares stand in
            joint = np.stack([counts[y, p, :, j, :] for y in (0, 1)])
            tables[j] = np.log((joint + PRIOR * base) / (joint.sum(axis=2, keepdims=True) + PRIOR))
    return LabelModel(np.log(shares / shares.sum()), tables, parent)


def forest(counts: np.ndarray) -> tuple[int, ...]:
    """Parents of the voters in the maximum spanning forest of what two of them tell about each other within a class."""
    m = counts.shape[1]
    total = max(counts[:, 0, :, 0, :].sum(), 1e-9)
    edges = []
    for i in range(m):
        for j in range(i + 1, m):
            told = 0.0
            for y in (0, 1):
                joint = counts[y, i, :, j, :]
                n = joint.sum()
                if n > 0:
                    by_chance = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True) / n
                    there = joint > 0
                    told += (joint[there] * np.log(joint[there] / by_chance[there])).sum() / total
            if told >= TIED:
                edges.append((-told, i, j))
    near: dict[int, list[int]] = {i: [] for i in range(m)}
    group = list(range(m))
    for _, i, j in sorted(edges):
        if group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
            near[i].append(j)
            near[j].append(i)
    parent, seen = [-1] * m, set()
    for root in range(m):
        todo = [root] if root not in seen else []
        while todo:
            i = todo.pop()
            seen.add(i)
            for j in near[i]:
                if j not in seen:
                    parent[j] = i
                    todo.append(j)
    return tuple(parent)


def fit_label_model(patterns: DataFrame, steps: int = STEPS) -> LabelModel:
    """Accuracies with independent voters first, then once more with those tied that depend on each other."""
    model = first_guess()
    for _ in range(steps):
        model = maximised(expected(patterns, model), (-1,) * len(VOTERS))
    counts = expected(patterns, model)
    model = maximised(counts, forest(counts))
    for _ in range(steps):
        model = maximised(expected(patterns, model), model.parent)
    return model


# The classifier.


def _voted(cast: list[int]) -> list[str]:
    """The voters that voted, in names that no mark has."""
    return [f"{name}={v}" for name, v in zip(VOTERS, cast, strict=False) if v]


def features(text: str, found: set[str], induced: Induced) -> list[str]:
    """The marks and the voters that voted."""
    stems = stem_marks(found)
    return [*found, *stems, *_voted(votes(text, found, induced, stems))]


class Classifier(NamedTuple):
    bias: float
    weights: dict[str, float]
    induced: Induced
    #: The words that have a weight, and the stems that a weight or an induced lexicon names.
    known: frozenset[str]
    stems: frozenset[str]

    def score(self, text: str) -> float:
        found = words(text)
        stems = stem_marks(found, self.stems)
        own = [*(found & self.known), *stems, *_voted(votes(text, found, self.induced, stems))]
        total = self.bias + math.fsum(self.weights.get(f, 0.0) for f in own)
        return round(1 / (1 + math.exp(-max(-500.0, min(500.0, total)))), 6)


def classifier(bias: float, weights: dict[str, float], induced: Induced) -> Classifier:
    return Classifier(bias, weights, induced, frozenset(weights), stems_of(weights) | induced.stems)


def constant(share: float | None, induced: Induced) -> Classifier:
    share = min(max(share or 0.0, 1e-6), 1 - 1e-6)
    return classifier(math.log(share / (1 - share)), {}, induced)


def posteriors(cast: DataFrame, model: LabelModel) -> DataFrame:
    """(row, p): the chance that a row is toxic, by its votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch_of({"row": b.column("row"), "p": pa.array(model.posterior(_matrix(b.column("votes").to_pylist())).round(6))})

    return arrow_map(cast, run, "row long, p double")


def fit_rows(docs: DataFrame, likely: DataFrame, induced: Induced) -> DataFrame:
    """(features, p, weight) of FIT rows in the mean of either likely class; docs: (_id, text), likely: (row, p)."""
    n = {r["toxic"]: r["n"] for r in likely.groupBy((F.col("p") >= 0.5).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("p") >= 0.5, min(1.0, FIT / n.get(True, 1))).otherwise(min(1.0, FIT / n.get(False, 1)))
    some = likely.withColumn("share", share).where(_picked(F.col("row"), F.col("share")))
    some = stored(some.select(F.col("row"), "p", (1 / F.col("share")).alias("weight")).dropDuplicates(["row"]))
    rows = docs.withColumn("row", row_key("_id", "text")).join(F.broadcast(some), "row")  # 2 * FIT rows of three numbers, in the mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield batch_of({"features": pa.array([features(t, words(t), induced) for t in texts], pa.list_(pa.string())), "p": b.column("p"), "weight": b.column("weight")})

    return stored(arrow_map(rows.select("text", "p", "weight"), run, "features array<string>, p double, weight double"))


def fit_classifier(rows: DataFrame, induced: Induced) -> Classifier:
    """A logistic regression with an absolute penalty, so that few words keep a weight. rows: as fit_rows() gives them."""
    n, bad, mean = rows.agg(F.count(F.lit(1)), F.sum("p"), F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).first()
    if not n or min(bad, n - bad) < 0.5:
        return constant(mean, induced)
    each = rows.select(F.explode("features").alias("feature"), "p").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("bad"))
    b, g = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    z = F.abs(F.log(b / bad / (g / (n - bad))) / F.sqrt(1 / b + 1 / g))
    vocabulary = sorted(r["feature"] for r in each.where(F.col("n") >= LEAST_FEATURE).orderBy(F.desc(F.round(z, 6)), "feature").limit(VOCABULARY).collect())
    if not vocabulary:
        return constant(mean, induced)
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="features", outputCol="x").setBinary(True).setMinTF(1.0)
    x = counted.transform(rows).select("x", "p", "weight")
    soft = stored(x.select("x", F.lit(1.0).alias("y"), (F.col("p") * F.col("weight")).alias("w")).union(x.select("x", F.lit(0.0), (1 - F.col("p")) * F.col("weight"))).where("w > 1e-6"))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=60, regParam=PENALTY, elasticNetParam=1.0, standardization=False).fit(soft)
    weights = {f: round(float(w), 6) for f, w in zip(vocabulary, fitted.coefficients.toArray(), strict=True) if round(float(w), 6)}
    return classifier(round(float(fitted.intercept), 6), weights, induced)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """The classifier of the rows that may be learned from; labels: as labelled() gives them, of such rows only."""
    docs = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"))
    labels = stored(labels)
    induced = induce(docs, labels)
    cast = cast_votes(docs, labels, induced)
    model = fit_label_model(patterns_of(cast))
    return fit_classifier(fit_rows(docs, stored(posteriors(cast, model)), induced), induced)


def score(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of keep, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([model.score(t or "") for t in b.column("_text").to_pylist()], float)
            yield batch_of({c: b.column(c) for c in keep} | {"score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    own = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(own, run, f"{kinds}, score double, predicted int")


def held_out(key: str = "doc_id") -> Column:
    """The fifth of the documents that no model learns from; a null key isn't among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
