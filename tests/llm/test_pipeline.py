"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm import langid, langtables, mixing

from .test_operators import _ids, brute_components, brute_contamination


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.select(*P.COLUMNS).collect()))


def test_language(spark, small, docs):
    r = random.Random(2)
    noise = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxzaeiou") for _ in range(7)) for _ in range(30))
    french = docs.where("lang = 'fr'").orderBy("doc_id").first().text
    bad = [(10_001, "12 !!", "en", "s", 5), (10_002, None, "en", "s", 0), (10_003, "это просто текст на другом языке", "en", "s", 0), (10_004, noise, None, "s", 0)]
    good = [(10_005, "zxq", "en", "s", 3), (10_006, french, None, "s", 0), (10_007, docs.first().text + " " + noise[:60], "en", "s", 0)]
    out = rows(P.language_stage(spark, docs.unionByName(spark.createDataFrame(bad + good, docs.schema)), small))
    want = [x for x in rows(docs) if re.search(r"[^\W\d_]", x[1])] + [(*x[:2], "fr" if x[0] == 10_006 else x[2], *x[3:]) for x in good]
    assert out == sorted(want)


def test_language_without_labels(spark, small, docs):
    own = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "others", None, "s", 6)], docs.schema)
    assert [r[0] for r in P.language_stage(spark, own, small).collect()] == [1, 2]


def test_language_from_all_labels(spark, small, docs):
    """Each of more labelled documents than a sample holds has words of its own, which alone tell the language of another."""
    r = random.Random(4)
    texts = [["".join(r.choice("bcdfghjklmnpqrstvwxzaeiou") for _ in range(7)) for _ in range(5)] for _ in range(32_000)]
    lang = lambda i: ("aa", "bb")[i % 2]
    labelled = [(i, " ".join(t), lang(i), "s", 0) for i, t in enumerate(texts)]
    bare = [(100_000 + i, " ".join(t[::-1]), None, "s", 0) for i, t in enumerate(texts) if i % 101 == 0]
    own = spark.createDataFrame(labelled + bare, docs.schema).repartition(4)
    got = {x.doc_id: x.lang for x in P.language_stage(spark, own, small).where("doc_id >= 100000").collect()}
    assert got == {x[0]: lang(x[0]) for x in bare}


@pytest.mark.parametrize("common", [1 << 16, 60, 0])
def test_language_tables(spark, docs, monkeypatch, common):
    """The tables judge as langid does with a model from all labels, whatever words are sent and however much a task holds."""
    monkeypatch.setattr(langtables, "COMMON", common)
    r = random.Random(6)
    noise = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxzaeiouéß") for _ in range(7)) for _ in range(n)) for n in (30, 4, 12)]
    odd = [*noise, "это просто текст на другом языке", "zxq", None, "", "12 !!", "İstanbul ÉÀ ſ", "ab" * 2_000 + " q" * 9, noise[0]]
    more = spark.createDataFrame([(10_000 + i, t, None if i < 10 else "en", "s", 0) for i, t in enumerate(odd)], docs.schema)
    own = docs.where("n_chars < 4000").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).unionByName(more).repartition(3)
    table = P.numbered(own)
    got = {x._row: x for x in langtables.judge(table, "_row").collect()}
    rows = table.withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(3))).collect()
    counts = [Counter((x.lang, w) for x in rows if x.lang and x.fold != f for t in langid.tokens((x.text or "").encode()) for w in langid.words_of(t)) for f in range(4)]
    scorers = [langid.Scorer(langid.build([(*k, n) for k, n in c.items()])) for c in counts]
    assert len(got) == len(rows)
    for x in rows:
        text, g = x.text and x.text.encode(), got[x._row]
        assert g.known == pytest.approx(scorers[x.fold]([text])[0][2], abs=3e-6)
        assert g.enough == (len(re.split(r"\s+", x.text or "")) >= 5) and g.labelled == (x.lang is not None)
        want = scorers[3]([text])[0][0]
        assert g.lang_pred == (None if x.lang or want == "und" else want) and (g.words == 0) == (want == "und")
    middle = np.median([g.known for g in got.values() if g.labelled and g.enough and g.words])
    assert langtables.usual(table.sparkSession.createDataFrame(got.values())) == pytest.approx(0.5 * middle)


@pytest.mark.parametrize("size", [1, 3, 5])
@pytest.mark.parametrize("held", [1, 7, 1_000])
def test_long_words_are_cut_in_pieces(monkeypatch, size, held):
    monkeypatch.setattr(langtables, "HELD", held)
    for word in ("", "a", "abcabcabcaéß" * 9):
        pieces = list(langtables._cut(word, size))
        s = f"^{word}$"
        assert sum(pieces, Counter()) == Counter(s[i : i + size] for i in range(len(s) - size + 1))
        assert all(p.total() <= held for p in pieces)


def test_a_text_without_a_space(spark, docs):
    """A word of more letters than are cut at once, learned and judged, in pieces whose sum is that of the whole."""
    long = "abcdefghij" * 25_000
    more = spark.createDataFrame([(30_000, long, "en", "s", 0), (30_001, long + "k", None, "s", 0), *((30_002 + i, long + "lmnopq"[i], "en", "s", 0) for i in range(6))], docs.schema)
    got = {r.doc_id: r for r in langtables.judge(docs.where("doc_id < 20").select("doc_id", "text", "lang").unionByName(more.select("doc_id", "text", "lang")), "doc_id").where("doc_id >= 30000").collect()}
    assert got[30_000].words == got[30_001].words == 1 and not got[30_000].enough
    assert got[30_001].lang_pred == "en" and got[30_001].known > 0.99


def test_language_labels_vouch_for_no_copy(spark, small, docs):
    """Random letters stay unfamiliar with a label, and with copies that have one."""
    r = random.Random(7)
    noise = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxzaeiou") for _ in range(7)) for _ in range(30))
    more = spark.createDataFrame([(20_000 + i, noise, ("en", None)[i % 2], "s", 0) for i in range(12)], docs.schema)
    assert P.language_stage(spark, docs.unionByName(more), small).where("doc_id >= 20000").isEmpty()


def test_languages_reach_the_shards(spark, small, docs):
    """The language that the first stage finds for a row without one is that of its entries."""
    bare = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    out = P.shard_stage(spark, P.language_stage(spark, bare, small), small).select("doc_id", "lang").collect()
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = [r.lang == want[r.doc_id] for r in out if r.doc_id % 3 == 0]
    assert all(r.lang for r in out) and all(r.lang == want[r.doc_id] for r in out if r.doc_id % 3) and sum(found) >= 0.95 * len(found) > 50


def test_near_dedup(spark, small, docs):
    out = P.near_dedup_stage(spark, docs, small)
    all_rows = rows(docs)
    kept = {k for k, _, c in brute_components([r[:2] for r in all_rows], 5, 80) if k == c}
    assert rows(out) == [r for r in all_rows if r[0] in kept]


def test_decontaminate(spark, small, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination([r[:2] for r in rows(docs)], items) if r[-1]}
    assert bad and rows(P.decontaminate_stage(spark, docs, small)) == [r for r in rows(docs) if r[0] not in bad]


def test_decontaminate_long(spark, small, docs):
    passage = " ".join(spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text.split()[:20])
    filler = " ".join(f"filler{i}" for i in range(5_000))
    own = spark.createDataFrame([(1, f"{filler} {passage} {filler}", "en", "s", 0), (2, filler, "en", "s", 0)], docs.schema)
    assert [r[0] for r in rows(P.decontaminate_stage(spark, own, small))] == [2]


def test_rows_with_equal_ids(spark, small, docs):
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    one, two, three = (" ".join(f"{w}{i}" for i in range(100)) for w in ("one", "two", "three"))
    table = [(None, one), (None, one + " end"), (None, two), (None, item), (5, three), (5, three), (5, item), (5, "clean"), (4, one), (None, None)]
    own = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in table], docs.schema).repartition(3)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert left(P.near_dedup_stage(spark, own, small)) == sorted([(4, one), (None, two), (5, item), (5, three), (5, "clean"), (None, None)], key=repr)
    assert left(P.decontaminate_stage(spark, own, small)) == sorted([x for x in table if x[1] != item], key=repr)


def test_mix(spark, small, docs):
    want = mixing.poisson_mix(docs, mixing.root_weights(docs)).select("doc_id").collect()
    assert Counter(r[0] for r in rows(P.mix_stage(spark, docs, small))) == Counter(r.doc_id for r in want)


def test_run(spark, small, docs):
    """The rows of the mix, each with its tokens, one after another, and not sorted by document."""
    out = P.run(spark, small).orderBy("start").collect()
    step = docs
    for _, stage in P.STAGES[:-1]:
        step = stage(spark, step, small)
    crc = {r[0]: zlib.crc32(np.array([*_ids(r[1]), 0], "<u4").tobytes()) for r in rows(step)}
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows(step))
    assert all(r.ids_crc32 == crc[r.doc_id] for r in out)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    assert sorted(r.place for r in out) == [r.place for r in out]
    copied = [k for k, n in Counter(r.doc_id for r in out).items() if n > 1]
    side_by_side = sum(a.doc_id == b.doc_id for a, b in zip(out, out[1:], strict=False))
    assert copied and side_by_side <= 0.2 * len(copied) and [r.doc_id for r in out] != sorted(r.doc_id for r in out)


def test_shards_keep_the_order_of_the_mix(spark, small, docs, tmp_path):
    """The order of the files and of the rows in them, copies included; a table that isn't one of files keeps its own."""
    own = docs.where("n_chars < 500").select(*P.COLUMNS)
    mixed = own.union(own).union(own).repartition(5)
    mixed.write.parquet(f"{tmp_path}/mix")
    names = sorted((tmp_path / "mix").glob("part-*"))
    want = [r for n in names for r in spark.read.parquet(str(n)).select("doc_id").toPandas()["doc_id"]]
    got = P.shard_stage(spark, spark.read.parquet(f"{tmp_path}/mix"), small).orderBy("start").collect()
    assert [r.doc_id for r in got] == want
    listed = spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in (5, 3, 3, None, 4)], docs.schema).coalesce(1)
    assert [r.doc_id for r in P.shard_stage(spark, listed, small).orderBy("start").collect()] == [5, 3, 3, None, 4]


def test_stages_keep_hard_rows(spark, small, docs):
    hard = docs.unionByName(spark.createDataFrame([(None, "no key", None, None, 6), (1, None, None, None, 0), (20_001, "", None, None, 0)], docs.schema))
    for _, stage in P.STAGES:
        hard = stage(spark, hard, small)
    assert hard.count() > 0


def test_stages_with_clashing_names(spark, small, docs):
    """Columns named as results are change nothing."""
    more = docs
    for name in ("lang_pred", "score", "known", "kept", "component_id", "n_hit", "_row", "key", "rate", "copy", "shuffle_key", "start", "ids", "n_tokens", "shard"):
        more = more.withColumn(name, F.lit("x"))
    for _, stage in P.STAGES:
        a, b = (sorted(stage(spark, d, small).drop("shard").collect(), key=repr) for d in (docs.where("doc_id < 60"), more.where("doc_id < 60")))
        assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_empty(spark, small, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
    assert langid.train(docs.limit(0)).languages == []
