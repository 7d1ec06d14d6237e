from __future__ import annotations

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import quoteindex as Q, verify

WORDS = "la raison pure être x1 critique Ä é de kant esprit loi und auch 日本".split()
SCHEMA = "document_id string, page_number int, content string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "-" + str(r.randint(0, 99))]) for _ in range(n))


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=Q.GUARANTEED, max_size=60), st.text("ab ", max_size=40), st.text("ab ", max_size=40))
def test_a_long_quote_shares_all_its_fingerprints(quote, before, after):
    assert len(Q.prints(quote)) > 0
    assert set(Q.prints(quote)) <= set(Q.prints(before + quote + after))


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=Q.GUARANTEED - 1), st.text(max_size=30), st.text(max_size=30))
def test_a_short_quote_shares_its_runs(quote, before, after):
    assert 0 < len(Q.quote_runs(quote)) and set(Q.quote_runs(quote)) <= set(Q.runs(before + quote + after))


def test_fingerprints_are_few():
    text = prose(1, 3_000)
    assert len(Q.prints(text)) < 2.5 * len(text) / (Q.WINDOW + 1)
    assert len(Q.prints("")) == len(Q.prints("short")) == len(Q.runs("")) == 0


def _all(spark, rows, quotes):
    fold = {(d, n): spark.range(1).select(T.normalized(F.lit(c)).alias("f")).first().f for d, n, c in rows}
    needles = {q: spark.range(1).select(T.normalized(F.lit(t)).alias("f")).first().f for q, t in quotes}
    return {(q, d, n) for q, needle in needles.items() for (d, n), f in fold.items() if needle and f is not None and needle in f}


def test_quotes_after_changes(spark, tmp_path):
    rows = [(d, n, prose(17 * i + n, 80)) for i, d in enumerate("abcdef") for n in range(1, 5)] + [("g", 1, None), ("g", 2, ""), ("g", 3, "x")]
    index = Q.QuoteIndex(spark, f"file://{tmp_path}/q", slot_bits=2)
    index.add(spark.createDataFrame(rows, SCHEMA))
    quotes = [("long", rows[3][2][40:140]), ("again", rows[3][2][40:140]), ("cut", rows[5][2][11:31]), ("word", "Kant"), ("two", "la"), ("one", "x"), ("none", "no such words stand in it"), ("blank", " ,"), ("null", None), ("cjk", "日本"), ("start", rows[8][2][:25]), ("mark", "être")]
    asked = spark.createDataFrame(quotes, "quote_id string, quote string")
    quotes = [(q, t) for q, t in quotes if t is not None]
    found = index.locate(asked)
    assert {tuple(r) for r in found.collect()} == _all(spark, rows, quotes) and found.count() == found.distinct().count()
    # Texts aren't cut in a search: what is exploded are the quotes' keys and the places of blocks.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("folded" not in line for line in plan.splitlines() if "Generate" in line) and "Cartesian" not in plan

    fresh = [("b", 1, prose(900, 60) + " Kant " + rows[3][2][40:140])]
    index.replace(spark.createDataFrame(fresh, SCHEMA), ["document_id"], spark.createDataFrame(fresh, SCHEMA))
    index.remove(spark.createDataFrame([("a", 4)], "document_id string, page_number int"))
    rows = [r for r in rows if r[0] != "b" and r[:2] != ("a", 4)] + fresh
    assert {tuple(r) for r in index.locate(asked).collect()} == _all(spark, rows, quotes)
    index.merge()
    assert {tuple(r) for r in index.locate(asked).collect()} == _all(spark, rows, quotes)


def test_blocks_are_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    """However little a task holds, a key's places are the same, and no key moves to another task."""
    rows = [(d, n, prose(7 * i + n, 20)) for i, d in enumerate("abc") for n in range(1, 6)]
    found = []
    for held in (1, 300, 4 << 20):
        monkeypatch.setattr("quire.operators.segments.HELD", held)
        index = Q.QuoteIndex(spark, f"file://{tmp_path}/{held}", slot_bits=2)
        index.add(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        pages = index.folder.state()[1]["segments"][0]["pages"]
        own = {}
        for kind, hashes in (("prints", Q.prints), ("runs", Q.runs)):
            made = index._made(kind, pages)
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
            got = made.collect()
            assert all(r.n == len(r.ats) and r.ats == sorted(r.ats) for r in got)
            own[kind] = sorted((r.key, r.slot, at) for r in got for at in r.ats)
            assert own[kind] == sorted((int(k), r.slot, r.at) for r in index._of(pages).collect() for k in hashes(r.folded))
        found.append([len(x) for x in own.values()])
    assert found[0] == found[1] == found[2]


def test_citations_and_annotations_by_index(spark, tmp_path):
    """The same verdicts as over the texts."""
    rows = [(d, n, prose(31 * i + n, 60)) for i, d in enumerate("abc") for n in range(1, 4)]
    pages = spark.createDataFrame(rows, SCHEMA)
    titles = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "document_id string, title string")
    quotes = [rows[i][2][5:60] for i in range(9)] + ["not in any of these pages", "short", None, rows[0][2][:10]]
    cited = spark.createDataFrame([(f"{d}{i}", d, p, q) for i, q in enumerate(quotes) for d, p in (("a", 1), ("b", 2), ("c", 9), ("d", 1), ("z", 1))], "citation_id string, document_id string, page int, quote string")
    index = Q.QuoteIndex(spark, f"file://{tmp_path}/q")
    index.add(pages)
    key = lambda df: sorted(map(repr, df.collect()))
    got = key(verify.verify_citations(cited, titles, pages, index))
    assert got == key(verify.verify_citations(cited, titles, pages)) and len({r.split("verdict='")[1].split("'")[0] for r in got}) >= 5

    folds = Q.QuoteIndex(spark, f"file://{tmp_path}/f", fold=T.fold)
    folds.add(pages)
    notes = spark.createDataFrame([(f"{d}{p}{i}", d, p, q, (q or "")[:0], "") for i, q in enumerate(quotes) for d, p in (("a", 1), ("b", None), ("c", 3))], "annotation_id string, document_id string, page int, quote string, prefix string, suffix string")
    got = key(verify.resolve_annotations(notes, pages, folds))
    assert got == key(verify.resolve_annotations(notes, pages)) and {"lost", "found", "moved"} <= {r.split("kind='")[1].split("'")[0] for r in got}
