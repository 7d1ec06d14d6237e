from __future__ import annotations

import random
from collections import Counter

import pytest

from quire.operators import fulltext, ingest
from quire.operators.textindex import TextIndex
from quire.sources.commits import Conflict, Folder

WORDS = "raison pure kant critique de la xylo xylophone homme être liberté sart sartre esprit loi".split()


def text(seed: int, n: int = 30) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[: r.randint(3, len(WORDS))]).title() for _ in range(r.randint(0, n)))


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


QUERIES = ("raison", "la xylo", "être de la rai", "x", "sart", "nowhere", "de de la", "!!")


def same(index, spark, rows, queries=QUERIES[1:3], limit=5):
    for q in queries:
        want = [tuple(r) for r in fulltext.bm25(pages(spark, rows), q, limit).collect()]
        assert [tuple(r) for r in index.search(q, limit).collect()] == want, q


def test_changes_give_the_rows_of_a_new_index(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", slot_bits=2)
    rows = {i: text(i) for i in range(60)} | {60: None, 61: ""}
    index.add(pages(spark, list(rows.items())))
    same(index, spark, list(rows.items()), QUERIES)

    for i in (3, 4, 5, 100, 101):  # two new ones and three that are replaced
        rows[i] = text(1_000 + i, 60)
    index.add(pages(spark, [(i, rows[i]) for i in (3, 4, 5, 100, 101)]))
    same(index, spark, list(rows.items()))

    gone = [0, 4, 17, 33, 61, 101, 999]
    for i in gone:
        rows.pop(i, None)
    index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    same(index, spark, list(rows.items()))
    state = index.folder.state()[1]
    index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))  # once more: nothing is lost twice
    assert index.folder.state()[1] == state

    index.merge()
    assert len(index.folder.state()[1]["segments"]) == 1 and not index.folder.state()[1]["dropped"]
    same(index, spark, list(rows.items()))
    rows[5] = "kant"
    index.add(pages(spark, [(5, "kant")]))
    same(index, spark, list(rows.items()))
    index.merge()
    index.merge()
    same(index, spark, list(rows.items()))
    assert len(index.folder.names("blocks")) == 2  # the newest state's and that before it

    index.remove(spark.createDataFrame([(i,) for i in rows], "doc_id bigint"))
    assert index.search("kant").collect() == []


def test_slots_that_cannot_hold_a_hit_are_not_read(spark, tmp_path, monkeypatch):
    """A word that is frequent in few pages: its slots are scored first, and what they give rules out the others."""
    monkeypatch.setattr("quire.operators.textindex.FIRST", 3)
    rows = [(i, "kant " * 20 if i < 12 else "kant and many other words that make a page long " * 3 if i % 5 == 0 else "nothing of it") for i in range(400)]
    index = TextIndex(spark, f"file://{tmp_path}/i", slot_bits=2)
    index.add(pages(spark, rows))
    plan = index.plan("kant", 5)
    assert plan.slots.count() >= 80 and plan.least > 0
    assert index.reached(plan).count() <= 4  # those of the first twelve pages
    want = [tuple(r) for r in fulltext.bm25(pages(spark, rows), "kant", 5).collect()]
    assert [tuple(r) for r in index.search("kant", 5).collect()] == want and len(want) == 5


def test_blocks_are_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    """However little a task holds, postings and hits are the same, and no posting moves to another task, in a merge neither."""
    rows = [(i, text(i, 40)) for i in range(30)] + [(30, None), (31, "")]
    for held in (1, 300):
        monkeypatch.setattr("quire.operators.segments.HELD", held)
        index = TextIndex(spark, f"file://{tmp_path}/{held}", slot_bits=2)
        index.add(pages(spark, rows))
        index.add(pages(spark, rows[:5]))
        index.merge()
        same(index, spark, rows)
        name = index.folder.state()[1]["segments"][0]["pages"]
        made = index._made("blocks", name)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.collect()
        assert all((r.n, r.most, r.shortest) == (len(r.ats), max(r.tfs), min(r.dls)) for r in got)
        places = index._of(name).collect()
        want = sorted((w, r.slot, r.at, n, r.dl) for r in places for w, n in Counter((r.words or "").split()).items())
        assert sorted((r.term, r.slot, *x) for r in got for x in zip(r.ats, r.tfs, r.dls, strict=True)) == want and len(places) == len(rows)


def test_a_merge_leaves_texts_with_the_tasks_that_read_them(spark, tmp_path, monkeypatch):
    """Words move to another task only where the dropped places can't be broadcast, and then once; no order of keys is made over all tasks."""
    index = TextIndex(spark, f"file://{tmp_path}/i", slot_bits=2)
    rows = {i: text(i, 40) for i in range(40)} | {40: None, 41: ""}
    index.add(pages(spark, list(rows.items())))
    numbered, plans = index._numbered, []
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most, sides in ((kept, 0), ("-1", 2)):  # by hash, both sides of the join once: the words and the dropped places
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            rows |= {i: text(2_000 + i + sides, 50) for i in (7, 8, 41, 50 + sides)}
            index.add(pages(spark, [(i, rows[i]) for i in (7, 8, 41, 50 + sides)]))
            rows.pop(20 + sides)
            index.remove(spark.createDataFrame([(20 + sides,)], "doc_id bigint"))
            monkeypatch.setattr(index, "_numbered", lambda r, name: (plans.append(r._jdf.queryExecution().executedPlan().toString()), numbered(r, name)))
            index.merge()
            monkeypatch.undo()
            assert plans[-1].count("hashpartitioning(") == sides and "rangepartitioning(" not in plans[-1] and "words" in plans[-1]
            assert plans[-1].count("+- Sort ") + plans[-1].count(":- Sort ") == sides  # nothing is sorted but for that join
            same(index, spark, list(rows.items()))
            state = index.folder.state()[1]
            assert len(state["segments"]) == 1 and index._live(state).select("place").distinct().count() == len(rows) == state["n"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_term_reads_its_own_row_groups(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(pages(spark, [(i, text(i)) for i in range(50)]))
    plan = index.plan("la xylo").blocks._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,xylo)" in plan and "EqualTo(term,la)" in plan
    # A block of one word never meets another slot: no window, no sort over all postings.
    assert "Window" not in plan


def test_index_follows_extraction_and_cascade(spark, tmp_path):
    """Pages that an extraction replaces and those of documents that go: as if the index were made anew."""
    schema = "document_id string, page_number int, content string"
    page = spark.createDataFrame([(d, n, text(hash((d, n)) % 97)) for d in "abcde" for n in range(1, 6)], schema)
    document = spark.createDataFrame([(d, False, None) for d in "abcde"], "document_id string, is_extracted boolean, edition_id string")
    index = TextIndex(spark, f"file://{tmp_path}/i", ("document_id", "page_number"), "content", slot_bits=2)
    index.add(page)

    fresh = spark.createDataFrame([("b", 1, "une raison pure"), ("b", 2, "xylophone de la raison"), ("d", 9, "la liberté")], schema)
    document, after = ingest.replace_pages(document, page, fresh)
    index.replace(fresh, ["document_id"], fresh)
    document = document.where("document_id != 'c'")
    left = ingest.cascade({"document": document, "document_page": after})["document_page"]
    index.remove(after.join(left, ["document_id", "page_number"], "left_anti"))

    anew = TextIndex(spark, f"file://{tmp_path}/j", ("document_id", "page_number"), "content")
    anew.add(left)
    for q in QUERIES[1:4]:
        want = [tuple(r) for r in fulltext.bm25(left, q, 10, ("document_id", "page_number"), "content").collect()]
        assert [tuple(r) for r in index.search(q, 10).collect()] == want == [tuple(r) for r in anew.search(q, 10).collect()]


def test_two_writers_of_a_state(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    assert folder.state() == (0, {})
    folder.commit(0, {"a": 1})
    with pytest.raises(Conflict):  # began before the other one's commit
        folder.commit(0, {"a": 2})
    assert folder.state() == (1, {"a": 1}) and folder.state(1) == (0, {})
    (tmp_path / "f" / "state-2").write_text('{"a": ')  # a writer that died on the way
    assert folder.state() == (1, {"a": 1})
    assert folder.commit(1, {"a": 3}) == 3 and folder.state() == (3, {"a": 3}) and folder.state(1) == (1, {"a": 1})


def test_index_without_pages(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(ValueError, match="no index"):
        index.search("kant")
    index.add(pages(spark, []))
    assert index.search("kant").collect() == []
    index.add(pages(spark, [(1, "kant"), (1, "hegel"), (2, None)]))  # one key twice: the last text in order
    assert [r.doc_id for r in index.search("kant").collect()] == [1] and index.search("hegel").collect() == []
