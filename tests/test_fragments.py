from __future__ import annotations

import json
import time
import uuid

import pytest

from quire.streaming import fragments

from .test_operators import BLOCKS, CHOICES

SCHEMA = "stream_id string, seq int, payload string"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, old)


def said(text: str) -> str:
    return json.dumps({"choices": [{"delta": {"content": text}}]})


def run(spark, tmp_path, batches, patience_ms=None, wait=0.0):
    """The rows of each trigger."""
    source, name, out = tmp_path / "in", f"f{uuid.uuid4().hex}", []
    source.mkdir()
    df = spark.readStream.schema(SCHEMA).json(str(source))
    q = fragments.fold_fragments(df, patience_ms=patience_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").start()
    try:
        for i, rows in enumerate(batches):
            (source / f"{i}.json").write_text("".join(json.dumps(dict(zip(("stream_id", "seq", "payload"), r, strict=True))) + "\n" for r in rows))
            if patience_ms is not None:
                break  # triggers go on without data, so there is no end to wait for
            q.processAllAvailable()
            got = [tuple(r) for r in spark.table(name).collect()]
            out.append(got[sum(map(len, out)) :])
        end = time.time() + wait
        while time.time() < end:
            time.sleep(0.5)
            got = [tuple(r) for r in spark.table(name).collect()]
            if len(got) > sum(map(len, out)):
                out.append(got[sum(map(len, out)) :])
                if len(got) == 2:
                    break
    finally:
        q.stop()
    return out


def test_only_new_text_is_handed_on(rocks, tmp_path):
    """Late fragments fill their gap, repeated ones count once, and what was handed on comes no more."""
    rows = lambda *pairs: [("s", n, said(t)) for n, t in pairs]
    out = run(rocks, tmp_path, [rows((0, "a"), (2, "c")), rows((1, "b"), (2, "c"), (4, "e")), rows((0, "a"), (4, "e")), rows((3, "d"))])
    assert out == [[("s", 0, "a", None, False)], [("s", 1, "bc", None, False)], [], [("s", 3, "de", None, False)]]


def test_calls_and_end(rocks, tmp_path):
    """Both dialects; calls come once, with the end, and fragments after it are repeats."""
    rows = lambda name, events, at: [(name, at + i, e) for i, e in enumerate(events)]
    out = run(rocks, tmp_path, [rows("a", CHOICES, 0) + rows("b", BLOCKS[:4], 0), rows("b", BLOCKS[4:], 4), rows("b", BLOCKS, 0)])
    assert sorted(r[:3] + r[4:] for r in out[0]) == [("a", 0, "Je cherche.", False), ("b", 0, "Je cherche.", False)]
    (name, begin, text, calls, done), = out[1]
    assert (name, begin, text, done) == ("b", 4, "", True) and out[2] == []
    assert json.loads(calls)["1"] == {"id": "t1", "name": "search_library", "arguments": '{"query":"kant"}'} and json.loads(calls)["2"]["name"] == "library_stats"


def test_patience(rocks, tmp_path):
    """When nothing comes any more, what waits behind a gap is handed on and the state goes."""
    rows = [("s", 0, said("a")), ("s", 2, said("c")), ("s", 5, said("f"))]
    out = run(rocks, tmp_path, [rows], patience_ms=1_500, wait=60)
    assert [r for part in out for r in part] == [("s", 0, "a", None, False), ("s", 1, "cf", "{}", True)]
