from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score", "source", "lang", "excerpt"]
    assert 0 < df.count() <= 20


def test_oracles_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "quire"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quire.llm" not in p.read_text() and "from .llm" not in p.read_text()


def test_core_queries_survive_a_failed_import(monkeypatch):
    """Without a library that the llm subpackage needs, the others are there."""
    import sys

    from quire.plans import QUERIES

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for missing in ("ahocorasick", "quire.llm.queries", "corpus_pipeline"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, missing, None)
            m.delitem(sys.modules, "quire.llm.secrets", raising=False)
            assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= QUERIES.keys()
