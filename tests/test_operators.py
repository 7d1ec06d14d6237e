from __future__ import annotations

import io
import json
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.sql.datasource import GreaterThan, In, LessThanOrEqual

from quire.functions import citation
from quire.operators import catalog, fulltext, hybrid, ingest, knn, verify
from quire.sources import archive, files, numpy_files, schemas
from quire.sources.commits import Folder
from quire.streaming import folds

FRENCH = [(1, "Le concept de liberté chez Sartre."), (2, "La vérité des xylophones."), (3, "Rien ici.")]


def test_knn_golden(spark):
    df = spark.createDataFrame([("A", 1, [1.0, 0.0, 0.0, 0.0]), ("A", 2, [0.0, 1.0, 0.0, 0.0]), ("B", 7, [0.9, 0.1, 0.0, 0.0])], "d string, page int, embedding array<float>").withColumn("key", F.struct("d", "page"))
    assert [tuple(r.key) for r in knn.knn(df, [1.0, 0, 0, 0], 2, key="key").collect()] == [("A", 1), ("B", 7)]
    assert knn.knn(df, [1.0, 0, 0, 0], 0, key="key").count() == 0
    with pytest.raises(ValueError, match="k must"):
        knn.knn(df, [1.0], 5000)


def test_knn_plan_is_a_top_k(spark, small):
    df = knn.knn(spark.read.parquet(f"{small}/embeddings.parquet"), [0.0] * 64, 5, where=F.col("label") == 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan


def test_knn_without_vectors(spark):
    """Rows without a vector, or with a null in it, are no neighbours."""
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [1.0, 5.0]), (4, [2.0, 0.0])], "vec_id int, embedding array<double>")
    assert [r.vec_id for r in knn.knn(df, [1.0, 0.0], 4).collect()] == [4, 3]
    found = knn.knn_batch(df.withColumnRenamed("vec_id", "query_id"), df, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in found) == [(3, 1, 3, 0.0), (3, 2, 4, round(26**0.5, 6)), (4, 1, 4, 0.0), (4, 2, 3, round(26**0.5, 6))]
    assert knn.knn_batch(df.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), df, 3).collect() == []


@pytest.mark.parametrize("at", [0.0, 100.0, 1e6])
def test_knn_batch_brute(spark, monkeypatch, at):
    """Large values don't blur distances: each vector is at 0 from itself, ties go to the least key, whatever the batches."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(at, 1, (300, 16)), 3)
    x[200:] = x[:100]
    base = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>").repartition(3)
    monkeypatch.setattr(knn, "BASE_ROWS", 17)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 40)
    got = sorted((q.query_id, q["rank"], q.vec_id, q.distance) for q in knn.knn_batch(base.withColumnRenamed("vec_id", "query_id"), base, 5).collect())
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    want = [(f"k{i:03}", n, f"k{j:03}", d[i, j]) for i in range(300) for n, j in enumerate(sorted(range(300), key=lambda j: (d[i, j], j))[:5], 1)]
    assert got == want and all(g[3] == 0 for g in got if g[1] == 1)


def test_knn_batch_is_one_pass(spark):
    base = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "vec_id bigint, embedding array<double>")
    plan = knn.knn_batch(base.withColumnRenamed("vec_id", "query_id"), base, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_knn_batch_blocks(spark, monkeypatch):
    base = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id bigint, embedding array<float>")
    queries = base.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, knn.knn_batch(queries, base, 3).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, knn.knn_batch(queries, base, 3).collect())) == want
    assert want[:3] == [(0, 0, 0.0, 1), (0, 1, 1.0, 2), (0, 2, 2.0, 3)]


def test_vector_table(spark, tmp_path):
    t = knn.VectorTable(spark, f"file://{tmp_path}/v", 2, key="id string", partition=["lang string"], metadata=["page int"], auxiliary=["note string"])
    rows = lambda *r: spark.createDataFrame(list(r), "id string, page int, note string, embedding array<float>, lang string")
    t.upsert(rows(("a", 1, None, [1.0, 0.0], "fr"), ("b", 2, "x", [0.0, 1.0], "en")))
    t.upsert(rows(("b", 3, "y", [0.5, 0.5], "en")))
    assert {(r.id, r.page) for r in t.read().collect()} == {("a", 1), ("b", 3)}
    assert [r.id for r in t.search([1.0, 0.0], 2, where=F.col("lang") == "en").collect()] == ["b"]
    t.update(spark.createDataFrame([("a", 9)], "id string, page int"))
    assert t.point("a").first().page == 9 and list(t.point("a").first().embedding) == [1.0, 0.0]
    with pytest.raises(ValueError, match="partition"):
        t.update(spark.createDataFrame([("a", "de")], "id string, lang string"))
    with pytest.raises(Exception, match="declaration"):
        t.upsert(rows(("c", 1, None, [1.0], "fr")))
    with pytest.raises(ValueError, match="auxiliary"):
        t.search([1.0, 0.0], 1, filter_columns=["note"])
    t.delete(spark.createDataFrame([("a",)], "id string"))
    assert t.read().count() == 1
    assert t.prepare("m2", ("m1", 2)) == ("m2", 2) and t.read().count() == 0
    t.drop()
    assert t.read().count() == 0


def test_fulltext(spark):
    pages = spark.createDataFrame(FRENCH, "doc_id int, text string")
    found = lambda q: [r.doc_id for r in fulltext.bm25(pages, q).collect()]
    assert found("verite") == [2] and found('"liberté*" : (^)') == [1] and found("xylo") == [2]
    assert found("liberté xylo") == [] and found("...") == []
    assert fulltext.snippet(pages, "libert").first().snippet == "…«liberté» chez Sartre."
    index = fulltext.postings(pages)
    assert [r.doc_id for r in fulltext.bm25_indexed(index, fulltext.lengths(pages), "la xylo").collect()] == [2]


@pytest.mark.parametrize("query", ["?!", "", "  ", "-- ..."])
def test_searches_without_words(spark, query):
    from quire.operators.tools import Toolbox

    pages = spark.createDataFrame(FRENCH, "doc_id int, text string")
    assert fulltext.bm25(pages, query).collect() == fulltext.snippet(pages, query).collect() == fulltext.bm25_indexed(fulltext.postings(pages), fulltext.lengths(pages), query).collect() == []
    box = Toolbox(_pages(spark), spark.createDataFrame([("d", "T", "recognized")], "document_id string, title string, status string"))
    assert box.execute("search_library", json.dumps({"query": query})) == "nothing found"


def test_scripts(spark):
    """Both sides of a search are folded alike, however a text was typed."""
    import unicodedata

    text = "Hello, World: l'Été! 한국 어 が नमस्ते Ёж"
    pages = spark.createDataFrame([(1, text), (2, "か"), (3, None), (4, "")], "doc_id int, text string")
    index = fulltext.postings(pages)
    for query in ("ete", "ÉTÉ", "한국", "が", "नमस्ते", "ёж", "еж", "world hel"):
        for typed in (query, unicodedata.normalize("NFD", query)):
            assert [r.doc_id for r in fulltext.bm25(pages, typed).collect()] == [1], typed
            assert [r.doc_id for r in fulltext.bm25_indexed(index, fulltext.lengths(pages), typed).collect()] == [1]
    shown = lambda q: [r.snippet for r in fulltext.snippet(pages, q, words=3).collect()]
    assert shown("한국") == ["…«한국» 어 が…"] and shown("hel") == ["«Hello», World: l…"] and shown("еж") == ["…«Ёж»"] and shown("ete") == ["…«Été»! 한국 어…"]


def test_snippet_takes_the_best_window(spark):
    pages = spark.createDataFrame([(1, "red " + "x " * 20 + "red blue. " + "y " * 20 + "red red Red"), (2, "\u0301 a red b")], "doc_id int, text string")
    shown = {r.doc_id: r.snippet for r in fulltext.snippet(pages, "blue red", words=4).collect()}
    assert shown == {1: "…«red» «blue». y y…", 2: "…«red» b"}


CATALOG = {
    "document": ([("d", "e1"), ("e", "e2"), ("f", None), ("g", "gone")], "document_id string, edition_id string"),
    "edition": ([("e1", "w1"), ("e2", "w2")], "edition_id string, work_id string"),
    "work": ([("w1", "Critique"), ("w2", "Sans auteur")], "work_id string, title string"),
    "work_creator": ([("w1", "c1", 2), ("w1", "c2", 0)], "work_id string, creator_id string, position int"),
    "creator": ([("c1", "Kant"), ("c2", "Barni")], "creator_id string, name string"),
}


def test_search_passages(spark):
    """Hits carry passage, title and authors; documents without a work aren't hits, even of the limit."""
    tables = [spark.createDataFrame(*CATALOG[n]) for n in ("document", "edition", "work", "work_creator", "creator")]
    pages = spark.createDataFrame([*PAGES, ("e", 1, "La raison."), ("f", 1, "raison raison"), ("g", 1, "raison")], "document_id string, page_number int, content string")
    hits = fulltext.search_passages(pages, *tables, "RAISON").collect()
    assert {(r.document_id, r.page_number): (r.snippet, r.title, r.authors) for r in hits} == {
        ("d", 1): ("Kant écrit que la «raison» pure examine ses limites."[:0] + "…«raison» pure examine ses limites.", "Critique", ["Barni", "Kant"]),
        ("d", 3): ("…«raison» pure se dépasse elle-même.", "Critique", ["Barni", "Kant"]),
        ("e", 1): ("…«raison».", "Sans auteur", []),
    }
    assert [r.score for r in hits] == sorted((r.score for r in hits), reverse=True) and len(fulltext.search_passages(pages, *tables, "raison", 1).collect()) == 1
    assert fulltext.search_passages(pages, *tables, "?!").collect() == []
    vectors = spark.createDataFrame([("d", 2, [1.0, 0.0]), ("f", 1, [1.0, 0.1]), ("e", 7, [0.9, 0.5]), ("d", 1, None)], "document_id string, page_number int, embedding array<float>")
    both = hybrid.search_pages(pages, vectors, *tables, "raison", [1.0, 0.0]).collect()
    assert {(r.document_id, r.page_number): r.excerpt for r in both} == {("d", 1): "…«raison» pure examine ses limites.", ("d", 3): "…«raison» pure se dépasse elle-même.", ("e", 1): "…«raison».", ("d", 2): PAGES[1][2], ("e", 7): ""}
    assert both[0].score == round(1 / 61, 8) and {r.title for r in both} == {"Critique", "Sans auteur"}
    assert hybrid.search_pages(pages, vectors, *tables, " ", [1.0, 0.0]).collect() == []
    assert len(hybrid.search_pages(pages, vectors, *tables, "raison", None).collect()) == 3


def test_fuse_breaks_ties_by_key(spark):
    a, b = (spark.createDataFrame([(k, 1)], "doc_id int, rank int") for k in (2, 1))
    assert [r.doc_id for r in hybrid.fuse([a, b], ["doc_id"]).collect()] == [1, 2]


def test_search_has_no_wildcards(spark):
    work = spark.createDataFrame([("1", "100% sure", None), ("2", "100 sure", "x_y")], "work_id string, title string, subtitle string")
    wc, creator = spark.createDataFrame([("2", "c")], "work_id string, creator_id string"), spark.createDataFrame([("c", "Kant")], "creator_id string, name string")
    found = lambda q: [r.work_id for r in catalog.search_works(work, wc, creator, q).collect()]
    assert found("0%") == ["1"] and found("X_Y") == ["2"] and found("kANT") == ["2"] and found(" ") == ["2", "1"] and found("xzy") == []


def test_paths(spark):
    df = spark.createDataFrame([("/ancien/racine/Philo/K.pdf",), ("/ancien/racine2/x",), ("/ANCIEN/racine/x",)], "p string")
    assert [r[0] for r in df.select(catalog.rebase("p", "/ancien/racine", "/nouveau/chez-moi")).collect()] == ["/nouveau/chez-moi/Philo/K.pdf", "/ancien/racine2/x", "/ANCIEN/racine/x"]


def test_ingest(spark):
    scanned = spark.createDataFrame([("/l/Kant_1781_Critique.pdf", "Kant_1781_Critique.pdf", "h1"), ("/l/scan sans nom.pdf", "scan sans nom.pdf", "h2"), ("/l/philo/copie de kant.pdf", "copie de kant.pdf", "h1")], "path string, file_name string, content_hash string")
    none = scanned.limit(0)
    first = ingest.report(ingest.plan(none, scanned), 1).first().asDict()
    assert first == {"scanned": 3, "added": 3, "kept": 0, "removed": 0, "recognized": 1, "needs_review": 1, "duplicates": 1, "unsupported": 1}
    again = ingest.report(ingest.plan(scanned, scanned)).first()
    assert (again.added, again.kept, again.removed) == (0, 3, 0)
    gone = ingest.report(ingest.plan(scanned, scanned.where("content_hash = 'h1'"))).first()
    assert (gone.removed, gone.kept) == (1, 2)
    records = ingest.new_records(ingest.plan(none, scanned))
    assert records["work"].count() == 3 and records["creator"].count() == 1
    assert records["document"].join(records["edition"], "edition_id").join(records["work"], "work_id").count() == 3


PAGES = [("d", 1, "Kant écrit que la raison pure examine ses limites."), ("d", 2, "Les intuitions sans concepts sont aveugles."), ("d", 3, "Hegel note que la raison pure se dépasse elle-même.")]


def _pages(spark):
    return spark.createDataFrame(PAGES, "document_id string, page_number int, content string")


@pytest.mark.parametrize(
    ("page", "quote", "prefix", "suffix", "want"),
    [
        (2, "INTUITIONS sans\nconcepts", None, None, ("found", 2)),
        (1, "intuitions sans concepts", None, None, ("moved", 2)),
        (None, "intuitions sans concepts", None, None, ("found", 2)),
        (9, "la raison pure", "note que ", " se dépasse", ("moved", 3)),
        (9, "la raison pure", None, None, ("moved", 1)),
        (1, "introuvable", None, None, ("lost", None)),
        (1, "  ", None, None, ("lost", None)),
    ],
)
def test_annotations(spark, page, quote, prefix, suffix, want):
    note = spark.createDataFrame([("n", "d", page, quote, prefix, suffix)], "annotation_id string, document_id string, page int, quote string, prefix string, suffix string")
    got = verify.resolve_annotations(note, _pages(spark)).first()
    assert (got.kind, got.to_page) == want


def test_new_annotations(spark):
    schema = "document_id string, page int, quote string"
    known = spark.createDataFrame([("d", 1, "Été")], schema)
    found = spark.createDataFrame([("d", 1, "ete"), ("d", None, "ete"), ("d", 2, "x"), ("d", 2, "X ")], schema)
    assert {(r.page, r.quote.strip().lower()) for r in verify.new_annotations(found, known).collect()} == {(None, "ete"), (2, "x")}


def test_citation_cascade(spark):
    citations = spark.createDataFrame([(1, "d", 2, "intuitions sans concepts"), (2, "nope", 1, None), (3, "d", 9, None), (4, "d", 1, "rien de tel ici"), (5, "d", 1, "intuitions sans concepts"), (6, "e", 1, None), (7, "d", 1, "court")], "citation_id int, document_id string, page int, quote string")
    titles = spark.createDataFrame([("d", "T"), ("e", "U")], "document_id string, title string")
    got = {r.citation_id: (r.verdict, r.at_page) for r in verify.verify_citations(citations, titles, _pages(spark)).collect()}
    assert got == {1: ("valid", None), 2: ("invalidSource", None), 3: ("pageOutOfRange", 3), 4: ("quoteNotFound", None), 5: ("foundElsewhere", 2), 6: ("noTextAvailable", None), 7: ("valid", None)}


def _epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>La Cité antique</dc:title><dc:creator>Fustel</dc:creator><dc:date>1864-01-01</dc:date><dc:language>FRA</dc:language><dc:identifier>urn:isbn:978-2-7073-0214-4</dc:identifier></metadata><manifest><item id="a" href="t%20xt.xhtml#f"/><item id="b" href="long.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="zz"/><itemref idref="a"/></spine></package>')
        z.writestr("OEBPS/t xt.xhtml", "<html><head><title>no</title></head><body><p>Bonjour</p></body></html>")
        z.writestr("OEBPS/long.xhtml", f"<html><body>{'mot ' * 2100}</body></html>")
    return out.getvalue()


def test_books(spark):
    rows = spark.createDataFrame([("a.epub", "epub", bytearray(_epub())), ("b.epub", "epub", bytearray(b"no")), ("c.txt", "txt", bytearray("é\n\nb".encode("latin-1"))), ("d.mobi", "mobi", bytearray(b"x"))], "path string, format string, content binary")
    pages = {(r.path, r.page_number): r.content for r in files.extract(rows).collect()}
    assert sorted(pages) == [("a.epub", 1), ("a.epub", 2), ("a.epub", 3), ("a.epub", 4), ("c.txt", 1)]
    assert pages["a.epub", 4] == "Bonjour" and pages["c.txt", 1] == "é\n\nb" and len(pages["a.epub", 1]) == 4000
    guess = {r.path: r.guess for r in files.epub_guess(rows.where("format = 'epub'")).collect()}
    g = guess["a.epub"]
    assert (g.title, g.author, g.year, g.language, g.isbn13) == ("La Cité antique", "Fustel", "1864", "fr", "9782707302144") and guess["b.epub"] is None


def test_damaged_books(spark):
    """A damaged, an encrypted and a truncated book beside good ones: what can be read is, and nothing stops."""
    good = _epub()
    z = zipfile.ZipFile(io.BytesIO(good))
    last = max((i for i in z.infolist() if i.filename.endswith("html")), key=lambda i: i.header_offset)
    at = last.header_offset + 30 + len(last.filename.encode())
    damaged = bytearray(good)
    damaged[at : at + 8] = b"\xff" * 8
    encrypted = bytearray(good)
    start = -1
    while (start := encrypted.find(b"PK\x01\x02", start + 1)) >= 0:
        encrypted[start + 8] |= 1
    packed = bytearray(good)
    start = packed.find(b"PK\x01\x02", packed.find(last.filename.encode(), at) - 60)
    packed[start + 10] = 99  # a way of packing that isn't known
    books = [("ok.epub", good), ("damaged.epub", damaged), ("encrypted.epub", encrypted), ("packed.epub", packed), ("cut.epub", good[: len(good) // 2]), ("none.epub", b"")]
    rows = spark.createDataFrame([(n, "epub", bytearray(c)) for n, c in books], "path string, format string, content binary")
    n = {r["path"]: r["n"] for r in files.extract(rows).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert n["ok.epub"] == 4 and 0 < n["damaged.epub"] < 4 and not {"encrypted.epub", "cut.epub", "none.epub"} & n.keys()
    guess = {r.path: r.guess for r in files.epub_guess(rows).collect()}
    assert guess["damaged.epub"] == guess["ok.epub"] is not None and guess["encrypted.epub"] is guess["cut.epub"] is None

    document = spark.createDataFrame([(p, "epub", p, p, False, False) for p, _ in books] + [("gone", "epub", "gone", "gone", False, False)], "document_id string, format string, file_path string, file_name string, is_extracted boolean, needs_ocr boolean")
    outcome, pages = files.extract_pending(document, rows.select("path", "content"))
    old = spark.createDataFrame([(p, 1, "old") for p in ("ok.epub", "cut.epub", "gone")], "document_id string, page_number int, content string")
    document, left = ingest.replace_pages(document, old, pages, treated=outcome.where("is_extracted"))
    assert {(r.document_id) for r in left.where("content = 'old'").collect()} == {"gone"}
    assert {r.document_id for r in document.where("NOT is_extracted").collect()} == {"gone"}


def test_pdf_pages(spark):
    rows = spark.createDataFrame([("a", 1, " " + "x" * 60), ("a", 2, "  "), ("a", 3, "y" * 200), ("s", 1, "few")], "path string, page_number int, content string")
    kept, scans = files.pdf_pages(rows)
    assert {(r.path, r.page_number) for r in kept.collect()} == {("a", 1), ("a", 3)}
    assert {(r.path, r.needs_ocr) for r in scans.collect()} == {("a", False), ("s", True)}


def test_scan(spark, tmp_path):
    for name, content in {"Kant_1781_Critique.pdf": "contenu de test", "philo/copie.PDF": "contenu de test", "notes.xlsx": "no", ".hidden/x.pdf": "h", "k.sdr/y.pdf": "s"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(content)
    got = {r.file_name: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got.keys() == {"Kant_1781_Critique.pdf", "copie.PDF", "notes.xlsx"}
    assert got["copie.PDF"].relative_folder == "philo" and got["copie.PDF"].supported and not got["notes.xlsx"].supported
    groups = ingest.duplicate_groups(files.scan(spark, str(tmp_path)).where("supported")).collect()
    assert len(groups) == 1 and len(groups[0].paths) == 2


def test_npy(spark, tmp_path):
    a = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    numpy_files.register(spark)
    got = spark.read.format("npy").load(f"file://{tmp_path}/a.npy").orderBy("rowid").collect()
    assert [list(r.vector) for r in got] == a.tolist()
    raw = spark.createDataFrame([(bytearray((tmp_path / "a.npy").read_bytes()),)], "content binary")
    assert numpy_files.from_column(raw).count() == 4
    for bad in (a.astype("<f8"), np.asfortranarray(a)):
        np.save(tmp_path / "b.npy", bad)
        with pytest.raises(ValueError, match="only"):
            numpy_files.parse((tmp_path / "b.npy").read_bytes())


def test_npy_in_ranges(spark, tmp_path, monkeypatch):
    """Parts of a file by rows; a predicate on rowid opens those that may hold a row."""
    a = np.arange(300, dtype="<f4").reshape(100, 3)
    (tmp_path / "d").mkdir()
    np.save(tmp_path / "d" / "a.npy", a)
    np.save(tmp_path / "d" / "b.npy", a[:0])
    reader = numpy_files.NpyReader(f"file://{tmp_path}/d", 120)
    assert [(p.start, p.stop) for p in reader.partitions()] == [(i, i + 10) for i in range(0, 100, 10)]
    got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == list(enumerate(a.tolist()))
    some = numpy_files.FilteredNpyReader(f"file://{tmp_path}/d", 120)
    asked = [GreaterThan(("rowid",), 34), LessThanOrEqual(("rowid",), 51), GreaterThan(("vector",), 1)]
    assert list(some.pushFilters(asked)) == asked and [(p.start, p.stop) for p in some.partitions()] == [(35, 45), (45, 52)]
    one = numpy_files.FilteredNpyReader(f"file://{tmp_path}/d", 120)
    list(one.pushFilters([In(("rowid",), (3, 98))]))
    assert [(p.start, p.stop) for p in one.partitions()] == [(3, 13), (13, 23), (23, 33), (33, 43), (43, 53), (53, 63), (63, 73), (73, 83), (83, 93), (93, 99)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        numpy_files.register(spark)
        read = spark.read.format("npy").option("bytes", "120").option("pushdown", "true").load(f"file://{tmp_path}/d")
        assert read.rdd.getNumPartitions() == 10 and read.count() == 100
        assert [list(r.vector) for r in read.where("rowid = 57").collect()] == [a[57].tolist()] and read.where("rowid = 57").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    raw = (tmp_path / "d" / "a.npy").read_bytes()
    (tmp_path / "d" / "a.npy").write_bytes(raw[:-4])
    with pytest.raises(ValueError, match="size"):
        numpy_files.NpyReader(f"file://{tmp_path}/d", 120).partitions()


def test_csl_is_an_array(spark, tmp_path):
    rows = spark.range(7).select(*[F.lit(None).cast("string").alias(c) for c in ("year", "publisher", "isbn13", "doi")], F.concat(F.lit("T"), "id").alias("title"), F.array(F.lit("Ada Byron")).alias("authors"))
    citation.write_csl(rows, f"file://{tmp_path}/one")
    text = "".join(p.read_text() for p in (tmp_path / "one").glob("part-*"))
    assert [x["title"] for x in json.loads(text)] == [f"T{i}" for i in range(7)]
    citation.write_csl(rows.repartition(3), f"file://{tmp_path}/many", files=3)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "many").glob("part-*")]
    assert len(parts) == 3 and sorted(x["title"] for p in parts for x in p) == [f"T{i}" for i in range(7)]
    citation.write_csl(rows.limit(0), f"file://{tmp_path}/none")
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")).strip() in ("", "[]")


def test_chains_of_any_depth(spark, tmp_path):
    """A chain of a thousand in about ten rounds; what stands on a cycle is reported, and a parent that isn't there makes a root."""
    nodes = [(f"c{i}", f"c{i - 1}" if i else None, f"n{i}") for i in range(1_000)] + [("x", "y", "X"), ("y", "z", "Y"), ("z", "x", "Z"), ("below", "x", "B"), ("self", "self", "S"), ("lost", "nowhere", "L")]
    rounds = []
    df = catalog.walk(spark.createDataFrame(nodes, "id string, parent string, name string"), f"file://{tmp_path}/w", rounds=rounds)
    got = {r.id: (r.path, r.depth, r.is_cyclic) for r in df.collect()}
    assert len(rounds) <= 11 and len(got) == len(nodes)
    assert got["c999"] == ("/".join(f"n{i}" for i in range(1_000)), 1_000, False) and got["lost"] == ("L", 1, False)
    assert {k for k, v in got.items() if v[2]} == {"x", "y", "z", "below", "self"} and got["x"][:2] == (None, None)


def test_archive(spark, tmp_path):
    doc = spark.createDataFrame([("d", "/ancien/racine/Philo/K.pdf")], "document_id string, file_path string")
    doc = doc.select("document_id", F.lit(None).cast("string").alias("edition_id"), "file_path", F.lit("K.pdf").alias("file_name"), F.lit(1).cast("long").alias("file_size"), F.lit(None).cast("string").alias("content_hash"), F.lit("pdf").alias("format"), F.current_timestamp().alias("date_added"), F.lit(False).alias("needs_ocr"), F.lit(False).alias("is_extracted"), F.lit("needsReview").alias("status"), F.lit("low").alias("confidence"))
    folder = f"file://{tmp_path}/a"
    manifest = archive.export({"document": doc}, folder, "/ancien/racine")
    assert manifest["documentCount"] == 1
    assert archive.load(spark, folder, "/nouveau/chez-moi")["document"].first().file_path == "/nouveau/chez-moi/Philo/K.pdf"
    again = archive.export({"document": doc}, folder, "/ancien/racine")
    assert again["at"] != manifest["at"] and archive.load(spark, folder)["document"].count() == 1
    broken = doc.withColumn("edition_id", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):  # a job that fails leaves what was there
        archive.export({"document": broken}, folder, "/other")
    assert archive.load(spark, folder)["document"].first().file_path == "/ancien/racine/Philo/K.pdf"
    store = Folder(spark, folder)
    for change, match in (({"formatVersion": 9}, "format"), ({"appliedMigrations": ["z", "a"]}, "a, z")):
        store.commit(store.state()[0], again | change)
        with pytest.raises(ValueError, match=match):
            archive.load(spark, folder)
    with pytest.raises(FileNotFoundError, match="no archive"):
        archive.load(spark, f"file://{tmp_path}/none")


def test_schemas():
    assert schemas.schema("work").fieldNames()[0] == "work_id"
    assert schemas.pending_migrations(["1_ontology"]) == ["2_pages", "3_annotations"]


CHOICES = ['{"choices":[{"delta":{"content":"Je "}}]}', '{"choices":[{"delta":{"content":"cherche."}}]}', '{"choices":[{"delta":{"tool_calls":[{"index":0,"id":"call_1","function":{"name":"search_","arguments":"{\\"qu"}}]}}]}', '{"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"library","arguments":"ery\\":\\"kant\\"}"}}]}}]}', "junk"]
BLOCKS = ['{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"Je "}}', '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"cherche."}}', '{"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"t1","name":"search_library","input":{}}}', '{"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"{\\"query\\":"}}', '{"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"\\"kant\\"}"}}', '{"type":"content_block_start","index":2,"content_block":{"type":"tool_use","id":"t2","name":"library_stats"}}', '{"type":"message_stop"}']


def test_folds(spark):
    rows = lambda events: spark.createDataFrame([("s", i, e) for i, e in enumerate(events)][::-1], "stream_id string, seq int, payload string")
    got = folds.fold_choices(rows(CHOICES)).first()
    assert got.text == "Je cherche." and [tuple(c) for c in got.calls] == [("call_1", "search_library", '{"query":"kant"}')]
    got = folds.fold_blocks(rows(BLOCKS)).first()
    assert got.is_done and got.text == "Je cherche." and [tuple(c) for c in got.calls] == [("t1", "search_library", '{"query":"kant"}'), ("t2", "library_stats", "{}")]
    got = folds.fold_choices(rows(CHOICES[:2])).first()
    assert got.calls == []
    lines = spark.createDataFrame([("data: {}",), (": note",), ("data: [DONE]",)], "value string")
    assert [r.payload for r in folds.sse_payloads(lines).collect()] == ["{}"]


def test_payloads(spark):
    rows = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate([("system", 'Tu "es".'), ("user", "Que dit Kant ?"), ("assistant", "Je cherche."), ("tool", "3 passages")])], "conv_id int, turn int, role string, text string")
    body = json.loads(folds.block_payload(rows, "m").first().payload)
    assert body["system"] == 'Tu "es".' and body["max_tokens"] == 4096
    assert [m["role"] for m in body["messages"]] == ["user", "assistant", "user"]
    assert body["messages"][1]["content"] == [{"type": "text", "text": "Je cherche."}] and body["messages"][2]["content"][0]["type"] == "tool_result"
    assert len(json.loads(folds.chat_payload(rows, "m").first().payload)["messages"]) == 4


def test_streams(spark, small, tmp_path):
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).parquet(f"{small}/events.parquet*")
    name = f"w{uuid.uuid4().hex}"
    q = folds.windowed_counts(stream()).writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table(name).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()
    sink = folds.idempotent_append(f"file://{tmp_path}/out", ["event_id"])
    folds.run_to_end(stream().select("event_id", "user_id"), sink, f"file://{tmp_path}/state")
    sink(spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id"), 1)
    out = folds.read_appended(spark, f"file://{tmp_path}/out")
    assert out.columns == ["event_id", "user_id"]
    assert out.count() == out.select("event_id").distinct().count() == spark.read.parquet(f"{small}/events.parquet").count()


SPEC = {"name": "search_library", "description": "Finds passages.", "parameters": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}}


def test_payloads_with_tools(spark):
    calls = [("c1", "search_library", '{"query": "kant"}'), ("c2", "library_stats", "not json")]
    rows = [(1, 0, "system", "S", None, None), (1, 1, "user", "Q", None, None), (1, 2, "assistant", "", calls, None), (1, 3, "tool", "3 passages", None, "c1"), (1, 4, "system", "again", None, None), (2, 0, "user", None, None, None)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, text string, tool_calls {folds.CALLS}, tool_call_id string")
    chat = {r.conv_id: json.loads(r.payload) for r in folds.chat_payload(df, "m", tools=[SPEC]).collect()}
    assert chat[1] == {"model": "m", "stream": True, "tools": [{"type": "function", "function": SPEC}], "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": "Q"}, {"role": "assistant", "content": "", "tool_calls": [{"id": i, "type": "function", "function": {"name": n, "arguments": a}} for i, n, a in calls]}, {"role": "tool", "content": "3 passages", "tool_call_id": "c1"}, {"role": "system", "content": "again"}]}
    assert chat[2]["messages"] == [{"role": "user", "content": ""}] and "tools" not in json.loads(folds.chat_payload(df, "m").first().payload)
    blocks = {r.conv_id: json.loads(r.payload) for r in folds.block_payload(df, "m", tools=[SPEC]).collect()}
    assert blocks[1] == {"model": "m", "max_tokens": 4096, "stream": True, "system": "S", "tools": [{"name": SPEC["name"], "description": SPEC["description"], "input_schema": SPEC["parameters"]}], "messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "c1", "name": "search_library", "input": {"query": "kant"}}, {"type": "tool_use", "id": "c2", "name": "library_stats", "input": {}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "3 passages"}]}]}
    assert "system" not in blocks[2] and blocks[2]["messages"] == [{"role": "user", "content": ""}]


class Lines:
    """A stand-in for a parser: pages after form feeds, an annotation a line that begins with a type."""

    def pages(self, content):
        if content.startswith(b"broken"):
            raise RuntimeError("no pdf")
        return content.decode().split("\f")

    def info(self, content):
        return {"title": "The fine title", "author": "Hannah Arendt"}

    def annotations(self, content):
        return [{"page": 1, "type": "Highlight", "quote": " second  words ", "note": " "}, {"page": 9, "type": "Text", "quote": "x", "note": "n"}, {"page": 1, "type": "Link", "quote": "x", "note": None}, {"page": 1, "type": "Underline", "quote": " ", "note": None}]


def test_pdf_reader(spark):
    long = "first second words and more " * 4
    rows = [("/l/a.pdf", "a.pdf", "pdf", f"{long}\f \f{long}"), ("/l/s.pdf", "s.pdf", "pdf", "few\f"), ("/l/b.pdf", "b.pdf", "pdf", "broken"), ("/l/t.txt", "t.txt", "txt", "text"), ("/l/x.mobi", "x.mobi", "mobi", "x")]
    own = spark.createDataFrame([(p, n, f, bytearray(c.encode())) for p, n, f, c in rows], "path string, file_name string, format string, content binary")
    assert {(r.path, r.page_number) for r in files.extract(own, Lines()).collect()} == {("/l/a.pdf", 1), ("/l/a.pdf", 3), ("/l/t.txt", 1)}
    guesses = {r.path: r.guess for r in files.repropose(own, Lines()).collect()}
    assert (guesses["/l/a.pdf"].title, guesses["/l/a.pdf"].author) == ("The fine title", "Hannah Arendt") and guesses["/l/b.pdf"].confidence == "fallback" and len(guesses) == 5
    notes = files.read_pdf_annotations(own.where("path = '/l/a.pdf'"), Lines()).collect()
    assert [(r.page, r.quote, r.note, r.prefix) for r in notes] == [(1, "second words", None, "first "), (9, "x", "n", None)]
    document = spark.createDataFrame([(p[3], f, p, n, p == "/l/t.txt") for p, n, f, _ in rows] + [("z", "pdf", "/l/gone.pdf", "gone.pdf", False), ("u", "txt", "/l/t.txt", "t.txt", False)], "document_id string, format string, file_path string, file_name string, is_extracted boolean")
    outcome, pages = files.extract_pending(document, own.select("path", "content"), Lines())
    assert {(r.document_id, r.is_extracted, r.needs_ocr, r.failed) for r in outcome.collect()} == {("a", True, False, False), ("s", True, True, False), ("b", False, False, True), ("z", False, False, True), ("u", True, False, False)}
    assert {(r.document_id, r.page_number) for r in pages.collect()} == {("a", 1), ("a", 3), ("u", 1)}
    without = {r.document_id: r.failed for r in files.extract_pending(document, own.select("path", "content"))[0].collect()}
    assert without == {"a": True, "s": True, "b": True, "z": True, "u": False}
    assert [r.document_id for r in ingest.pending_extraction(document).collect()] == ["a", "b", "z", "s", "u"]


def test_hashes_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "HASHED", 7)
    (tmp_path / "a.txt").write_bytes(b"x" * 100)
    (tmp_path / "é b.txt").write_bytes(b"y")
    got = {r.file_name: r.content_hash for r in files.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": hashlib.sha256(b"x" * 100).hexdigest(), "é b.txt": hashlib.sha256(b"y").hexdigest()}
    assert files.content_hash(f"file://{tmp_path}/none") is None


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    t = knn.VectorTable(spark, path, 1, key="id string")
    rows = lambda i: spark.createDataFrame([(i, [1.0])], "id string, embedding array<float>")
    for i in "abc":
        t.upsert(rows(i))
    assert t.read().count() == 3 and len(t._versions()) == 2
    (tmp_path / "v" / "_claim-v4").write_text("")
    with pytest.raises(RuntimeError, match="another writer"):
        t.upsert(rows("d"))
    assert t.read().count() == 3


def test_no_update_is_lost(spark, tmp_path):
    """A writer that began before another one's commit fails and changes nothing."""
    t = knn.VectorTable(spark, f"file://{tmp_path}/v", 1, key="id string", metadata=["price decimal(10, 2)"])
    rows = lambda i: spark.createDataFrame([(i, [1.0])], "id string, embedding array<float>").withColumn("price", F.lit("1.25").cast("decimal(10, 2)"))
    t.upsert(rows("a"))
    base = t.newest()
    late = t.read(base).unionByName(t.checked(rows("late")))
    t.upsert(rows("b"))
    with pytest.raises(RuntimeError, match="another writer"):
        t._write(late, base)
    assert {r.id for r in t.read().collect()} == {"a", "b"} and not list((tmp_path / "v").glob("_claim*"))
    t.upsert(rows("late"))
    assert t.read().count() == 3


def test_partitions_are_pruned(spark, tmp_path):
    t = knn.VectorTable(spark, f"file://{tmp_path}/v", 1, key="id string", partition=["lang string"])
    t.upsert(spark.createDataFrame([("a", [1.0], "fr"), ("b", [2.0], "en")], "id string, embedding array<float>, lang string"))
    plan = t.search([1.0], 2, where=F.col("lang") != "fr")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_reading_order(spark):
    notes = spark.createDataFrame([("d", "a", None, 1), ("d", "b", 2, 5), ("d", "c", 2, 3), ("e", "x", None, 0)], "document_id string, annotation_id string, page int, date_created int")
    assert {(r.annotation_id, r.place) for r in catalog.reading_order(notes).collect()} == {("c", 1), ("b", 2), ("a", 3), ("x", 1)}


@pytest.mark.parametrize("quote", ["Kant", "a", "raison pure", "ison pu", "la raison pure", "que la raison pure examine ses", "ant écrit que la raison pu", "intuitions sans concepts", "nowhere at all", "zz", "é", "?"])
def test_locate_quotes(spark, quote):
    """As a substring of the folded page, without all pages meeting all quotes."""
    quotes = spark.createDataFrame([("q", quote), ("r", quote)], "quote_id string, quote string")
    found = verify.locate_quotes(quotes, _pages(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower().replace("é", "e").replace("ê", "e")).split())
    want = {(q, d, n) for d, n, t in PAGES for q in "qr" if fold(quote) and fold(quote) in fold(t)}
    assert {tuple(r) for r in found.collect()} == want


def test_curation(spark):
    docs = spark.createDataFrame([("a", "e1", "x.y.pdf", "duplicateCandidate", "low"), ("b", "e2", "z.pdf", "needsReview", "low")], "document_id string, edition_id string, file_name string, status string, confidence string")
    merged = {r.document_id: r for r in catalog.merge(docs, docs.where("document_id = 'a'"), "e2").collect()}
    assert merged["a"].edition_id == "e2" and merged["a"].confidence == "high" and merged["b"].status == "needsReview"
    moved, editions, works = catalog.detach(docs, docs.where("document_id = 'a'"))
    assert works.first().title == "x.y" and moved.where("document_id = 'a'").first().edition_id == editions.first().edition_id
    with pytest.raises(ValueError, match="unknown status"):
        catalog.set_status(docs, docs, "nope")


def test_stateful_fold(spark, tmp_path):
    source = tmp_path / "in"
    schema = "stream_id string, seq int, payload string"
    rows = lambda name, events, at: spark.createDataFrame([(name, at + i, e) for i, e in enumerate(events)], schema)
    name = f"f{uuid.uuid4().hex}"
    rows("a", CHOICES[:3], 0).unionByName(rows("b", BLOCKS[:4], 0)).write.parquet(str(source))
    q = folds.fold_stream(spark.readStream.schema(schema).parquet(str(source)), patience_ms=None).writeStream.format("memory").queryName(name).outputMode("update").start()
    q.processAllAvailable()
    rows("a", CHOICES[3:], 3).unionByName(rows("b", BLOCKS[4:], 4)).write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table(name).collect():
        last[r.stream_id] = max(last.get(r.stream_id, ("", "", False)), (r.text, r.calls, r.is_done), key=lambda x: len(x[1]))
    assert last["a"][0] == "Je cherche." and json.loads(last["a"][1]) == {"0": {"id": "call_1", "name": "search_library", "arguments": '{"query":"kant"}'}}
    assert last["b"][2] and json.loads(last["b"][1])["1"]["arguments"] == '{"query":"kant"}'


def test_stateful_fold_late(spark, tmp_path):
    """A fragment that comes late takes its place, one that comes twice counts once."""
    schema, out = "stream_id string, seq int, payload string", []
    text = lambda t: json.dumps({"choices": [{"delta": {"content": t}}]})
    for rows in ([(2, "c"), (0, "a")], [(1, "b"), (2, "c"), (10, "d")]):
        spark.createDataFrame([("s", n, text(t)) for n, t in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        folded = folds.fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), patience_ms=None)
        folded.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [r.text for r in out if r.text] == ["ac", "abcd"]


def test_stateful_fold_forgets(spark, tmp_path):
    """State goes when no fragment comes for the time given."""
    import time

    schema = "stream_id string, seq int, payload string"
    spark.createDataFrame([("s", 0, CHOICES[0])], schema).write.parquet(f"{tmp_path}/in")
    q = folds.fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), patience_ms=200).writeStream.format("memory").queryName(f"g{uuid.uuid4().hex}").outputMode("update").start()
    kept = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    try:
        for _ in range(90):
            if 1 in kept() and kept()[-1] == 0:
                break
            time.sleep(0.5)
        assert 1 in kept() and kept()[-1] == 0
    finally:
        q.stop()


class Lengths:
    model, dimension = "lengths", 2

    def embed(self, texts):
        return [[float(len(t)), 1.0] if t.strip() else None for t in texts]


def test_semantic_index(spark, tmp_path):
    from quire.operators import semantic

    table = knn.VectorTable(spark, f"file://{tmp_path}/v", 2, key="page string", auxiliary=["document_id string", "page_number int"])
    pages = spark.createDataFrame([*PAGES, ("e", 1, "  ")], "document_id string, page_number int, content string")
    identity = semantic.index_pending(pages.where("page_number < 3"), table, Lengths())
    assert identity == ("lengths", 2) and table.read().count() == 2
    semantic.index_pending(pages, table, Lengths(), identity)
    assert {r.page for r in table.read().collect()} == {"d/1", "d/2", "d/3"}
    assert [r.page for r in table.search([43.0, 1.0], 1).collect()] == ["d/2"]
    semantic.index_pending(pages.limit(0), table, Lengths(), ("other", 2))
    assert table.read().count() == 0


def test_tools(spark):
    from quire.operators.tools import Toolbox

    documents = spark.createDataFrame([("d", "T", "recognized")], "document_id string, title string, status string")
    box = Toolbox(_pages(spark), documents)
    assert box.execute("search_library", '{"query": "intuitions"}') == "[d p. 2] T: …«intuitions» sans concepts sont aveugles."
    named = Toolbox(_pages(spark), documents.withColumn("authors", F.array(F.lit("Kant"), F.lit("Barni"))))
    assert named.execute("search_library", '{"query": "intuitions"}').startswith("[d p. 2] T (Kant, Barni): ")
    assert box.execute("read_page", '{"document_id": "d", "page": 2}').startswith("Les intuitions")
    assert "no page" in box.execute("read_page", '{"document_id": "d", "page": 9}')
    opened = box.call("open_document", '{"document_id": "d", "page": 2, "highlight": "sans concepts"}')
    assert opened.text == "opened « T » at page 2" and opened.command == {"open_document": "d", "page": 2, "highlight": "sans concepts"}
    assert "no document" in box.execute("open_document", '{"document_id": "x", "page": 1}') and "argument" in box.execute("open_document", '{"document_id": "d"}')
    assert "argument" in box.execute("search_library", '{"query": 3}')
    assert json.loads(box.execute("library_stats", ""))["recognized"] == 1
    assert "unknown tool" in box.execute("nope", "") and "JSON" in box.execute("read_page", "{") and "argument" in box.execute("read_page", "{}") and "object" in box.execute("read_page", "[]")


def test_catalog_after_ingest(spark):
    schema = "path string, file_name string, content_hash string"
    files_ = [("/l/Kant_1781_Critique.pdf", "Kant_1781_Critique.pdf", "h1"), ("/l/scan sans nom.pdf", "scan sans nom.pdf", "h2"), ("/l/philo/allemande/copie de kant.pdf", "copie de kant.pdf", "h1")]
    scanned = spark.createDataFrame(files_, schema)
    written = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  as the caller stores each step
    counts = lambda tables: {n: df.count() for n, df in tables.items()}
    planned = written(ingest.plan(scanned.limit(0), scanned))
    tables = {n: spark.createDataFrame([], df.schema) for n, df in ingest.new_records(planned, "l").items()}
    tables = {n: written(df) for n, df in ingest.apply_plan(tables, planned, "l").items()}
    assert counts(tables) == {"work": 3, "edition": 3, "document": 3, "creator": 1, "work_creator": 1}
    assert counts(ingest.apply_plan(tables, planned, "l")) == counts(tables)
    tables["document_page"] = written(tables["document"].select("document_id", F.lit(1).alias("page_number"), F.lit("x").alias("content")))
    known = tables["document"].select(F.col("file_path").alias("path"))
    fewer = written(ingest.plan(known, scanned.where("content_hash = 'h2'")))
    after = {n: written(df) for n, df in ingest.apply_plan(tables, fewer, "l").items()}
    assert counts(after) == {"work": 1, "edition": 1, "document": 1, "creator": 1, "work_creator": 0, "document_page": 1}
    assert ingest.collect_orphans(after, creators=True)["creator"].count() == 0
    works = tables["document"].join(tables["edition"], "edition_id").select("work_id", "file_path")
    tree, items = ingest.collections(works, "/l")
    rows = {r.name: r for r in tree.collect()}
    assert rows.keys() == {"philo", "allemande"} and rows["allemande"].parent_id == rows["philo"].collection_id and rows["philo"].parent_id is None
    assert [r.collection_id for r in items.collect()] == [rows["allemande"].collection_id]


def test_cascade_unlinks_documents(spark):
    tables = {"document": spark.createDataFrame([("d", "e1"), ("f", "e2")], "document_id string, edition_id string"), "edition": spark.createDataFrame([("e2",)], "edition_id string"), "annotation": spark.createDataFrame([("a", "d"), ("b", "zz")], "annotation_id string, document_id string")}
    out = ingest.cascade(tables)
    assert {(r.document_id, r.edition_id) for r in out["document"].collect()} == {("d", None), ("f", "e2")}
    assert [r.annotation_id for r in out["annotation"].collect()] == ["a"]


def test_replace_pages(spark):
    document = spark.createDataFrame([("d", False, True), ("e", True, False)], "document_id string, is_extracted boolean, needs_ocr boolean")
    pages = spark.createDataFrame([("d", 1, "old"), ("e", 1, "keep")], "document_id string, page_number int, content string")
    new = spark.createDataFrame([("d", 1, "  "), ("d", 2, "read")], "document_id string, page_number int, content string")
    docs, out = ingest.replace_pages(document, pages, new, recognized=True)
    assert {tuple(r) for r in docs.collect()} == {("d", True, False), ("e", True, False)}
    assert {tuple(r) for r in out.collect()} == {("d", 2, "read"), ("e", 1, "keep")}
    twice = ingest.replace_pages(docs, out, new, recognized=True)[1]
    assert twice.count() == 2


def test_best_guess(spark):
    embedded = "struct<title:string,author:string,year:string,publisher:string,language:string,isbn13:string,doi:string,confidence:string>"
    rows = [("Kant_1781_Critique.pdf", ("T", "A", None, None, None, None, None, "structured")), ("scan001.pdf", ("Moses", "Assmann", None, None, None, None, None, "structured")), ("scan001.pdf", ("", None, None, None, None, "9782707302144", None, "structured")), ("scan001.pdf", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, name string, e {embedded}")
    got = [r.g for r in df.select("i", files.best_guess(F.col("name"), F.col("e")).alias("g")).orderBy("i").collect()]
    assert [(g.title, g.author, g.confidence) for g in got] == [("Critique", "Kant", "structured"), ("Moses", "Assmann", "structured"), ("scan001", None, "fallback"), ("scan001", None, "fallback")]
    assert got[2].isbn13 == "9782707302144"


def test_upsert_annotations(spark):
    from datetime import datetime

    old = datetime(2020, 1, 1)
    schema = "annotation_id string, quote string, date_created timestamp, date_modified timestamp"
    notes = spark.createDataFrame([("a", "x", old, old), ("b", "y", old, old)], schema)
    out = {r.annotation_id: r for r in catalog.upsert_annotations(notes, spark.createDataFrame([("b", "z", old, None), ("c", "n", None, None)], schema)).collect()}
    assert out["a"].date_modified == old and out["b"].quote == "z" and out["b"].date_created == old and out["b"].date_modified > old and out["c"].date_created > old


def test_authors_keep_gaps(spark):
    """Positions count blank names too, which have no row."""
    wc = spark.createDataFrame([("w", "c1", 4), ("w", "c2", 0), ("v", "c1", 2)], "work_id string, creator_id string, position int")
    creator = spark.createDataFrame([("c1", "Last"), ("c2", "First")], "creator_id string, name string")
    assert {r.work_id: r.authors for r in catalog.authors_by_work(wc, creator).collect()} == {"w": ["First", "Last"], "v": ["Last"]}


def test_isbn_of_answers(spark):
    from quire.sources import payloads

    df = spark.createDataFrame([("978-2-7073-0214-4",), ("2-7073-0214-x",), ("x1x",), ("",)], "raw string")
    assert [r[0] for r in df.select(payloads.normalized_isbn(F.col("raw"))).collect()] == ["9782707302144", "270730214X", "1X", ""]


def test_stored_postings_are_pruned(spark, tmp_path):
    """A search in a stored index reads the rows of its terms only."""
    pages = spark.createDataFrame(FRENCH, "doc_id int, text string")
    fulltext.postings(pages).sort("term").write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    found = fulltext.bm25_indexed(index, fulltext.lengths(pages), "la xylo")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,la)" in plan and "StringStartsWith(term,xylo)" in plan and [r.doc_id for r in found.collect()] == [2]


def test_csl_json_whole(spark):
    from quire.functions import citation

    record = spark.createDataFrame([("T", ["Ann Lee", "Collectif"], "1781", "P", None, "10.1/x")], "title string, authors array<string>, year string, publisher string, isbn13 string, doi string")
    item = json.loads(record.select(citation.csl_item()).first()[0])
    assert item["type"] == "book" and item["title"] == "T" and item["issued"] == {"date-parts": [[1781]]} and item["publisher"] == "P" and item["DOI"] == "10.1/x" and "ISBN" not in item
    assert item["author"][0] == {"family": "Lee", "given": "Ann"}
