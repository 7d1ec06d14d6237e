from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quire.functions import citation as C, text as T, vector as V
from quire.sources import payloads
from quire.streaming import folds


def one(spark, value, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()])
    return df.select(value.alias("v")).first()[0]


# File names of each convention and what they say.
FILE_NAMES = [
    ("Kant_1781_Critique-de-la-raison-pure.pdf", "Critique de la raison pure", "Kant", "1781", None, "structured"),
    ("L' établi -- Robert Linhardt -- Double, Nouvelle édition, Paris, 2011 -- Les Éditions de Minuit -- isbn13 9782707302144 -- 6518c6632001dbe02d1d8574532366bd -- Anna's Archive.epub", "L' établi", "Robert Linhardt", "2011", "9782707302144", "structured"),
    ("Sellars_ND_Kant-s-Transcendental-Idealism.txt", "Kant s Transcendental Idealism", "Sellars", None, None, "structured"),
    ("Celan_1959_Grille-de-parole_1.azw3", "Grille de parole", "Celan", "1959", None, "structured"),
    ("Hegel, les actes de lesprit (Bernard Bourgeois) (Z-Library).pdf", "Hegel, les actes de lesprit", "Bernard Bourgeois", None, None, "structured"),
    ("Marges – de la philosophie (Derrida, Jacques [Derrida, Jacques]) (Z-Library)(1).epub", "Marges – de la philosophie", "Derrida, Jacques", None, None, "structured"),
    ("The Nature of Reality (Richard Webb (editor)) (Z-lib.org).pdf", "The Nature of Reality", "Richard Webb", None, None, "structured"),
    ("L'Attaque des Titans Chapitre 1 (French Edition) (Z-Library).epub", "L'Attaque des Titans Chapitre 1", None, None, None, "fallback"),
    ("Un manuscrit anonyme (2019) (Z-Library).pdf", "Un manuscrit anonyme", None, "2019", None, "fallback"),
    ("111503479-Surveiller-et-Punir.pdf", "Surveiller et Punir", None, None, None, "fallback"),
    ("168204597-Derrida-Jacques-La-Voix-et-le-Phenomene.pdf", "Derrida Jacques La Voix et le Phenomene", None, None, None, "fallback"),
    ("scan_final_VERSION2.pdf", "scan final VERSION2", None, None, None, "fallback"),
    ("a_b_c.txt", "a b c", None, None, None, "fallback"),
]
#: Cases of our own: nesting at any depth, unbalanced parentheses, several persons, several marks.
FILE_NAMES += [
    ("Deep (A (b (c (d (e) f) g) h) i) (Z-Library).pdf", "Deep", "A f g h i", None, None, "structured"),
    ("Open (never closed (Z-Library).pdf", "Open (never closed (Z Library)", None, None, None, "fallback"),
    ("Close) early (Ada Lovelace) (1843) (zlib.org)(2).epub", "Close) early", "Ada Lovelace", "1843", None, "structured"),
    ("Two (First Person) (Second Person) (Z-Library).pdf", "Two (First Person)", "Second Person", None, None, "structured"),
    ("(Z-Library).pdf", "(Z Library)", None, None, None, "fallback"),
    ("Seven (one two three four five six seven) (z-lib.org).pdf", "Seven", None, None, None, "fallback"),
    ("A -- B.pdf", "A    B", None, None, None, "fallback"),
    (" -- B -- C.pdf", "B    C", None, None, None, "fallback"),
    ("Ann_1999b_Some-title_2.pdf", "Some title", "Ann", "1999b", None, "structured"),
    ("Ann_n.d._Title.pdf", "Title", "Ann", None, None, "structured"),
    ("1234567-A_b-pdf.pdf", "A b", None, None, None, "fallback"),
    ("_.pdf", "_", None, None, None, "fallback"),
]


def test_file_names(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(FILE_NAMES)], "i int, name string")
    got = df.select("i", T.parse_file_name("name").alias("g")).orderBy("i").select("g.*").collect()
    assert [(g.title, g.author, g.year, g.isbn13, g.confidence) for g in got] == [n[1:] for n in FILE_NAMES]


@pytest.mark.parametrize(
    ("text", "target", "pages"),
    [("", 10, []), ("  \n ", 10, []), ("a\n\nb", 10, ["a\n\nb"]), ("a\n\nb\n\n" + "c" * 25 + "\n\nd", 10, ["a\n\nb", "c" * 10, "c" * 10, "c" * 5, "d"]), ("aaaa\n\nbbbb\n\ncc", 10, ["aaaa\n\nbbbb", "cc"])],
)
def test_paginate(spark, text, target, pages):
    assert one(spark, T.paginate("t", target), t=text) == pages


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (T.isbn13, "ISBN 978-2-7073-0214-4.", "9782707302144"),
        (T.isbn13, "978-12", None),
        (T.doi, 'at 10.1017/cbo9780511806223"', "10.1017/cbo9780511806223"),
        (T.year, "in 1781 and 1787", "1781"),
        (T.year, "1499", None),
        (T.fold, " Été  \n À ", "ete a"),
        (T.normalized, "L'Être—et,  le néant!", "l etre et le neant"),
        (T.strip_tags, "<p>a<script>x</script>&amp;&lt;b</p>&#233;", "a &<b"),
        (T.natural_name, "Fustel de Coulanges, Numa Denis (1830-1889)", "Numa Denis Fustel de Coulanges"),
        (T.stem, "a.b.pdf", "a.b"),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, fn("t"), t=text) == want


def test_match_terms():
    assert T.match_terms('"Liberté*" : (^)') == ["liberte"]
    assert T.match_terms(" ** ") == []


def test_citations(spark):
    schema = "title string, authors array<string>, year string, publisher string, isbn13 string, doi string"
    df = spark.createDataFrame([("Moses the Egyptian", ["Jan Assmann", "Aleida Assmann"], "1997", "Harvard University Press", "9780521588361", None), ("Moses the Egyptian", None, None, " ", None, None)], schema)
    full, bare = df.select(C.chicago(), C.iso690(), C.bibtex(), C.csl_item()).collect()
    assert full[0] == "Assmann, Jan, and Aleida Assmann. 1997. Moses the Egyptian. Harvard University Press."
    assert full[1] == "ASSMANN, Jan ; ASSMANN, Aleida. Moses the Egyptian. Harvard University Press, 1997. ISBN 9780521588361."
    assert full[2].startswith("@book{assmann1997,\n  author = {Jan Assmann and Aleida Assmann},\n")
    assert '"issued":{"date-parts":[[1997]]}' in full[3] and '{"family":"Assmann","given":"Jan"}' in full[3]
    assert bare[:2] == ("s. d.. Moses the Egyptian.", "Moses the Egyptian.")
    assert bare[2] == "@book{mosessd,\n  title = {Moses the Egyptian}\n}"


def test_vectors(spark):
    v = [1.0, -2.0, 0.5, 0.0, 1.0, 1.0, -1.0, 1.0]
    assert one(spark, V.quantize_binary("v"), v=v) == bytes([0b10110101])
    assert one(spark, V.bits_to_json(V.quantize_binary("v")), v=v) == "[1,0,1,0,1,1,0,1]"
    assert one(spark, V.quantize_int8("v"), v=v[:4]) == [127, -128, 63, 0]
    assert one(spark, V.hamming(V.quantize_binary("v"), F.lit(b"\0")), v=v) == 5
    assert one(spark, V.l2("a", "b"), a=[0.0, 3.0], b=[4.0, 0.0]) == 5
    assert one(spark, V.l1("a", "b"), a=[0.0, 3.0], b=[4.0, 0.0]) == 7
    assert math.isnan(one(spark, V.cosine("a", "b"), a=[0.0, 0.0], b=[4.0, 0.0]))
    assert one(spark, V.to_json("v"), v=[1.5, float("nan")]) == "[1.500000,null]"
    # Ties go to even, values beside a tie to their side, as in SQL's printf.
    assert one(spark, V.to_json("v"), v=[0.0078125, 0.0234375, -0.0078125, 3.5e-6, -1e-9]) == "[0.007812,0.023438,-0.007812,0.000003,-0.000000]"
    assert one(spark, V.to_json("v", half_up=True), v=[0.0078125]) == "[0.007813]"
    for metric in V.METRICS:
        flat, folded = one(spark, V.distance_to(metric, "v", v[::-1]), v=v), one(spark, V.distance(metric, "v", "w"), v=v, w=v[::-1])
        assert flat == pytest.approx(folded)


def test_int8_wraps(spark):
    df = spark.createDataFrame([([127, -128], [1, -1])], "a array<tinyint>, b array<tinyint>")
    assert df.select(V.add_int8("a", "b")).first()[0] == [-128, 127]
    assert df.select(V.add_int8("a", "b", -1)).first()[0] == [126, -127]


@pytest.mark.parametrize("value", [lambda: V.l2("a", "b"), lambda: V.slice_of("a", 0, 9), lambda: V.quantize_binary("a"), lambda: V.distance_to("l2", "a", [1.0])])
def test_wrong_sizes(spark, value):
    with pytest.raises(Exception, match="length|slice|multiple"):
        one(spark, value(), a=[1.0, 2.0], b=[1.0])


# What files and services give, and what is made of it.
TITLES = [("Microsoft Word - thesis.doc", None), ("  A  fine\ttitle ", "A fine title"), ("abc", None), ("1234567", None), ("untitled", None), ("Logik", "Logik"), (None, None)]
AUTHORS = [("admin", None), ("Jo", None), (" Hannah Arendt ", "Hannah Arendt"), ("12345", None), ("Owner", None)]
CROSSREF = [
    ('{"message":{"DOI":"10.1/x","ISBN":["978-0-521-58836-1"],"title":["Moses the Egyptian"],"author":[{"given":"Jan","family":"Assmann"},{"family":"Collectif"}],"issued":{"date-parts":[[1997,3]]},"publisher":"CUP","language":"en"}}', "Moses the Egyptian", "Jan Assmann ; Collectif", "1997", "9780521588361"),
    ('{"message":{"publisher":"CUP"}}', None, None, None, None),
    ("not json", None, None, None, None),
]
OPEN_LIBRARY = [
    ('{"ISBN:9780674727779":{"title":"The Ancient City","authors":[{"name":"Numa Denis Fustel de Coulanges"}],"publish_date":"March 1997","publishers":[{"name":"HUP"}]}}', "The Ancient City", "Numa Denis Fustel de Coulanges", "1997", "9780674727779"),
    ("{}", None, None, None, None),
]
GOOGLE = [
    ('{"totalItems":1,"items":[{"volumeInfo":{"title":"La Cité antique","authors":["Numa Denis Fustel de Coulanges"],"publishedDate":"2009-01-07","industryIdentifiers":[{"type":"ISBN_13","identifier":"9782081218383"}]}}]}', "La Cité antique", "Numa Denis Fustel de Coulanges", "2009", "9782081218383"),
    ('{"totalItems":0}', None, None, None, None),
]
SRU = [
    ('<?xml version="1.0"?><srw:r xmlns:srw="http://x/"><srw:numberOfRecords>1</srw:numberOfRecords><srw:records><srw:record><oai_dc:dc><dc:title>La Cité antique</dc:title><dc:creator>Fustel de Coulanges, Numa Denis (1830-1889)</dc:creator><dc:date>2009</dc:date></oai_dc:dc></srw:record></srw:records></srw:r>', "La Cité antique", "Numa Denis Fustel de Coulanges", "2009", "9782081218383"),
    ('<r xmlns:srw="http://x/"><srw:numberOfRecords>0</srw:numberOfRecords></r>', None, None, None, None),
]
SUMMARIES = [('{"query":"kant"}', "kant"), ('{"highlight":"x","page":3}', "x"), ('{"page":4}', "page 4"), ("{}", "")]


@pytest.mark.parametrize(("fn", "cases"), [(T.sane_title, TITLES), (T.sane_author, AUTHORS), (folds.call_summary, SUMMARIES)], ids=["titles", "authors", "summaries"])
def test_single_values(spark, fn, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()] == [c[1] for c in cases]


ANSWERS = [(payloads.crossref, CROSSREF), (lambda p: payloads.open_library(p, F.lit("9780674727779")), OPEN_LIBRARY), (lambda p: payloads.google_books(p, F.lit("2081218380")), GOOGLE), (lambda p: payloads.library_record(p, F.lit("9782081218383")), SRU)]


@pytest.mark.parametrize(("decoder", "cases"), ANSWERS, ids=["crossref", "open_library", "google", "library_record"])
def test_answers(spark, decoder, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")
    got = df.orderBy("i").withColumn("g", decoder(F.col("payload"))).select("g.title", "g.author", "g.year", "g.isbn13").collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_a_library_record_is_parsed_once(spark):
    """Answers that aren't XML are none; prefixes may be undeclared, only the first record counts, markup parts texts."""
    whole = '<a:r><numberOfRecords>2</numberOfRecords><a-b:record x:y="1"><dc:title> <!-- <title>no</title> --></dc:title><d><title>One<![CDATA[ & <two>]]></title></d><creator>Li, Bo</creator><date>[1999]</date></a-b:record><record><creator>No</creator></record><title>no</title></a:r>'
    df = spark.createDataFrame([(0, whole), (1, "<record><title>cut"), (2, "no xml"), (3, None), (4, whole.replace(">2<", ">0<"))], "i int, payload string")
    df = df.withColumn("g", payloads.library_record(F.col("payload"), F.lit(None).cast("string"))).select("i", "g.title", "g.author", "g.year")
    assert [tuple(r)[1:] for r in df.orderBy("i").collect()] == [("One & <two>", "Bo Li", "1999"), *[(None, None, None)] * 4]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.count("_record(") == 1
