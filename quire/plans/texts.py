"""Text, full-text, hybrid and citation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citation as C, text as T
from quire.operators import fulltext, hybrid
from quire.operators.scanning import spread
from quire.operators.textindex import TextIndex
from quire.sources import payloads

from .registry import query, scratch, table
from .vectors import L2, query_vector

TERMS = "worthless thin"
LATIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"
NORMAL = r"trim(regexp_replace(translate(lower({0}), '" + LATIN + "', '" + BARE + r"'), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(translate(lower({0}), '" + LATIN + "', '" + BARE + r"'), '[\p{{L}}\p{{M}}\p{{N}}]+')"
DOC_TOKENS = TOKENS.format("text")


@query(f"SELECT doc_id, {NORMAL.format('text')} AS folded FROM documents")
def normalize_text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.normalized("text").alias("folded"))


@query(rf"SELECT doc_id, trim(regexp_replace(translate(lower(text), '{LATIN}', '{BARE}'), '\s+', ' ', 'g')) AS folded FROM documents")
def fold_text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.fold("text").alias("folded"))


@query(f"SELECT doc_id, CAST(len({DOC_TOKENS}) AS INTEGER) AS n FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).alias("n"))


_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_STRIPPED = rf"regexp_replace(replace({_STRIPPED}, '&#39;', ''''), '&#x?[0-9a-fA-F]+;', ' ', 'g')"
for _entity, _plain in T.ENTITIES:
    if _entity != "&#39;":
        _STRIPPED = f"replace({_STRIPPED}, '{_entity}', '{_plain.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g')) AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags("html").alias("text"))


@query(r"SELECT o_orderkey, nullif(regexp_extract(strftime(o_orderdate, 'issued %d.%m.%Y in print'), '\b(1[5-9][0-9]{2}|20[0-9]{2})\b', 1), '') AS year FROM orders")
def extract_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.year(F.concat(F.lit("issued "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" in print"))).alias("year"))


@query(r"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '978' || printf('%010d', CAST(s_suppkey AS INTEGER)) END AS isbn13 FROM supplier")
def extract_isbn(spark, d):
    digits = F.lpad(F.col("s_suppkey").cast("string"), 10, "0")
    dashed = F.concat(F.lit("ISBN 978-"), F.substring(digits, 1, 1), F.lit("-"), F.substring(digits, 2, 4), F.lit(" "), F.substring(digits, 6, 4), F.lit("-"), F.substring(digits, 10, 1), F.lit("."))
    text = F.when(F.col("s_suppkey") % 3 == 0, F.lit("ISBN 978-1234")).otherwise(dashed)
    return table(spark, d, "supplier").select("s_suppkey", T.isbn13(text).alias("isbn13"))


@query("SELECT p_partkey, '10.' || CAST(1000 + p_size AS VARCHAR) || '/part.' || CAST(p_partkey AS VARCHAR) AS doi FROM part")
def extract_doi(spark, d):
    text = F.concat(F.lit("see doi:10."), (1000 + F.col("p_size")).cast("string"), F.lit("/part."), F.col("p_partkey").cast("string"), F.lit(' "quoted"'))
    return table(spark, d, "part").select("p_partkey", T.doi(text).alias("doi"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS n, substr(text, i * 1000 + 1, 1000) AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)")
def hard_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.hard_split("text", 1000)).alias("n", "part"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, substr(t, i * 4000 + 1, 4000) AS content FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 4000.0) AS BIGINT))) AS i FROM t)""")
def paginate(spark, d):
    """Documents hold no empty lines, so packing never joins; tests cover it."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.paginate("text")).alias("n", "content")).select("doc_id", (F.col("n") + 1).alias("page_number"), "content")


def bm25_sql(query_text: str, limit: int | None = 40, source: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    terms = T.match_terms(query_text)
    hit = lambda i: f"starts_with(w, '{terms[i]}')" if i == len(terms) - 1 else f"w = '{terms[i]}'"
    tf = ", ".join(f"len(list_filter(words, lambda w: {hit(i)}))::DOUBLE AS tf{i}" for i in range(len(terms)))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"""WITH words AS (SELECT {keys}, {TOKENS.format(text)} AS words FROM {source}),
c AS (SELECT {keys}, len(words)::DOUBLE AS dl, {tf} FROM words),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM c)
SELECT {keys}, round({score}, 6) AS score FROM c, s WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))}""" + (f" ORDER BY score DESC, {keys} LIMIT {limit}" if limit is not None else "")


def snippet_sql(query_text: str, source: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """(keys, snippet): the best window of twelve words."""
    terms, word = T.match_terms(query_text), r"'[\p{L}\p{M}\p{N}]+'"
    fits = [f"starts_with(w, '{t}')" if i == len(terms) - 1 else f"w = '{t}'" for i, t in enumerate(terms)]
    different = " + ".join(f"CAST(len(list_filter(own, lambda i: {f.replace('(w,', '(words[i],').replace('w =', 'words[i] =')})) > 0 AS INTEGER)" for f in fits)
    return f"""WITH words AS (SELECT {keys}, {TOKENS.format(text)} AS words, regexp_extract_all({text}, {word}) AS raw, regexp_split_to_array({text}, {word}) AS gaps FROM {source}),
found AS (SELECT *, list_filter(range(1, len(words) + 1), lambda i: list_contains(list_transform([words[i]], lambda w: {' OR '.join(fits)}), true)) AS hits FROM words),
start AS (SELECT *, unnest(hits) AS place FROM found),
win AS (SELECT *, list_filter(hits, lambda i: i >= place AND i < place + 12) AS own FROM start),
best AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {different} DESC, len(own) DESC, place) = 1)
SELECT {keys}, CASE WHEN place = 1 THEN gaps[1] ELSE '…' END || array_to_string(list_transform(range(place, least(place + 11, len(raw)) + 1), lambda i: CASE WHEN i > place THEN gaps[i] ELSE '' END || CASE WHEN list_contains(hits, i) THEN '«' || raw[i] || '»' ELSE raw[i] END), '')
|| CASE WHEN place + 11 < len(raw) THEN '…' ELSE gaps[len(raw) + 1] END AS snippet FROM best"""


@query(bm25_sql("worthless the"))
def fts_bm25(spark, d):
    return fulltext.bm25(table(spark, d, "documents"), "worthless the")


@query(bm25_sql(TERMS))
def fts_prefix(spark, d):
    return fulltext.bm25(table(spark, d, "documents"), f'"{TERMS}*" : (^)')


@query(bm25_sql(TERMS))
def fts_indexed(spark, d):
    docs = table(spark, d, "documents")
    return fulltext.bm25_indexed(fulltext.postings(docs), fulltext.lengths(docs), TERMS)


#: documents after the changes of fts_kept.
_EDITED = "(SELECT doc_id, CASE lang WHEN 'de' THEN 'the ' || text WHEN 'fr' THEN text || ' worthless the' ELSE text END AS text FROM documents WHERE source <> 'src3' OR lang = 'fr')"


@query(bm25_sql("worthless the", source=_EDITED))
def fts_kept(spark, d):
    """A search in an index that was written, changed twice and merged once before: replaced texts, removed documents, dropped places."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    index = TextIndex(spark, scratch(spark))
    index.add(docs)
    index.add(docs.where("lang = 'de'").withColumn("text", F.concat(F.lit("the "), "text")))
    index.merge()
    index.remove(docs.where("source = 'src3'"))
    index.add(docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" worthless the"))))
    return index.search("worthless the")


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def fts_statistics(spark, d):
    index = fulltext.postings(table(spark, d, "documents"))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(snippet_sql(TERMS))
def snippet(spark, d):
    return fulltext.snippet(table(spark, d, "documents"), TERMS)


@query(rf"""WITH lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql(TERMS)})),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS doc_id, round({L2}, 4) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 40),
sem AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS r FROM near),
fused AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM sem) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20)
SELECT f.doc_id, f.score, d.source, d.lang, coalesce(substr(d.text, 1, 220), '') AS excerpt FROM fused f JOIN documents d USING (doc_id)""")
def hybrid_rrf(spark, d):
    """The flagship: lexical and vector candidates fused, then the winners' rows fetched."""
    docs = table(spark, d, "documents")
    best = hybrid.hybrid_search(docs, table(spark, d, "embeddings"), TERMS, query_vector(spark, d))
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", "source", "lang", T.excerpt(F.lit(None).cast("string"), "text").alias("excerpt"))  # 20 rows


# Names and citations.

#: Files of parts, named by six conventions in turn.
_NAMED = """(SELECT p_partkey, p_partkey % 6 AS kind, p_name, replace(p_brand, '#', '') AS brand, replace(p_type, '-', ' ') AS type, CAST(1900 + p_size AS VARCHAR) AS y FROM part)"""


@query(f"""SELECT p_partkey, CASE kind WHEN 0 THEN brand || '_' || y || '_' || replace(type, ' ', '-') WHEN 1 THEN brand || '_ND_' || replace(p_name, ' ', '-') || '_1' WHEN 2 THEN p_name || ' -- Ann ' || brand || ' -- Press, ' || y || ' -- isbn13 9780521588361 -- x'
WHEN 3 THEN p_name || ' (Ann ' || brand || ' (editor)) (' || y || ') (Z-Library)' WHEN 4 THEN '111503479-' || replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '-') || '_' || brand END || '.pdf' AS file_name,
CASE kind WHEN 0 THEN type WHEN 5 THEN p_name || ' ' || brand ELSE p_name END AS title, CASE WHEN kind < 2 THEN brand WHEN kind < 4 THEN 'Ann ' || brand END AS author, CASE WHEN kind IN (0, 2, 3) THEN y END AS year,
CASE WHEN kind = 2 THEN '9780521588361' END AS isbn13, CASE WHEN kind < 4 THEN 'structured' ELSE 'fallback' END AS confidence FROM {_NAMED}""")
def parse_filename(spark, d):
    """One file name a part, in the convention of its number: dated, undated copies, dashed fields, marked groups, numbered, none."""
    brand, year = F.replace("p_brand", F.lit("#"), F.lit("")), (1900 + F.col("p_size")).cast("string")
    dashed = lambda c: F.translate(c, " ", "-")
    shapes = [
        F.concat_ws("_", brand, year, dashed("p_type")),
        F.concat_ws("_", brand, F.lit("ND"), dashed("p_name"), F.lit("1")),
        F.concat_ws(" -- ", "p_name", F.concat(F.lit("Ann "), brand), F.concat(F.lit("Press, "), year), F.lit("isbn13 9780521588361"), F.lit("x")),
        F.concat("p_name", F.lit(" (Ann "), brand, F.lit(" (editor)) ("), year, F.lit(") (Z-Library)")),
        F.concat(F.lit("111503479-"), dashed("p_name")),
        F.concat_ws("_", dashed("p_name"), brand),
    ]
    name = F.concat(F.get(F.array(*shapes), (F.col("p_partkey") % 6).cast("int")), F.lit(".pdf"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("file_name")).withColumn("g", T.parse_file_name("file_name"))
    return rows.select("p_partkey", "file_name", "g.title", "g.author", "g.year", "g.isbn13", "g.confidence")


@query("""SELECT p_partkey, replace(p_name, ' ', '-') || '_' || (1900 + p_size)::VARCHAR || '_' || replace(p_type, ' ', '-') || '.pdf' AS file_name,
trim(regexp_replace(replace(p_type, '-', ' '), '\\s+', ' ', 'g')) AS title, replace(p_name, ' ', '-') AS author, (1900 + p_size)::VARCHAR AS year FROM part""".replace("\\\\", "\\"))
def parse_filename_bulk(spark, d):
    dashed = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("-"))
    name = F.concat(dashed("p_name"), F.lit("_"), (1900 + F.col("p_size")).cast("string"), F.lit("_"), dashed("p_type"), F.lit(".pdf"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("file_name")).withColumn("g", T.parse_file_name("file_name"))
    return rows.select("p_partkey", "file_name", "g.title", "g.author", "g.year")


@query("SELECT s_suppkey, 'Given ' || split_part(s_name, '#', 2) || ' ' || split_part(s_name, '#', 1) AS name FROM supplier")
def natural_name(spark, d):
    family, rest = F.split_part("s_name", F.lit("#"), F.lit(1)), F.split_part("s_name", F.lit("#"), F.lit(2))
    written = F.concat(family, F.lit(", Given "), rest, F.lit(" (1830-1889)"))
    return table(spark, d, "supplier").select("s_suppkey", T.natural_name(written).alias("name"))


def _records(spark, d, *more):
    """Records of parts: one or two authors made from brand and type, some without year or publisher; more: further columns of part."""
    p = spread(table(spark, d, "part"))
    first, second = F.concat(F.lit("Ann "), F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("Bo Lee")
    return p.select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 3 == 0, F.array(first, second)).when(F.col("p_size") % 3 == 1, F.array(first, F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(F.col("p_size") % 5 != 0, (1900 + F.col("p_size")).cast("string")).alias("year"),
        F.when(F.col("p_size") % 2 == 0, F.lit("Press {1}")).alias("publisher"),
        F.when(F.col("p_size") % 7 == 0, F.lit("9780521588361")).alias("isbn13"),
        F.lit(None).cast("string").alias("doi"),
        *more,
    )


_REC = """(SELECT p_partkey, p_name AS title, replace(p_brand, '#', '') AS fam, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS na,
CASE WHEN p_size % 5 <> 0 THEN CAST(1900 + p_size AS VARCHAR) END AS year, CASE WHEN p_size % 2 = 0 THEN 'Press {1}' END AS publisher, CASE WHEN p_size % 7 = 0 THEN '9780521588361' END AS isbn13 FROM part)"""
_KEY = "CASE WHEN na > 0 THEN regexp_replace(lower(fam), '[^a-z0-9]', '', 'g') ELSE regexp_replace(lower(split_part(trim(title), ' ', 1)), '[^a-z0-9]', '', 'g') END || coalesce(year, 'sd')"


@query(f"""SELECT p_partkey, CASE na WHEN 2 THEN fam || ', Ann, and Bo Lee. ' WHEN 1 THEN fam || ', Ann. ' ELSE '' END || coalesce(year, 's. d.') || '. ' || title || '.' || CASE WHEN publisher IS NULL THEN '' ELSE ' ' || publisher || '.' END AS citation FROM {_REC}""")
def cite_chicago(spark, d):
    return _records(spark, d).select("p_partkey", C.chicago().alias("citation"))


@query(f"""SELECT p_partkey, CASE na WHEN 2 THEN upper(fam) || ', Ann ; LEE, Bo. ' WHEN 1 THEN upper(fam) || ', Ann. ' ELSE '' END || title || '.' ||
CASE WHEN publisher IS NULL AND year IS NULL THEN '' ELSE ' ' || concat_ws(', ', publisher, year) || '.' END || CASE WHEN isbn13 IS NULL THEN '' ELSE ' ISBN ' || isbn13 || '.' END AS citation FROM {_REC}""")
def cite_iso690(spark, d):
    return _records(spark, d).select("p_partkey", C.iso690().alias("citation"))


@query(f"""SELECT p_partkey, '@book{{' || {_KEY} || ',' || chr(10) || concat_ws(',' || chr(10), CASE na WHEN 2 THEN '  author = {{Ann ' || fam || ' and Bo Lee}}' WHEN 1 THEN '  author = {{Ann ' || fam || '}}' END,
'  title = {{' || title || '}}', '  year = {{' || year || '}}', '  publisher = {{' || replace(replace(publisher, '{{', chr(92) || '{{'), '}}', chr(92) || '}}') || '}}', '  isbn = {{' || isbn13 || '}}') || chr(10) || '}}' AS entry FROM {_REC}""".replace("{{", "{").replace("}}", "}"))
def bibtex(spark, d):
    return _records(spark, d).select("p_partkey", C.bibtex().alias("entry"))


@query(f"SELECT p_partkey, {_KEY} AS id, year, CAST(na AS INTEGER) AS n_authors FROM {_REC}")
def csl_json(spark, d):
    item = C.csl_item()
    years = F.from_json(F.get_json_object(item, "$.issued.date-parts"), "array<array<int>>")
    authors = F.from_json(F.get_json_object(item, "$.author"), "array<struct<family:string,given:string>>")
    return _records(spark, d).select("p_partkey", F.get_json_object(item, "$.id").alias("id"), F.get(F.get(years, F.lit(0)), F.lit(0)).cast("string").alias("year"), F.coalesce(F.size(authors), F.lit(0)).alias("n_authors"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN p_name || ' ' || p_type WHEN 5 THEN p_name END AS title FROM part""")
def sane_titles(spark, d):
    """Titles as files hold them: a word processor's, one with stray white space, a short one, a number, none, a plain one."""
    number, none = F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit(None).cast("string")
    raw = F.array(F.concat(F.lit("Microsoft Word - "), "p_name", F.lit(".doc")), F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_type", F.lit(" ")), F.substring("p_name", 1, 3), number, none, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.sane_title(F.get(raw, F.col("p_size") % 6)).alias("title"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN c_name WHEN 5 THEN c_mktsegment END AS author FROM customer")
def sane_authors(spark, d):
    """Authors as files hold them: a role in place of a name, initials, a name with stray white space, a number, a list without an end, a plain one."""
    raw = F.array(F.lit("Admin"), F.substring("c_name", 1, 2), F.concat(F.lit(" "), "c_name", F.lit("\n")), F.col("c_custkey").cast("string"), F.repeat("c_name", 10), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.sane_author(F.get(raw, (F.col("c_custkey") % 6).cast("int"))).alias("author"))


def _answers(spark, d):
    """Records of parts as services would describe them; each eleventh is one that a service doesn't know."""
    known = F.col("p_size") % 11 != 0
    return _records(spark, d, "p_size").withColumns({"known": known, "title": F.when(known, F.col("title")), "isbn": F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))})


def _decoded(answers, payload, decoder):
    df = answers.select("p_partkey", "isbn", payload.alias("payload")).withColumn("g", decoder(F.col("payload")))
    return df.select("p_partkey", "g.title", "g.author", "g.year", "g.isbn13")


def _answers_sql(isbn13: str) -> str:
    """What the decoders say: nothing where the service knew nothing."""
    said = "CASE na WHEN 2 THEN 'Ann ' || fam || ' ; Bo Lee' WHEN 1 THEN 'Ann ' || fam END"
    fields = {"title": "title", "author": said, "year": "year", "isbn13": isbn13}
    return f"SELECT p_partkey, {', '.join(f'CASE WHEN p_size % 11 <> 0 THEN {v} END AS {k}' for k, v in fields.items())} FROM {_REC} JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)"


_OWN = "'978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')"


@query(_answers_sql("isbn13"))
def payload_crossref(spark, d):
    words = lambda a: F.split(a, " ")
    people = F.transform(F.filter("authors", lambda a: F.trim(a) != ""), lambda a: F.struct(words(a)[0].alias("given"), words(a)[1].alias("family")))
    issued = F.struct(F.array(F.array(F.col("year").cast("int"), F.lit(3))).alias("date-parts"))
    isbn = F.array(F.regexp_replace("isbn13", r"^(\d{3})(\d)(\d{9})$", "$1-$2-$3"))
    message = F.struct(F.array("title").alias("title"), people.alias("author"), F.when(F.col("year").isNotNull(), issued).alias("issued"), isbn.alias("ISBN"), "publisher")
    return _decoded(_answers(spark, d), F.when(F.col("known"), F.to_json(F.struct(message.alias("message")))).otherwise(F.lit('{"message":{"publisher":"CUP"}}')), payloads.crossref)


@query(_answers_sql(_OWN))
def payload_open_library(spark, d):
    people = F.transform("authors", lambda a: F.struct(F.trim(a).alias("name")))
    book = F.struct("title", people.alias("authors"), F.concat(F.lit("March "), "year").alias("publish_date"), F.array(F.struct(F.col("publisher").alias("name"))).alias("publishers"))
    payload = F.when(F.col("known"), F.to_json(F.create_map(F.concat(F.lit("ISBN:"), "isbn"), book))).otherwise(F.lit("{}"))
    return _decoded(_answers(spark, d), payload, lambda p: payloads.open_library(p, F.concat(F.substring("isbn", 1, 3), F.lit("-"), F.substring("isbn", 4, 10))))


@query(_answers_sql(_OWN))
def payload_google_books(spark, d):
    """Asked by an ISBN of ten digits, so the answer's own one counts."""
    marks = F.array(F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier")))
    volume = F.struct("title", F.filter("authors", lambda a: F.trim(a) != "").alias("authors"), F.concat("year", F.lit("-01-07")).alias("publishedDate"), "publisher", marks.alias("industryIdentifiers"))
    found = F.to_json(F.struct(F.lit(1).alias("totalItems"), F.array(F.struct(volume.alias("volumeInfo"))).alias("items")))
    return _decoded(_answers(spark, d), F.when(F.col("known"), found).otherwise(F.lit('{"totalItems":0}')), lambda p: payloads.google_books(p, F.lit("2081218380")))


@query(_answers_sql(_OWN))
def payload_library_record(spark, d):
    element = lambda name, value: F.coalesce(F.concat(F.lit(f"<dc:{name}>"), value, F.lit(f"</dc:{name}>")), F.lit(""))
    inverted = F.transform(F.filter("authors", lambda a: F.trim(a) != ""), lambda a: F.regexp_replace(a, r"^(\S+) (\S+)$", "$2, $1 (1830-1889)"))
    creators = F.array_join(F.transform(inverted, lambda a: element("creator", a)), "")
    record = F.concat(F.lit("<srw:records><srw:record><oai_dc:dc>"), element("title", F.col("title")), creators, element("date", F.col("year")), F.lit("</oai_dc:dc></srw:record></srw:records>"))
    counted = F.concat(F.lit("<srw:numberOfRecords>"), F.col("known").cast("int").cast("string"), F.lit("</srw:numberOfRecords>"))
    payload = F.concat(F.lit('<?xml version="1.0"?><srw:r xmlns:srw="http://x/">'), counted, F.when(F.col("known"), record).otherwise(F.lit("")), F.lit("</srw:r>"))
    return _decoded(_answers(spark, d), payload, lambda p: payloads.library_record(p, F.col("isbn")))
