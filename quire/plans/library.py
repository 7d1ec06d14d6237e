"""Catalog, ingest, verification and stream queries.

The synthetic tables stand in for a catalog: parts are works, suppliers their
creators, line items editions, documents the files and page texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog, fulltext, hybrid, ingest, verify
from quire.operators.quoteindex import QuoteIndex
from quire.operators.scanning import spread
from quire.streaming import folds

from .registry import query, scratch, table
from .texts import BARE, LATIN, NORMAL, TERMS, bm25_sql, snippet_sql
from .vectors import L2, embeddings, query_vector

WC = "(SELECT l_partkey AS work_id, l_suppkey AS creator_id, min(l_linenumber) AS position FROM lineitem GROUP BY l_partkey, l_suppkey)"
AUTHORS = f"(SELECT work_id, array_to_string(list(s_name ORDER BY position, s_name), '; ') AS authors, list(s_name ORDER BY position, s_name)[1] AS first FROM {WC} JOIN supplier ON s_suppkey = creator_id GROUP BY work_id)"


def _works(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"))


def _creators(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("creator_id"), F.col("s_name").alias("name"))


def _work_creators(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("creator_id")).agg(F.min("l_linenumber").alias("position"))


def _authors(spark, d):
    return catalog.authors_by_work(_work_creators(spark, d), _creators(spark, d))


def _status(prefix: str = "") -> str:
    return f"CASE WHEN {prefix}quality IS NULL THEN 'duplicateCandidate' WHEN {prefix}toxic = 1 THEN 'ignored' WHEN {prefix}quality = 1 THEN 'recognized' ELSE 'needsReview' END"


def _documents(spark, d):
    """Documents with a status from their labels, an edition for two thirds of them, and a path."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50).alias("edition_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("lang").alias("format"),
        F.expr(_status()).alias("status"),
        F.lit("low").alias("confidence"),
    )


_DOC = f"(SELECT d.doc_id AS document_id, CASE WHEN d.doc_id % 3 <> 0 THEN d.doc_id % 50 END AS edition_id, source || '/' || d.doc_id || '.txt' AS path, d.doc_id || '.txt' AS file_name, sha256(text) AS content_hash, lang AS format, {_status('l.')} AS status, 'low' AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query(f"""SELECT p_partkey AS work_id, p_name AS title FROM part WHERE contains(lower(p_name), 'ar') OR p_partkey IN (SELECT work_id FROM {WC} JOIN supplier ON s_suppkey = creator_id WHERE contains(lower(s_name), '#000000007'))
ORDER BY title, work_id LIMIT 100""")
def catalog_search(spark, d):
    found = [catalog.matching_works(_works(spark, d), _work_creators(spark, d), _creators(spark, d), q) for q in (" AR ", "#000000007")]
    return found[0].union(found[1]).distinct().orderBy("title", "work_id").limit(100)


@query("SELECT p_partkey AS work_id, p_name AS title FROM part ORDER BY title, work_id LIMIT 100")
def catalog_search_all(spark, d):
    return catalog.search_works(_works(spark, d), _work_creators(spark, d), _creators(spark, d), "  ")


@query(f"SELECT work_id, authors FROM {AUTHORS}")
def authors_by_work(spark, d):
    return _authors(spark, d).select("work_id", F.array_join("authors", "; ").alias("authors"))


def _editions_of(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edition_id")).agg(F.min("l_partkey").alias("work_id"), F.year(F.min("l_shipdate")).cast("string").alias("year"))


def _overview(spark, d):
    return catalog.overview(_documents(spark, d).select("document_id", "edition_id", "status"), _editions_of(spark, d), _works(spark, d), _authors(spark, d))


@query(f"""WITH e AS (SELECT l_orderkey AS edition_id, min(l_partkey) AS work_id, CAST(year(min(l_shipdate)) AS VARCHAR) AS year FROM lineitem GROUP BY l_orderkey)
SELECT document_id, title, year, status, first FROM {_DOC} JOIN e USING (edition_id) JOIN (SELECT p_partkey AS work_id, p_name AS title FROM part) USING (work_id) LEFT JOIN {AUTHORS} USING (work_id)""")
def library_overview(spark, d):
    return _overview(spark, d).select("document_id", "title", "year", "status", F.get("authors", F.lit(0)).alias("first"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'recognized') AS recognized, count(*) FILTER (WHERE status = 'needsReview') AS needs_review, count(*) FILTER (WHERE status = 'duplicateCandidate') AS duplicates FROM {_DOC}")
def catalog_stats(spark, d):
    return catalog.stats(_documents(spark, d))


@query("SELECT lang AS format, count(*) AS n FROM documents GROUP BY lang")
def count_by_format(spark, d):
    return catalog.count_by(_documents(spark, d), "format")


@query("SELECT lang AS format, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS readable FROM documents GROUP BY lang")
def readable_names(spark, d):
    """Files by format, and how many of their names say what they are."""
    named = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("Author_1999_Title-"), F.col("document_id").cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("scan "), F.col("document_id").cast("string"), F.lit(".txt")))
    return _documents(spark, d).withColumn("file_name", named).groupBy("format").agg(F.count("*").alias("n"), F.count_if(T.is_readable("file_name")).alias("readable"))


@query("SELECT l_partkey AS work_id, array_to_string(list(DISTINCT l_returnflag ORDER BY l_returnflag), ',') AS collections FROM lineitem GROUP BY l_partkey")
def membership(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("collection_id"))
    return catalog.membership(items).select("work_id", F.array_join("collections", ",").alias("collections"))


@query(f"SELECT p_partkey AS edition_id FROM part WHERE p_partkey NOT IN (SELECT edition_id FROM {_DOC} WHERE edition_id IS NOT NULL)")
def orphan_editions(spark, d):
    editions = table(spark, d, "part").select(F.col("p_partkey").alias("edition_id"))
    return catalog.orphans(editions, _documents(spark, d), "edition_id")


@query("SELECT c_custkey AS creator_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def orphan_creators(spark, d):
    named = lambda t, c: table(spark, d, t).select(F.col(c).alias("creator_id"))
    return catalog.orphan_creators(named("customer", "c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("creator_id")), named("supplier", "s_suppkey"))


_PAGES = "(SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, substr(text, i * 4000 + 1, 4000) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 4000.0) AS BIGINT))) AS i FROM documents))"


def _pages(spark, d, *more):
    """The pages of documents; more: columns of documents that each page has too."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", *more))
    return docs.select(F.col("doc_id").alias("document_id"), F.posexplode(T.paginate("text")).alias("n", "content"), *more).select("document_id", (F.col("n") + 1).alias("page_number"), "content", *more)


_PAGE_KEYS, _SOURCE = "document_id, page_number", f"(SELECT doc_id AS document_id, page_number, content FROM {_PAGES})"
_OF_WORKS = f"(SELECT document_id, work_id, title FROM {_DOC} JOIN (SELECT l_orderkey AS edition_id, min(l_partkey) AS work_id FROM lineitem GROUP BY l_orderkey) USING (edition_id) JOIN (SELECT p_partkey AS work_id, p_name AS title FROM part) USING (work_id))"
_LEXICAL = f"SELECT document_id, page_number, score, work_id, title FROM ({bm25_sql('in thin', None, _SOURCE, _PAGE_KEYS, 'content')}) JOIN {_OF_WORKS} USING (document_id) ORDER BY score DESC, document_id, page_number LIMIT 40"
_SHOWN = snippet_sql("in thin", f"(SELECT * FROM {_SOURCE} WHERE (document_id, page_number) IN (SELECT (document_id, page_number) FROM lex))", _PAGE_KEYS, "content")


def _catalog(spark, d):
    return _documents(spark, d), _editions_of(spark, d), _works(spark, d), _work_creators(spark, d), _creators(spark, d)


@query(f"""WITH lex AS ({_LEXICAL}), shown AS ({_SHOWN})
SELECT document_id, page_number, score, snippet, title, coalesce(authors, '') AS authors FROM lex JOIN shown USING (document_id, page_number) LEFT JOIN {AUTHORS} USING (work_id)""")
def passage_search(spark, d):
    """Pages by their words, with work, authors and the passage itself."""
    return fulltext.search_passages(_pages(spark, d), *_catalog(spark, d), "in thin").withColumn("authors", F.array_join("authors", "; "))


@query(f"""WITH lex AS ({_LEXICAL}), shown AS ({_SHOWN}),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS document_id, 1 AS page_number, round({L2}, 4) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 40),
ranks AS (SELECT document_id, page_number, row_number() OVER (ORDER BY score DESC, document_id, page_number) AS r FROM lex UNION ALL SELECT document_id, page_number, row_number() OVER (ORDER BY distance, document_id) FROM near),
fused AS (SELECT document_id, page_number, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM ranks GROUP BY document_id, page_number ORDER BY score DESC, document_id, page_number LIMIT 20)
SELECT f.document_id, f.page_number, f.score, w.title, coalesce(authors, '') AS authors, coalesce(snippet, substr(content, 1, 220), '') AS excerpt
FROM fused f JOIN {_OF_WORKS} w USING (document_id) LEFT JOIN shown USING (document_id, page_number) LEFT JOIN {_SOURCE} p ON p.document_id = f.document_id AND p.page_number = f.page_number LEFT JOIN {AUTHORS} USING (work_id)""")
def hybrid_pages(spark, d):
    """Pages by words and by vectors, fused and shown with their works."""
    vectors = embeddings(spark, d).select(F.col("vec_id").alias("document_id"), F.lit(1).alias("page_number"), "embedding")
    hits = hybrid.search_pages(_pages(spark, d), vectors, *_catalog(spark, d), "in thin", query_vector(spark, d))
    return hits.withColumn("authors", F.array_join("authors", "; "))


@query(f"SELECT doc_id AS document_id, page_number FROM {_PAGES} WHERE NOT (page_number = 1 AND doc_id IN (SELECT vec_id FROM embeddings))")
def pending_pages(spark, d):
    indexed = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(1).alias("page_number"))
    return ingest.pending(_pages(spark, d).select("document_id", "page_number"), indexed, ["document_id", "page_number"])


@query("SELECT doc_id AS document_id, CAST(max(page_number) AS INTEGER) AS last_page FROM " + _PAGES + " GROUP BY doc_id")
def last_page(spark, d):
    return _pages(spark, d).groupBy("document_id").agg(F.max("page_number").alias("last_page"))


@query(f"SELECT content_hash, array_to_string(list(path ORDER BY path), ';') AS paths FROM {_DOC} GROUP BY content_hash HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return ingest.duplicate_groups(_documents(spark, d)).select("content_hash", F.array_join("paths", ";").alias("paths"))


@query(f"SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM {_DOC}) WHERE n > 1")
def duplicate_members(spark, d):
    return ingest.duplicate_members(_documents(spark, d))


def _sides(spark, d):
    docs = _documents(spark, d)
    return docs.where("document_id % 4 != 0"), docs.where("document_id % 5 != 0")


_DIFF = f"(SELECT path, CASE WHEN document_id % 4 <> 0 AND document_id % 5 <> 0 THEN 'kept' WHEN document_id % 4 <> 0 THEN 'removed' ELSE 'added' END AS change, document_id, content_hash FROM {_DOC} WHERE document_id % 4 <> 0 OR document_id % 5 <> 0)"


@query(f"SELECT path, change FROM {_DIFF}")
def ingest_diff(spark, d):
    return ingest.diff(*_sides(spark, d))


_COPY = f"(SELECT path AS copy_path, row_number() OVER (PARTITION BY content_hash ORDER BY path) > 1 AS is_copy FROM {_DOC} WHERE document_id % 5 <> 0)"


@query(f"""SELECT count(*) FILTER (WHERE change <> 'removed') AS scanned, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'kept') AS kept, count(*) FILTER (WHERE change = 'removed') AS removed,
CAST(0 AS BIGINT) AS recognized, count(*) FILTER (WHERE change = 'added' AND NOT is_copy) AS needs_review, count(*) FILTER (WHERE change = 'added' AND is_copy) AS duplicates, CAST(2 AS BIGINT) AS unsupported
FROM {_DIFF} LEFT JOIN {_COPY} ON path = copy_path""")
def ingest_report(spark, d):
    known, scanned = _sides(spark, d)
    return ingest.report(ingest.plan(known, scanned.select("path", "file_name", "content_hash")), 2)


@query(f"SELECT path AS file_path, sha256('lib:document:' || path) AS document_id, CASE WHEN is_copy THEN 'duplicateCandidate' ELSE 'needsReview' END AS status FROM {_DIFF} JOIN {_COPY} ON path = copy_path WHERE change = 'added'")
def ingest_records(spark, d):
    known, scanned = _sides(spark, d)
    planned = ingest.plan(known, scanned.select("path", "file_name", "content_hash"))
    return ingest.new_records(planned, "lib")["document"].select("file_path", "document_id", "status")


_URLPATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT DISTINCT list_filter(string_split({_URLPATH}, '/'), lambda x: x <> '') AS parts FROM pages),
s AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM p)
SELECT DISTINCT array_to_string(parts[1:n], '/') AS path, CASE WHEN n > 1 THEN array_to_string(parts[1:n - 1], '/') END AS parent, parts[n] AS name, CAST(n AS INTEGER) AS depth FROM s""")
def collection_tree(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return catalog.subtree_paths(table(spark, d, "pages").select(path.alias("path")))


_WALK = """WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
walk AS (SELECT id, name AS path, 1 AS depth FROM node WHERE parent IS NULL UNION ALL SELECT node.id, walk.path || '/' || node.name, walk.depth + 1 FROM node JOIN walk ON node.parent = walk.id)
SELECT id, path, CAST(depth AS INTEGER) AS depth FROM walk"""


@query(_WALK)
def collection_chains(spark, d):
    """The same by pointer doubling, for chains of any depth."""
    of = lambda name, id_, parent, label: table(spark, d, name).select(id_.alias("id"), parent.alias("parent"), F.col(label).alias("name"))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = of("region", key("r", "r_regionkey"), F.lit(None).cast("string"), "r_name").union(of("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).union(of("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name"))
    return catalog.walk(nodes, scratch(spark)).select("id", "path", "depth")


@query(_WALK)
def collection_walk(spark, d):
    """Paths of a tree held as parent links, by a recursive query."""
    for name in ("region", "nation", "supplier"):
        table(spark, d, name).createOrReplaceTempView(f"quire_{name}")
    return spark.sql("""WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS STRING) AS parent, r_name AS name FROM quire_region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM quire_nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM quire_supplier),
walk AS (SELECT id, name AS path, 1 AS depth FROM node WHERE parent IS NULL UNION ALL SELECT node.id, walk.path || '/' || node.name, walk.depth + 1 FROM node JOIN walk ON node.parent = walk.id)
SELECT id, path, depth FROM walk""")


@query("SELECT doc_id AS document_id, CASE WHEN source = 'src1' OR starts_with(source || '/', 'src1/') THEN '/new/place' || substr('/old/' || source || '/' || doc_id, 10) ELSE '/old/' || source || '/' || doc_id END AS path FROM documents")
def path_rebase(spark, d):
    path = F.concat(F.lit("/old/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), catalog.rebase(path, "/old/src1", "/new/place/").alias("path"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY page ASC NULLS LAST, ts, event_id) AS INTEGER) AS place FROM (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'view' THEN event_id % 50 END AS page FROM events)")
def annotation_order(spark, d):
    """Events as annotations of their user's document."""
    rows = table(spark, d, "events").withColumn("page", F.when(F.col("event_type") != "view", F.col("event_id") % 50))
    return catalog.reading_order(rows, "page", "ts", "event_id", document="user_id").select("event_id", "place")


# Curation.


@query(f"SELECT document_id, CASE WHEN document_id % 10 = 0 THEN 'recognized' ELSE status END AS status, CASE WHEN document_id % 10 = 0 THEN 'high' ELSE confidence END AS confidence FROM {_DOC}")
def curation_status(spark, d):
    docs = _documents(spark, d).select("document_id", "status", "confidence")
    return catalog.set_status(docs, docs.where("document_id % 10 = 0"), "recognized")


def _editions(spark, d):
    text = lambda c: F.lit(c).cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("edition_id"), F.col("p_size").cast("string").alias("year"), F.col("p_brand").alias("publisher"), text("en").alias("language"), text(None).alias("isbn13"), text("10.1/x").alias("doi"), F.lit("needsReview").alias("status"), F.when(F.col("p_partkey") % 4 == 0, "high").otherwise("low").alias("confidence"))


def _changes(editions):
    return editions.where("edition_id % 3 = 0").select("edition_id", F.lit(" ").alias("year"), F.lit(" Press ").alias("publisher"), F.lit("fr").alias("language"), F.lit(None).cast("string").alias("isbn13"), F.lit("10.2/y").alias("doi"))


_EDITED = """SELECT p_partkey AS edition_id, CASE WHEN {0} THEN NULL ELSE CAST(p_size AS VARCHAR) END AS year, CASE WHEN {0} THEN 'Press' ELSE p_brand END AS publisher, CASE WHEN {0} THEN 'fr' ELSE 'en' END AS language, CAST(NULL AS VARCHAR) AS isbn13,
{1} AS doi, CASE WHEN {0} THEN 'recognized' ELSE 'needsReview' END AS status, CASE WHEN {0} THEN '{2}' WHEN p_partkey % 4 = 0 THEN 'high' ELSE 'low' END AS confidence FROM part"""


@query(_EDITED.format("p_partkey % 3 = 0", "'10.1/x'", "high"))
def curation_edit(spark, d):
    editions = _editions(spark, d)
    return catalog.edit(editions, _changes(editions))


@query(_EDITED.format("p_partkey % 3 = 0 AND p_partkey % 4 <> 0", "CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 0 THEN '10.2/y' ELSE '10.1/x' END", "probable"))
def curation_accept(spark, d):
    editions = _editions(spark, d)
    return catalog.accept(editions, _changes(editions))


@query(f"SELECT document_id, CASE WHEN status = 'duplicateCandidate' THEN 'kept' ELSE CAST(edition_id AS VARCHAR) END AS edition_id, CASE WHEN status = 'duplicateCandidate' THEN 'recognized' ELSE status END AS status, CASE WHEN status = 'duplicateCandidate' THEN 'high' ELSE confidence END AS confidence FROM {_DOC}")
def curation_merge(spark, d):
    docs = _documents(spark, d).select("document_id", F.col("edition_id").cast("string").alias("edition_id"), "status", "confidence")
    return catalog.merge(docs, docs.where("status = 'duplicateCandidate'"), "kept")


@query(f"SELECT sha256('work:' || document_id) AS work_id, CAST(document_id AS VARCHAR) AS title, 'needsReview' AS status, 'low' AS confidence FROM {_DOC} WHERE document_id % 10 = 3")
def curation_detach(spark, d):
    docs = _documents(spark, d).select("document_id", F.col("edition_id").cast("string").alias("edition_id"), "file_name", "status", "confidence")
    return catalog.detach(docs, docs.where("document_id % 10 = 3"))[2]


# Verification.


@query(f"SELECT item_id AS quote_id, doc_id AS document_id, page_number FROM (SELECT item_id, {NORMAL.format('text')} AS needle FROM benchmark) b, (SELECT doc_id, page_number, {NORMAL.format('content')} AS folded FROM {_PAGES}) p WHERE contains(folded, needle)")
def quote_locate(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return verify.locate_quotes(quotes, _pages(spark, d))


_ASKED = "(SELECT 'whole ' || item_id AS quote_id, text FROM benchmark UNION ALL SELECT 'end ' || item_id, right(text, 12) FROM benchmark)"
#: Pages after the changes of quote_kept.
_REWRITTEN = f"(SELECT p.doc_id, p.page_number, CASE WHEN d.lang = 'es' THEN 'replaced ' || p.content ELSE p.content END AS content FROM {_PAGES} p JOIN documents d ON d.doc_id = p.doc_id WHERE d.source <> 'src3' OR d.lang = 'es')"


@query(f"SELECT quote_id, doc_id AS document_id, page_number FROM (SELECT quote_id, {NORMAL.format('text')} AS needle FROM {_ASKED}) b, (SELECT doc_id, page_number, {NORMAL.format('content')} AS folded FROM {_REWRITTEN}) p WHERE needle <> '' AND contains(folded, needle)")
def quote_kept(spark, d):
    """Whole items and their last characters, in an index that was written, changed and merged before: replaced pages, removed documents."""
    items = table(spark, d, "benchmark")
    quotes = items.select(F.concat(F.lit("whole "), "item_id").alias("quote_id"), F.col("text").alias("quote")).union(items.select(F.concat(F.lit("end "), "item_id"), F.substring("text", -12, 12)))
    pages = _pages(spark, d, "lang", "source")
    index = QuoteIndex(spark, scratch(spark))
    index.add(pages)
    index.remove(pages.where("source = 'src3'"))
    index.merge()
    changed = pages.where("lang = 'es'").withColumn("content", F.concat(F.lit("replaced "), "content"))
    index.replace(changed, ["document_id"], changed)
    return index.locate(quotes)


def _citations(spark, d):
    """A citation of each document: a quote from some page, on a page that may be wrong or out of range."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("citation_id"),
        F.when(F.col("doc_id") % 35 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("document_id"),
        F.when(F.col("doc_id") % 25 == 0, 99).when(F.col("doc_id") % 20 == 0, 2).otherwise(1).alias("page"),
        F.when(F.col("doc_id") % 15 == 0, F.lit("no such words in it")).when(F.col("doc_id") % 10 == 0, F.lit(" a ")).otherwise(F.substring("text", 1, 60)).alias("quote"),
    )


_CIT = "(SELECT doc_id AS citation_id, CASE WHEN doc_id % 35 = 0 THEN doc_id + 1000000 ELSE doc_id END AS document_id, CAST(CASE WHEN doc_id % 25 = 0 THEN 99 WHEN doc_id % 20 = 0 THEN 2 ELSE 1 END AS INTEGER) AS page, CASE WHEN doc_id % 15 = 0 THEN 'no such words in it' WHEN doc_id % 10 = 0 THEN ' a ' ELSE substr(text, 1, 60) END AS quote FROM documents)"


@query(f"""WITH c AS (SELECT *, {NORMAL.format('quote')} AS needle FROM {_CIT}), t AS (SELECT document_id FROM {_OF_WORKS}),
p AS (SELECT doc_id, page_number, {NORMAL.format('content')} AS folded FROM {_PAGES}),
x AS (SELECT c.citation_id, any_value(c.document_id) AS document_id, any_value(c.page) AS page, any_value(c.needle) AS needle, max(p.page_number) AS last_page, bool_or(p.page_number = c.page AND contains(folded, needle)) AS on_page,
min(CASE WHEN p.page_number <> c.page AND contains(folded, needle) THEN p.page_number END) AS elsewhere FROM c LEFT JOIN p ON p.doc_id = c.document_id GROUP BY c.citation_id),
v AS (SELECT *, CASE WHEN document_id NOT IN (SELECT document_id FROM t) THEN 'invalidSource' WHEN last_page IS NULL THEN 'noTextAvailable' WHEN page > last_page THEN 'pageOutOfRange' WHEN length(needle) < 8 OR on_page THEN 'valid' WHEN elsewhere IS NOT NULL THEN 'foundElsewhere' ELSE 'quoteNotFound' END AS verdict FROM x)
SELECT citation_id, verdict, CAST(CASE verdict WHEN 'foundElsewhere' THEN elsewhere WHEN 'pageOutOfRange' THEN last_page END AS INTEGER) AS at_page FROM v""")
def citation_verify(spark, d):
    titles = verify.cited_titles(*_catalog(spark, d)[:3])
    return verify.verify_citations(_citations(spark, d), titles, _pages(spark, d)).select("citation_id", "verdict", "at_page")


_FOLD = rf"trim(regexp_replace(translate(lower({{0}}), '{LATIN}', '{BARE}'), '\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 1 ELSE 7 END AS INTEGER) AS page, substr(text, 4100, 30) AS quote, substr(text, 4090, 10) AS prefix, substr(text, 4130, 10) AS suffix FROM documents),
f AS (SELECT *, {_FOLD.format('quote')} AS needle, {_FOLD.format('prefix || quote || suffix')} AS context FROM a),
p AS (SELECT doc_id, page_number, {_FOLD.format('content')} AS folded FROM {_PAGES}),
h AS (SELECT f.doc_id, bool_or(page_number = page) AS still, min(CASE WHEN contains(folded, context) THEN page_number END) AS in_context, min(page_number) AS first FROM f JOIN p ON f.doc_id = p.doc_id WHERE needle <> '' AND contains(folded, needle) GROUP BY f.doc_id)
SELECT f.doc_id AS annotation_id, CASE WHEN first IS NULL THEN 'lost' WHEN coalesce(still, false) OR page IS NULL THEN 'found' ELSE 'moved' END AS kind,
CAST(CASE WHEN first IS NULL THEN NULL WHEN coalesce(still, false) THEN page ELSE coalesce(in_context, first) END AS INTEGER) AS to_page FROM f LEFT JOIN h USING (doc_id)""")
def annotation_resolve(spark, d):
    docs = table(spark, d, "documents")
    page = F.when(F.col("doc_id") % 3 == 1, 1).when(F.col("doc_id") % 3 == 2, 7)
    notes = docs.select(F.col("doc_id").alias("annotation_id"), F.col("doc_id").alias("document_id"), page.alias("page"), F.substring("text", 4100, 30).alias("quote"), F.substring("text", 4090, 10).alias("prefix"), F.substring("text", 4130, 10).alias("suffix"))
    return verify.resolve_annotations(notes, _pages(spark, d)).select("annotation_id", "kind", "to_page")


@query(f"""WITH f AS (SELECT doc_id, {_FOLD.format('text')} AS page, {_FOLD.format('substr(text, 100, 20)')} AS q FROM documents), a AS (SELECT *, instr(page, q) AS place FROM f)
SELECT doc_id, CASE WHEN place > 0 AND q <> '' THEN nullif(substr(page, greatest(place - 48, 1), place - greatest(place - 48, 1)), '') END AS prefix, CASE WHEN place > 0 AND q <> '' THEN nullif(substr(page, place + length(q), 48), '') END AS suffix FROM a""")
def quote_context(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.quote_context(F.substring("text", 100, 20), "text").alias("c")).select("doc_id", "c.prefix", "c.suffix")


def _answers(spark, d):
    """Answers with a marker for each second event and a broken one for the others."""
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    good = F.concat(F.lit("As said [[cite:"), uuid, F.lit("|p="), F.col("user_id").cast("string"), F.lit('|"'), "event_type", F.lit('"]] and [[cite:'), uuid, F.lit("|p=3]]."))
    return table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.when(F.col("event_id") % 2 == 0, good).otherwise(F.concat(F.lit("see [[cite:"), uuid, F.lit("|p=x]]"))).alias("text"))


@query("""SELECT event_id AS message_id, CAST(n AS INTEGER) AS n, '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS document_id, CAST(CASE n WHEN 0 THEN user_id ELSE 3 END AS INTEGER) AS page, CASE n WHEN 0 THEN event_type END AS quote
FROM events, range(0, 2) r(n) WHERE event_id % 2 = 0""")
def citation_extract(spark, d):
    return verify.extract_citations(_answers(spark, d)).select("message_id", "n", "document_id", "page", "quote")


@query("""SELECT event_id AS message_id, CASE WHEN event_id % 2 = 0 THEN 'As said (« T ' || event_type || ' », p. ' || user_id || ') and (« T  », p. 3).' ELSE 'see [[cite:00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '|p=x]]' END AS text FROM events""")
def citation_render(spark, d):
    answers = _answers(spark, d)
    checked = verify.extract_citations(answers).withColumn("title", F.concat(F.lit("T "), F.coalesce("quote", F.lit(""))))
    return verify.rendered(answers, checked)


@query("""SELECT event_id AS message_id, CASE event_id % 8 WHEN 0 THEN '- [wrong_page] « T »: page 9, not ' || user_id || chr(10) || '- [wrong_page] « T »: page 9, not 3' WHEN 2 THEN '- [page_out_of_range] « T » has 9 pages, not ' || user_id || chr(10) || '- [page_out_of_range] « T » has 9 pages, not 3'
WHEN 4 THEN '- [quote_not_found] « ' || event_type || ' » isn''t in « T »' || chr(10) || '- [quote_not_found] «  » isn''t in « T »' ELSE '- [unknown_source] no document 00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || chr(10) || '- [unknown_source] no document 00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS feedback FROM events WHERE event_id % 2 = 0""")
def citation_feedback(spark, d):
    """All four lines of feedback, in turn."""
    verdicts = F.array(*map(F.lit, ("foundElsewhere", "pageOutOfRange", "quoteNotFound", "invalidSource")))
    checked = verify.extract_citations(_answers(spark, d)).withColumns({"verdict": F.get(verdicts, (F.col("message_id") % 8 / 2).cast("int")), "title": F.lit("T"), "at_page": F.lit(9)})
    return verify.feedback(checked)


# Streams.


def _fragments(spark, d):
    """Each turn of a conversation as two events: a text delta and a piece of a tool call."""
    turns = table(spark, d, "conversations")
    text = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    call = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.when(F.col("turn") == 0, F.lit("call_1")).alias("id"), F.struct(F.when(F.col("turn") == 0, F.lit("search")).alias("name"), F.concat(F.col("turn").cast("string"), F.lit(",")).alias("arguments")).alias("function"))).alias("tool_calls")).alias("delta"))).alias("choices")))
    parts = turns.select(F.col("conv_id").alias("stream_id"), F.explode(F.array(F.struct((2 * F.col("turn")).alias("seq"), text.alias("payload")), F.struct((2 * F.col("turn") + 1).alias("seq"), call.alias("payload")))).alias("p"))
    return parts.select("stream_id", "p.*")


@query("""SELECT conv_id AS stream_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS text, CASE WHEN bool_or(turn = 0) THEN 'search' END AS name, CASE WHEN bool_or(turn = 0) THEN string_agg(turn || ',', '' ORDER BY turn) END AS arguments FROM conversations GROUP BY conv_id""")
def stream_fold(spark, d):
    folded = folds.fold_choices(_fragments(spark, d))
    return folded.select("stream_id", "text", F.get("calls", F.lit(0))["name"].alias("name"), F.get("calls", F.lit(0))["arguments"].alias("arguments"))


@query("SELECT conv_id AS stream_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS text, bool_or(turn = 1) AS is_done, string_agg('t' || turn || ':search:' || '{\"turn\": ' || turn || '}', ';' ORDER BY turn) AS calls FROM conversations GROUP BY conv_id")
def stream_fold_blocks(spark, d):
    """Each turn as a text delta and a call in three events, and the end of the message."""
    turns = table(spark, d, "conversations")
    event = lambda type_, index, **parts: F.to_json(F.struct(F.lit(type_).alias("type"), index.alias("index"), *[F.struct(*[v.alias(k) for k, v in p.items()]).alias(n) for n, p in parts.items()]))
    at, zero = (F.col("turn") + 1).cast("int"), F.lit(0)
    delta = event("content_block_delta", zero, delta={"type": F.lit("text_delta"), "text": F.col("text")})
    opened = event("content_block_start", at, content_block={"type": F.lit("tool_use"), "id": F.concat(F.lit("t"), F.col("turn").cast("string")), "name": F.lit("search")})
    piece = lambda text: event("content_block_delta", at, delta={"type": F.lit("input_json_delta"), "partial_json": text})
    events = F.array(*[F.struct((4 * F.col("turn") + i).cast("long").alias("seq"), p.alias("payload")) for i, p in enumerate((delta, opened, piece(F.lit('{"turn": ')), piece(F.concat(F.col("turn").cast("string"), F.lit("}")))))])
    rows = turns.select(F.col("conv_id").alias("stream_id"), F.inline(events))
    stop = turns.where("turn = 1").select(F.col("conv_id").alias("stream_id"), F.lit(1 << 40).alias("seq"), F.lit('{"type":"message_stop"}').alias("payload"))
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["id"], c["name"], c["arguments"])), ";")
    return folds.fold_blocks(rows.unionByName(stop)).select("stream_id", "text", "is_done", calls.alias("calls"))


def _with_calls(spark, d):
    """Conversations in which each assistant's turn makes a call and each later one of a user is preceded by its answer."""
    turns = table(spark, d, "conversations").withColumn("turn", 2 * F.col("turn"))
    call = F.array(F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("search").alias("name"), F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit("}")).alias("arguments")))
    said = turns.withColumns({"tool_calls": F.when(F.col("role") == "assistant", call), "tool_call_id": F.lit(None).cast("string")})
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("found by "), F.col("turn").cast("string")).alias("text"), F.lit(None).cast(folds.CALLS).alias("tool_calls"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("tool_call_id"))
    return said.select("conv_id", "turn", "role", "text", "tool_calls", "tool_call_id").unionByName(answers)


_SAID = "(SELECT conv_id, 2 * turn AS turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT conv_id, 2 * turn + 1, 'tool', 'found by ' || 2 * turn FROM conversations WHERE role = 'assistant')"
_SPEC = {"name": "search", "description": "Finds passages.", "parameters": {"type": "object"}}


@query(f"SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS texts, string_agg(CASE role WHEN 'assistant' THEN 'c' || turn || '/search/{{\"turn\":' || turn || '}}' WHEN 'tool' THEN 'c' || turn - 1 ELSE '' END, ',' ORDER BY turn) AS calls, 'search' AS tools FROM {_SAID} GROUP BY conv_id")
def chat_payload(spark, d):
    """Request bodies, read back: roles, texts, calls and the calls that results answer."""
    body = folds.chat_payload(_with_calls(spark, d), "m", tools=[_SPEC])
    back = F.from_json(F.get_json_object("payload", "$.messages"), "array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>")
    call = lambda m: F.concat_ws("/", m["tool_calls"][0]["id"], m["tool_calls"][0]["function"]["name"], m["tool_calls"][0]["function"]["arguments"])
    said = lambda m: F.when(m["tool_calls"].isNotNull(), call(m)).otherwise(F.coalesce(m["tool_call_id"], F.lit("")))
    joined = lambda fn, by: F.array_join(F.transform("back", fn), by)
    return body.withColumn("back", back).select("conv_id", F.size("back").cast("long").alias("n"), joined(lambda m: m["role"], ",").alias("roles"), F.sha2(joined(lambda m: m["content"], "\n"), 256).alias("texts"), joined(said, ",").alias("calls"), F.get_json_object("payload", "$.tools[0].function.name").alias("tools"))


@query(f"""SELECT conv_id, CAST(count(*) FILTER (WHERE role <> 'system') AS INTEGER) AS n, arg_min(text, turn) FILTER (WHERE role = 'system') AS system, string_agg(CASE role WHEN 'tool' THEN 'user:tool_result:c' || turn - 1 || ':' || text WHEN 'assistant' THEN 'assistant:' || CASE WHEN text <> '' THEN 'text:' || text || ';' ELSE '' END || 'tool_use:c' || turn || ':search:' || turn ELSE role || ':' || text END, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system') AS said FROM {_SAID} GROUP BY conv_id""")
def block_payload(spark, d):
    """Request bodies of the other dialect, read back block by block."""
    body = folds.block_payload(_with_calls(spark, d), "m", tools=[_SPEC])
    blocks = lambda c: F.from_json(c, "array<struct<type:string,text:string,id:string,name:string,input:struct<turn:string>,tool_use_id:string,content:string>>")
    block = lambda b: F.when(b["type"] == "text", F.concat(F.lit("text:"), b["text"])).when(b["type"] == "tool_use", F.concat_ws(":", b["type"], b["id"], b["name"], b["input"]["turn"])).otherwise(F.concat_ws(":", b["type"], b["tool_use_id"], b["content"]))
    message = lambda m: F.concat(m["role"], F.lit(":"), F.when(F.startswith(m["content"], F.lit('[{"')), F.array_join(F.transform(blocks(m["content"]), block), ";")).otherwise(m["content"]))
    back = F.from_json(F.get_json_object("payload", "$.messages"), "array<struct<role:string,content:string>>")
    return body.withColumn("back", back).select("conv_id", F.size("back").alias("n"), F.get_json_object("payload", "$.system").alias("system"), F.array_join(F.transform("back", message), "\n").alias("said"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' WHEN turn % 3 = 0 THEN coalesce(text, '') WHEN turn % 3 = 1 THEN coalesce(text, 'page ' || turn) ELSE 'page ' || turn END AS summary FROM conversations")
def call_summary(spark, d):
    """Calls made of turns: by a query, by a highlight with its page, by a page; a system's has no arguments."""
    text, page = F.col("text"), F.col("turn")
    shapes = F.array(F.to_json(F.struct(text.alias("query"))), F.to_json(F.struct(text.alias("highlight"), page.alias("page"))), F.to_json(F.struct(page.alias("page"))))
    arguments = F.when(F.col("role") == "system", F.lit("{}")).otherwise(F.get(shapes, (page % 3).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", folds.call_summary(arguments).alias("summary"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    out = folds.windowed_counts(table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """The first row of each key, through a stream over the table's files."""
    run, kept = scratch(spark), table(spark, d, "events")
    stream = spark.readStream.schema(kept.schema).parquet(f"{d}/events.parquet*")
    folds.run_to_end(stream.select("user_id", "event_type"), folds.idempotent_append(f"{run}/out", ["user_id", "event_type"]), f"{run}/state")
    return folds.read_appended(spark, f"{run}/out")
