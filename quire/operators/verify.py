"""Citations and annotations against page texts: one plan for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import fold, normalized

from .fulltext import of_works
from .quoteindex import QuoteIndex

LEAST_QUOTE = 8
# The form of a citation's marker and the names of the verdicts.
MARKER = r'\[\[cite:([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})\|p=(\d+)(?:\|"([^"\n]{0,300})")?\]\]'
VERDICTS = ("valid", "invalidSource", "pageOutOfRange", "quoteNotFound", "foundElsewhere", "noTextAvailable")


def extract_citations(messages: DataFrame, text: str = "text") -> DataFrame:
    """All columns and (n, raw, document_id, page, quote) of each marker in a text; a number too large isn't a marker."""
    raw = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    rows = messages.select("*", F.posexplode(raw).alias("n", "raw"))
    quoted = F.contains("raw", F.lit('|"'))
    rows = rows.select("*", F.lower(F.regexp_extract("raw", MARKER, 1)).alias("document_id"), F.regexp_extract("raw", MARKER, 2).try_cast("int").alias("page"), F.when(quoted, F.regexp_extract("raw", MARKER, 3)).alias("quote"))
    return rows.where("page is not null")


def cited_titles(document: DataFrame, edition: DataFrame, work: DataFrame) -> DataFrame:
    """(document_id, title) of the documents that can be cited: those with an edition and a work."""
    return of_works(document, edition, work).select("document_id", "title")


def verify_citations(citations: DataFrame, documents: DataFrame, pages: DataFrame, index: QuoteIndex | None = None) -> DataFrame:
    """citations with (verdict, title, at_page).

    citations: (citation_id, document_id, page, quote); documents: (document_id,
    title), those with an edition; pages: (document_id, page_number, content).
    Each page text is folded once and tested against the quotes on its document.
    With an index of the pages (of normalized texts) no text is read but those
    of the pages that have a quote's rarest fingerprint.
    """
    title = documents.select("document_id", "title")
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("last_page"))
    wanted = citations.withColumn("needle", normalized(F.coalesce("quote", F.lit(""))))
    texts = pages.join(wanted.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "page_number", normalized("content").alias("folded"))
    asked = wanted.where(F.length("needle") >= LEAST_QUOTE).select("citation_id", "document_id", "page", "needle")
    if index is None:
        hits = asked.join(texts, "document_id").where(F.contains("folded", F.col("needle")))
    else:
        hits = asked.join(index.found(asked.select("needle").distinct()).select("needle", "document_id", "page_number"), ["needle", "document_id"])
    hits = hits.groupBy("citation_id").agg(F.max(F.col("page_number") == F.col("page")).alias("on_page"), F.min(F.when(F.col("page_number") != F.col("page"), F.col("page_number"))).alias("elsewhere"))
    rows = wanted.join(title, "document_id", "left").join(last, "document_id", "left").join(hits, "citation_id", "left")
    verdict = (
        F.when(F.col("title").isNull(), "invalidSource")
        .when(F.col("last_page").isNull(), "noTextAvailable")
        .when(~F.col("page").between(1, F.col("last_page")), "pageOutOfRange")
        .when((F.length("needle") < LEAST_QUOTE) | F.coalesce("on_page", F.lit(False)), "valid")
        .when(F.col("elsewhere").isNotNull(), "foundElsewhere")
        .otherwise("quoteNotFound")
    )
    at = F.when(verdict == "foundElsewhere", F.col("elsewhere")).when(verdict == "pageOutOfRange", F.col("last_page"))
    return rows.withColumns({"verdict": verdict, "at_page": at}).select(*citations.columns, "verdict", "title", "at_page")


def is_failure(verdict: Column) -> Column:
    return ~verdict.isin("valid", "noTextAvailable")


def feedback_line() -> Column:
    """A tagged line on a failed citation; null for the others."""
    title = F.col("title")
    return (
        F.when(F.col("verdict") == "invalidSource", F.concat(F.lit("- [unknown_source] no document "), F.col("document_id").cast("string")))
        .when(F.col("verdict") == "pageOutOfRange", F.concat(F.lit("- [page_out_of_range] « "), title, F.lit(" » has "), F.col("at_page").cast("string"), F.lit(" pages, not "), F.col("page").cast("string")))
        .when(F.col("verdict") == "quoteNotFound", F.concat(F.lit("- [quote_not_found] « "), F.coalesce("quote", F.lit("")), F.lit(" » isn't in « "), title, F.lit(" »")))
        .when(F.col("verdict") == "foundElsewhere", F.concat(F.lit("- [wrong_page] « "), title, F.lit(" »: page "), F.col("at_page").cast("string"), F.lit(", not "), F.col("page").cast("string")))
    )


def feedback(checked: DataFrame, message: str = "message_id") -> DataFrame:
    """(message, feedback): the lines of each message in order of its markers."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", feedback_line().alias("line")))), lambda x: x["line"]), "\n")
    return checked.where(is_failure(F.col("verdict"))).groupBy(message).agg(lines.alias("feedback"))


def rendered(messages: DataFrame, checked: DataFrame, message: str = "message_id", text: str = "text") -> DataFrame:
    """Messages with each marker in words: (« title », p. N)."""
    shown = F.concat(F.lit("(« "), F.coalesce("title", F.lit("unknown document")), F.lit(" », p. "), F.col("page").cast("string"), F.lit(")"))
    marks = checked.groupBy(message).agg(F.array_sort(F.collect_list(F.struct("n", "raw", shown.alias("shown")))).alias("marks"))
    out = F.aggregate(F.coalesce("marks", F.array().cast("array<struct<n:int,raw:string,shown:string>>")), F.col(text), lambda t, m: F.replace(t, m["raw"], m["shown"]))
    return messages.join(marks, message, "left").withColumn(text, out).drop("marks")


#: Words of a quote that make a key, and characters where it has too few words.
KEY_WORDS, KEY_CHARS = 3, 3


def locate_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, document_id, page_number) of every page that contains a quote, whatever the document.

    quotes: (quote_id, quote); pages: (document_id, page_number, content). A
    quote's second to fourth words are a key that its pages have too (the first
    may be cut on the page). A quote with fewer words has its rarest run of
    KEY_CHARS characters as a key. Keys and page numbers are joined, on equal keys; texts
    are fetched for the pages that come out of it.
    """
    at, grams = ("document_id", "page_number"), "transform(sequence(1, greatest(size(w) - {0} + 1, 1)), i -> xxhash64(array_join(slice(w, i, {0}), ' ')))".format(KEY_WORDS)
    q = quotes.select("quote_id", normalized("quote").alias("needle")).where("needle != ''").withColumn("w", F.split("needle", " "))
    p = pages.select(*at, normalized("content").alias("folded"))
    whole = q.where(F.size("w") >= KEY_WORDS + 2).select("quote_id", F.xxhash64(F.array_join(F.slice("w", 2, KEY_WORDS), " ")).alias("gram"))
    keyed = p.withColumn("w", F.split("folded", " ")).select(*at, F.explode(F.array_distinct(F.expr(grams))).alias("gram"))
    found = keyed.join(whole, "gram").select("quote_id", *at)

    short = q.where(F.size("w") < KEY_WORDS + 2).select("quote_id", "needle")
    if not short.isEmpty():  # a look at the quotes alone
        found = found.unionByName(_short_located(short, p))
    there = found.distinct().join(pages.select(*at, "content"), list(at)).join(q.select("quote_id", "needle"), "quote_id")
    return there.where(F.contains(normalized("content"), F.col("needle"))).select("quote_id", *at)


def _short_located(short: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, document_id, page_number) of the pages that have a rare run of characters of a quote: short (quote_id, needle), pages with folded."""
    at = ("document_id", "page_number")
    of_size = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    asked = short.where(F.length("needle") >= KEY_CHARS).select("quote_id", F.explode(of_size(F.col("needle"), KEY_CHARS)).alias("run"))
    tiny = short.where(F.length("needle") < KEY_CHARS).select("quote_id", F.col("needle").alias("run"))
    # Only runs that a quote asks for are counted and joined; those of one or two characters are looked for as such.
    parts = F.array_distinct(F.concat(*[of_size(F.col("folded"), n) for n in range(1, KEY_CHARS + 1)]))
    wanted = asked.select("run").union(tiny.select("run")).distinct()
    held = pages.where("folded != ''").select(*at, F.explode(parts).alias("run")).join(wanted, "run", "left_semi")
    often = held.groupBy("run").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "run", "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))
    return held.join(rarest.unionByName(tiny), "run").select("quote_id", *at)


def resolve_annotations(annotations: DataFrame, pages: DataFrame, index: QuoteIndex | None = None) -> DataFrame:
    """annotations with (kind, to_page): found, moved or lost.

    annotations: (annotation_id, document_id, page, quote, prefix, suffix). The
    remembered page comes first; among several others the first that has the
    quote in its context, else the first. An index of the pages must be one of
    texts that fold() gives.
    """
    none = F.lit("")
    wanted = annotations.withColumns({"needle": fold(F.coalesce("quote", none)), "context": fold(F.concat(F.coalesce("prefix", none), F.coalesce("quote", none), F.coalesce("suffix", none)))})
    texts = pages.join(wanted.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "page_number", fold("content").alias("folded"))
    asked = wanted.where("needle != ''").select("annotation_id", "document_id", "page", "needle", "context")
    if index is None:
        hits = asked.join(texts, "document_id").where(F.contains("folded", F.col("needle")))
    else:
        hits = asked.join(index.found(asked.select("needle").distinct()), ["needle", "document_id"])
    number = F.col("page_number")
    hits = hits.groupBy("annotation_id").agg(F.max(F.coalesce(number == F.col("page"), F.lit(False))).alias("still"), F.min(F.when(F.contains("folded", F.col("context")), number)).alias("in_context"), F.min(number).alias("first"))
    rows = annotations.join(hits, "annotation_id", "left")
    target = F.coalesce("in_context", "first")
    kind = F.when(F.col("first").isNull(), "lost").when(F.col("still") | F.col("page").isNull(), "found").otherwise("moved")
    to = F.when(F.col("first").isNull(), F.lit(None)).when(F.col("still"), F.col("page")).otherwise(target)
    return rows.withColumns({"kind": kind, "to_page": to}).select(*annotations.columns, "kind", "to_page")


def new_annotations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Imported annotations not in the catalog yet, by page and folded quote, each once."""
    key = F.concat(F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit("\u0001"), fold("quote"))
    fresh = found.withColumn("_key", key).dropDuplicates(["document_id", "_key"])
    return fresh.join(known.select("document_id", key.alias("_key")), ["document_id", "_key"], "left_anti").drop("_key")
