"""File trees and the texts and metadata of books.

Files are listed and read with Spark's binaryFile source, so any store that
Spark knows works. Hashes are taken in blocks, so a file of any size has one,
where its store can be opened from Python; elsewhere the source reads whole
files. Formats that need parsing are read in Arrow batches, a file a row. What
parses PDF files is the caller's: any object with the methods of PdfReader.
"""

from __future__ import annotations

import hashlib
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any, Protocol
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions import text as T
from quire.operators import ingest

from .schemas import VALUES

EPUB_LONG = 8_000
#: Characters a page of a PDF has on average at least, unless it is a scan.
SCANNED = 50
HIDDEN = r"(^|/)(\.|[^/]*\.sdr/)"


#: Bytes of a file that are hashed at once, and the stores whose files Python can open.
HASHED, OPENED = 4 << 20, ("file", "hdfs", "s3", "gs")


def scan(spark: SparkSession, folder: str, hashes: bool = True) -> DataFrame:
    """(path, relative_folder, file_name, format, file_size, supported[, content_hash]) of the files below a folder.

    Hidden files and folders and *.sdr folders are left out, and empty files, as
    the source leaves them out. Without hashes the contents aren't read. A file
    that can't be read has a null hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    below = F.substring(path, F.lit(len(root) + 2), F.length(path))
    rows = files.withColumns({"_p": path, "_r": below}).where(~F.col("_r").rlike(HIDDEN))
    name = F.element_at(F.split("_r", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = [F.col("_p").alias("path"), F.regexp_replace("_r", "/?[^/]*$", "").alias("relative_folder"), name.alias("file_name"), ext.alias("format"), F.col("length").alias("file_size"), ext.isin(*VALUES["format"]).alias("supported")]
    if not hashes:
        return rows.select(*out)
    scheme = folder.split("://")[0] if "://" in folder else spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()
    if scheme not in OPENED:
        return rows.select(*out, F.sha2("content", 256).alias("content_hash"))
    listed = rows.select(*out, F.col("path").alias("_uri")).repartition(spark.sparkContext.defaultParallelism)  # names only
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields[:-1])
    return listed.mapInArrow(_hashed, f"{shape}, content_hash string")


def content_hash(uri: str) -> str | None:
    """The SHA-256 of a file, read in blocks; None where it can't be read."""
    digest = hashlib.sha256()
    try:
        local = uri.partition("file:")[2] if uri.startswith("file:") else None
        where, path = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local is not None else fs.FileSystem.from_uri(quote(uri, safe=":/@"))
        with where.open_input_stream(path, compression=None) as f:
            while block := f.read(HASHED):
                digest.update(block)
    except (OSError, pa.ArrowException):
        return None
    return digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([content_hash(u) for u in b.column("_uri").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*b.schema.names[:-1], "content_hash"])


def plain_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, content) of text files (path, content binary): UTF-8, or Latin-1 where that fails."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", F.posexplode(T.paginate(text)).alias("n", "content")).select("path", (F.col("n") + 1).alias("page_number"), "content")


def pdf_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and scan flags from extracted page texts (path, page_number, content).

    Texts are trimmed and empty pages dropped, numbers kept. A document with less
    than SCANNED characters a page has no pages and needs recognition: (path,
    needs_ocr).
    """
    counts = pages.groupBy("path").agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("n"))
    scans = counts.select("path", (F.floor(F.col("chars") / F.col("n")) < SCANNED).alias("needs_ocr"))
    kept = pages.withColumn("content", T.strip("content")).where("content != ''").join(scans.where("needs_ocr"), "path", "left_anti")
    return kept, scans


class PdfReader(Protocol):
    """Parses PDF files; one instance serves all tasks of a worker, so it must pickle. Any exception means an unreadable file."""

    def pages(self, content: bytes) -> list[str]:
        """The text of each page."""

    def info(self, content: bytes) -> dict[str, str | None]:
        """title and author as the file states them."""

    def annotations(self, content: bytes) -> list[dict[str, Any]]:
        """page (from 1), type, quote and note of each annotation."""


def _parsed(files: DataFrame, parse, shape: str, kind: pa.DataType) -> DataFrame:
    """(path, failed, found array of shape) of files (path, content); failed where parse raised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found, failed = parse(content), False
                except Exception:  # whatever a parser raises; the others go on
                    found, failed = [], True
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([failed]), pa.array([found], pa.list_(kind))], names=["path", "failed", "found"])

    return files.select("path", "content").mapInArrow(run, f"path string, failed boolean, found array<{shape}>")


def read_pdf_pages(files: DataFrame, reader: PdfReader) -> DataFrame:
    """(path, failed, found): the page texts of PDF files (path, content), for pdf_pages() once exploded."""
    return _parsed(files, reader.pages, "string", pa.string())


def read_pdf_info(files: DataFrame, reader: PdfReader) -> DataFrame:
    """(path, title, author, pages) of PDF files, for pdf_guess(); unreadable ones are left out."""
    kind = pa.struct([("title", pa.string()), ("author", pa.string()), ("pages", pa.list_(pa.string()))])
    parse = lambda c: [{"title": None, "author": None} | reader.info(c) | {"pages": reader.pages(c)[:8]}]
    return _parsed(files, parse, "struct<title:string,author:string,pages:array<string>>", kind).where("NOT failed").select("path", F.inline("found"))


# The types of annotations that are taken over.
MARKUP = ("Highlight", "Underline", "StrikeOut", "Text", "FreeText")


def read_pdf_annotations(files: DataFrame, reader: PdfReader) -> DataFrame:
    """(path, page, quote, prefix, suffix, note) of the markup in PDF files; one without a quote is left out, context is what stands around the quote on its page."""
    kind = pa.struct([("page", pa.int32()), ("type", pa.string()), ("quote", pa.string()), ("note", pa.string()), ("text", pa.string())])

    def parse(content: bytes) -> list[dict[str, Any]]:
        pages = reader.pages(content)
        return [{"note": None} | a | {"text": pages[a["page"] - 1] if 0 < a["page"] <= len(pages) else ""} for a in reader.annotations(content)]

    rows = _parsed(files, parse, "struct<page:int,type:string,quote:string,note:string,text:string>", kind).select("path", F.inline("found"))
    rows = rows.withColumn("quote", T.collapse("quote")).where(F.col("type").isin(*MARKUP) & (F.col("quote") != ""))
    around = rows.withColumn("c", T.quote_context("quote", "text"))
    return around.select("path", "page", "quote", "c.prefix", "c.suffix", T.blank_to_null("note").alias("note"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e.tag) == name]


#: What reading a damaged, truncated or encrypted archive, or one packed in an unknown way, raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, KeyError, EOFError, OSError, RuntimeError, NotImplementedError, ValueError, OverflowError, struct.error)


def _package(z: zipfile.ZipFile) -> tuple[ElementTree.Element, str] | None:
    """The package document of an EPUB and its folder."""
    try:
        where = _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].get("full-path", "")
        return ElementTree.fromstring(z.read(where)), where.rpartition("/")[0]
    except (*UNREADABLE, IndexError, ElementTree.ParseError):
        return None


def xhtml_text(raw: bytes) -> str:
    """Text of a page's body, or of its root; where it isn't XML, what is left without tags."""
    import html
    import re

    try:
        root = ElementTree.fromstring(raw)
        top = next((e for e in root.iter() if _local(e.tag) == "body"), root)
        return " ".join(" ".join(top.itertext()).split())
    except ElementTree.ParseError:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", text)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", text)).split())


def epub_items(content: bytes) -> list[str] | None:
    """Texts of the reading order's items that can be read; None for what isn't an EPUB with text."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except UNREADABLE:
        return None
    found = _package(z)
    if found is None:
        return None
    package, folder = found
    href = {e.get("id"): e.get("href") for m in _all(package, "manifest") for e in _all(m, "item")}
    out = []
    for ref in (e for s in _all(package, "spine") for e in _all(s, "itemref")):
        target = href.get(ref.get("idref"))
        if target is None:
            continue
        path = unquote((f"{folder}/" if folder else "") + target.split("#")[0])
        try:
            text = xhtml_text(z.read(path))
        except UNREADABLE:
            continue
        if text:
            out.append(text)
    return out or None


def epub_metadata(content: bytes) -> dict[str, str | list[str] | None] | None:
    """Raw title, creator, date, publisher, language and identifiers."""
    try:
        found = _package(zipfile.ZipFile(io.BytesIO(content)))
    except UNREADABLE:
        return None
    if found is None:
        return None
    first = lambda name: next(("".join(e.itertext()).strip() for e in _all(found[0], name)), None)
    return {n: first(n) for n in ("title", "creator", "date", "publisher", "language")} | {"identifiers": ["".join(e.itertext()) for e in _all(found[0], "identifier")]}


def epub_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, content): an item is a page, a long one several; numbers run through the book."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, t in enumerate(epub_items(c) or ())]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["path", "item", "text"])

    items = files.select("path", "content").mapInArrow(read, "path string, item int, text string")
    pages = F.when(F.length("text") > EPUB_LONG, T.paginate("text")).otherwise(F.array("text"))
    cut = items.select("path", "item", F.posexplode(pages).alias("piece", "content"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("item", "piece"))
    return cut.select("path", number.alias("page_number"), "content")


def epub_guess(files: DataFrame) -> DataFrame:
    """(path, guess) of EPUB files; null where nothing is usable."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, pa.string()) for n in ("title", "creator", "date", "publisher", "language")] + [("identifiers", pa.list_(pa.string()))])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([epub_metadata(c) for c in b.column(1).to_pylist()], kind)], names=["path", "m"])

    raw = files.select("path", "content").mapInArrow(read, "path string, m struct<title:string,creator:string,date:string,publisher:string,language:string,identifiers:array<string>>")
    title, author = T.sane_title("m.title"), T.sane_author("m.creator")
    isbn = F.get(F.filter(F.transform("m.identifiers", T.isbn13), lambda x: x.isNotNull()), F.lit(0))
    made = T.guess(F.coalesce(title, F.lit("")), author, T.year("m.date"), isbn, publisher=F.nullif(F.col("m.publisher"), F.lit("")), language=F.lower(F.substring("m.language", 1, 2)))
    return raw.select("path", F.when(F.coalesce(title, author, isbn).isNotNull(), made).alias("guess"))


def pdf_guess(info: DataFrame) -> DataFrame:
    """(path, guess) from a PDF's fields (path, title, author, pages array of the first page texts)."""
    title, author = T.sane_title("title"), T.sane_author("author")
    found = lambda fn: F.get(F.filter(F.transform(F.slice("pages", 1, 8), fn), lambda x: x.isNotNull()), F.lit(0))
    isbn, doi = found(T.isbn13), found(T.doi)
    return info.select("path", F.when(F.coalesce(title, author, isbn, doi).isNotNull(), T.guess(F.coalesce(title, F.lit("")), author, isbn13=isbn, doi=doi)).alias("guess"))


def best_guess(file_name, embedded):
    """The guess of a file: its name's if that is structured, else the embedded one; without a title there, the name's title, still in doubt."""
    own = T.parse_file_name(file_name)
    named = T.guess(own["title"], embedded["author"], embedded["year"], embedded["isbn13"], "fallback", embedded["publisher"], embedded["language"], embedded["doi"])
    return F.when((own["confidence"] == "structured") | embedded.isNull(), own).when(embedded["title"] == "", named).otherwise(embedded)


def repropose(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """(path, guess) of files (path, file_name, format, content): the name's guess, or what the file itself says. Nothing is written."""
    found = epub_guess(files.where("format = 'epub'"))
    if pdf is not None:
        found = found.unionByName(pdf_guess(read_pdf_info(files.where("format = 'pdf'"), pdf)))
    both = files.select("path", "file_name").join(found.withColumnRenamed("guess", "embedded"), "path", "left")
    return both.select("path", best_guess(F.col("file_name"), F.col("embedded")).alias("guess"))


def extract(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """(path, page_number, content) by format (path, format, content); formats without a reader have no pages."""
    pages = plain_pages(files.where(F.col("format").isin("txt", "md"))).unionByName(epub_pages(files.where(F.col("format") == "epub")))
    if pdf is None:
        return pages
    read = read_pdf_pages(files.where(F.col("format") == "pdf"), pdf).select("path", F.posexplode("found").alias("n", "content"))
    return pages.unionByName(pdf_pages(read.select("path", (F.col("n") + 1).alias("page_number"), "content"))[0])


def extract_pending(document: DataFrame, files: DataFrame, pdf: PdfReader | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcome, pages) of the documents that wait for extraction, whose files are (path, content).

    outcome: (document_id, is_extracted, needs_ocr, failed), a row for each of
    them: one that a PDF reader can't read, or whose file isn't there, has failed
    and stays pending, and the others don't notice. A book or text without
    readable pages is treated and has none. pages: (document_id, page_number,
    content), to put in place by ingest.replace_pages, with those of outcome that
    are extracted as treated.
    """
    waiting = ingest.pending_documents(document).select("document_id", "format", F.col("file_path").alias("path"))
    own = waiting.join(files, "path", "left")
    there = own.where("content is not null")
    scans = failed = None
    if pdf is not None:
        read = read_pdf_pages(there.where("format = 'pdf'"), pdf)
        failed = read.where("failed").select("path", F.lit(True).alias("_failed"))
        pages_read = read.select("path", F.posexplode("found").alias("n", "content")).select("path", (F.col("n") + 1).alias("page_number"), "content")
        scans = pdf_pages(pages_read)[1].withColumnRenamed("needs_ocr", "_ocr")
    outcome = own.select("document_id", "path", "format", F.col("content").isNull().alias("_absent"))
    outcome = outcome.join(failed, "path", "left") if failed is not None else outcome.withColumn("_failed", F.col("format") == "pdf")
    outcome = outcome.join(scans, "path", "left") if scans is not None else outcome.withColumn("_ocr", F.lit(False))
    bad = F.col("_absent") | F.coalesce("_failed", F.lit(False))
    outcome = outcome.select("document_id", (~bad).alias("is_extracted"), F.coalesce("_ocr", F.lit(False)).alias("needs_ocr"), bad.alias("failed"))
    pages = extract(there, pdf).join(waiting.select("path", "document_id"), "path").select("document_id", "page_number", "content")
    return outcome, pages
