"""Decoders of bibliographic services' answers, captured as text columns.

Each gives the guess struct of quire.functions.text, or null where an answer has
no title. Nothing here asks a network.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.functions import text as T


def _joined(names: Column) -> Column:
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.nullif(F.array_join(kept, " ; "), F.lit(""))


def _titled(title: Column, made: Column) -> Column:
    return F.when(F.trim(title) != "", made)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def normalized_isbn(x: Column) -> Column:
    """Digits, and an X at the end."""
    return F.upper(F.regexp_replace(x, r"[^0-9Xx]|[Xx](?!$)", ""))


def crossref(payload: Column) -> Column:
    m = F.from_json(payload, "message struct<DOI:string,ISBN:array<string>,title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,publisher:string,language:string>")["message"]
    title = F.get(F.filter(m["title"], lambda t: F.trim(t) != ""), F.lit(0))
    names = F.transform(m["author"], lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    isbn = F.get(F.filter(F.transform(m["ISBN"], T.isbn13), lambda x: x.isNotNull()), F.lit(0))
    year = F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0)).cast("string")
    return _titled(title, T.guess(title, _joined(names), year, isbn, publisher=m["publisher"], language=m["language"], doi=m["DOI"]))


def open_library(payload: Column, isbn: Column) -> Column:
    isbn = normalized_isbn(isbn)
    books = F.from_json(payload, "map<string,struct<title:string,authors:array<struct<name:string>>,publish_date:string,publishers:array<struct<name:string>>,identifiers:struct<isbn_13:array<string>>>>")
    b = F.coalesce(F.try_element_at(books, F.concat(F.lit("ISBN:"), isbn)), F.get(F.map_values(books), F.lit(0)))
    listed = F.get(F.filter(F.transform(b["identifiers"]["isbn_13"], _digits), lambda x: F.length(x) == 13), F.lit(0))
    own = F.when(F.length(_digits(isbn)) == 13, isbn).otherwise(listed)
    return _titled(b["title"], T.guess(b["title"], _joined(F.transform(b["authors"], lambda a: a["name"])), T.year(b["publish_date"]), own, publisher=F.get(b["publishers"], F.lit(0))["name"]))


def google_books(payload: Column, isbn: Column) -> Column:
    root = F.from_json(payload, "totalItems int, items array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string,publishedDate:string,language:string,industryIdentifiers:array<struct<type:string,identifier:string>>>>>")
    v = F.get(root["items"], F.lit(0))["volumeInfo"]
    listed = F.get(F.filter(v["industryIdentifiers"], lambda i: i["type"] == "ISBN_13"), F.lit(0))["identifier"]
    own = F.when(F.length(_digits(isbn)) == 13, isbn).otherwise(listed)
    made = T.guess(v["title"], _joined(v["authors"]), T.year(v["publishedDate"]), own, publisher=v["publisher"], language=v["language"])
    return F.when(F.coalesce(root["totalItems"], F.lit(1)) != 0, _titled(v["title"], made))


#: Elements of a Dublin Core record that are read.
ELEMENTS = ("title", "creator", "date", "publisher", "language")
_RECORD = StructType([StructField(n, ArrayType(StringType())) for n in (*ELEMENTS, "numberOfRecords")])


def _texts(xml: str) -> dict[str, list[str]] | None:
    """The text nodes of ELEMENTS in the first record and of numberOfRecords anywhere, prefixes aside; None for what isn't XML."""
    out: dict[str, list[str]] = {n: [] for n in _RECORD.names}
    path: list[str] = []
    text: list[str] = []
    record = 0  # its depth; -1 once it is over

    def close() -> None:
        if text and path and path[-1] in out and (path[-1] == "numberOfRecords" or 0 < record < len(path)):
            out[path[-1]].append("".join(text))
        text.clear()

    def start(name: str, _: dict[str, str]) -> None:
        nonlocal record
        close()
        path.append(name.rpartition(":")[2])
        if path[-1] == "record" and not record:
            record = len(path)

    def end(_: str) -> None:
        nonlocal record
        close()
        record = -1 if len(path) == record else record
        path.pop()

    parser = expat.ParserCreate()  # names as they stand: a prefix may be undeclared
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: close()
    try:
        parser.Parse(xml.strip(), True)
    except (expat.ExpatError, UnicodeError):
        return None
    return out


@F.arrow_udf(_RECORD)
def _record(payloads: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _texts(x) for x in payloads.to_pylist()], pa.struct([(n, pa.list_(pa.string())) for n in _RECORD.names]))


def library_record(payload: Column, isbn: Column) -> Column:
    """The first Dublin Core record of an SRU answer in XML, which is parsed once; null for what isn't XML."""
    record = _record(payload)
    at = lambda name: F.filter(F.transform(record[name], T.strip), lambda x: x != "")
    first = lambda name: F.get(at(name), F.lit(0))
    title = first("title")
    own = F.when(F.length(_digits(isbn)) == 13, isbn)
    made = T.guess(title, _joined(F.transform(at("creator"), T.natural_name)), T.year(first("date")), own, publisher=first("publisher"), language=first("language"))
    none = F.get(record["numberOfRecords"], F.lit(0)) == "0"
    return F.when(~F.coalesce(none, F.lit(False)), _titled(title, made))
