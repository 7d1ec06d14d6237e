"""Citation formats of catalog records, as Column expressions.

A record has title, authors (array of names, the last word of a name being the
family), year, publisher, isbn13 and doi; blank fields count as absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import blank_to_null, key_fold


def _names() -> Column:
    return F.filter(F.coalesce(F.col("authors"), F.array().cast("array<string>")), lambda n: F.trim(n) != "")


def family(name: Column) -> Column:
    return F.element_at(F.split(F.trim(F.regexp_replace(name, " +", " ")), " "), -1)


def given(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(name, " +", " "))
    return F.trim(F.regexp_replace(clean, r"[^ ]+$", ""))


def _inverted(name: Column, upper: bool = False) -> Column:
    last = F.upper(family(name)) if upper else family(name)
    return F.when(given(name) == "", last).otherwise(F.concat(last, F.lit(", "), given(name)))


def chicago() -> Column:
    """Author-date: the first author inverted, `, and` before the last."""
    names = _names()
    n = F.size(names)
    parts = F.concat(F.array(_inverted(F.get(names, F.lit(0)))), F.slice(names, 2, F.greatest(n - 1, F.lit(0))))
    joined = F.when(n == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(parts, -1)))
    who = F.when(n > 0, F.concat(joined, F.lit(". "))).otherwise("")
    publisher = blank_to_null("publisher")
    return F.concat(who, F.coalesce(F.when(blank_to_null("year").isNotNull(), F.col("year")), F.lit("s. d.")), F.lit(". "), F.col("title"), F.lit("."), F.when(publisher.isNotNull(), F.concat(F.lit(" "), F.col("publisher"), F.lit("."))).otherwise(""))


def iso690() -> Column:
    """Families in capitals, names joined by ` ; `."""
    names = _names()
    who = F.when(F.size(names) > 0, F.concat(F.array_join(F.transform(names, lambda n: _inverted(n, upper=True)), " ; "), F.lit(". "))).otherwise("")
    kept = lambda c: F.when(blank_to_null(c).isNotNull(), F.col(c))
    issue = F.concat_ws(", ", kept("publisher"), kept("year"))
    return F.concat(who, F.col("title"), F.lit("."), F.when(issue != "", F.concat(F.lit(" "), issue, F.lit("."))).otherwise(""), *[F.when(kept(c).isNotNull(), F.concat(F.lit(f" {label} "), F.col(c), F.lit("."))).otherwise("") for c, label in (("isbn13", "ISBN"), ("doi", "DOI"))])


def record_key() -> Column:
    """Folded family of the first author, or first word of the title, and year or `sd`."""
    names = _names()
    who = F.when(F.size(names) > 0, family(F.get(names, F.lit(0)))).otherwise(F.get(F.split(F.trim("title"), " +"), F.lit(0)))
    return F.concat(F.coalesce(key_fold(who), F.lit("")), F.coalesce(key_fold(blank_to_null("year")), F.lit("sd")))


def bibtex() -> Column:
    names = _names()
    escaped = lambda x: F.replace(F.replace(x, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    kept = lambda c: F.when(blank_to_null(c).isNotNull(), F.col(c))
    fields = {"author": F.when(F.size(names) > 0, F.array_join(names, " and ")), "title": F.col("title"), "year": kept("year"), "publisher": kept("publisher"), "isbn": kept("isbn13"), "doi": kept("doi")}
    lines = F.array_join(F.filter(F.array(*[F.concat(F.lit(f"  {k} = {{"), escaped(v), F.lit("}")) for k, v in fields.items()]), lambda x: x.isNotNull()), ",\n")
    return F.concat(F.lit("@book{"), record_key(), F.lit(",\n"), lines, F.lit("\n}"))


def csl_item() -> Column:
    """A CSL-JSON item; absent fields are left out."""
    names = _names()
    kept = lambda c: F.when(blank_to_null(c).isNotNull(), F.col(c))
    number = F.when(F.col("year").rlike(r"^[+-]?\d+$"), F.col("year").try_cast("int"))
    return F.to_json(
        F.struct(
            kept("doi").alias("DOI"),
            kept("isbn13").alias("ISBN"),
            F.when(F.size(names) > 0, F.transform(names, lambda n: F.struct(family(n).alias("family"), F.nullif(given(n), F.lit("")).alias("given")))).alias("author"),
            record_key().alias("id"),
            F.when(number.isNotNull(), F.struct(F.array(F.array(number)).alias("date-parts"))).alias("issued"),
            kept("publisher").alias("publisher"),
            F.col("title").alias("title"),
            F.lit("book").alias("type"),
        )
    )


def write_bibtex(records: DataFrame, path: str) -> None:
    """Entries with an empty line between, as text files."""
    records.select(F.concat(bibtex(), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_csl(records: DataFrame, path: str, files: int = 1) -> None:
    """An array of items in each of at most so many files, with a line for each item."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            lines = []
            for item in b.column(0).to_pylist():
                lines.append(before + item)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], names=["value"])

    records.select(csl_item().alias("value")).coalesce(files).mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)
