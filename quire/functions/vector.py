"""Vector functions as Column expressions: everything but the printing of floats stays in the JVM.

Float vectors are arrays of float or double, int8 vectors arrays of tinyint,
bit vectors binary values with the lowest bit of each byte first. Sums are
taken in double precision. Vectors of unequal or no length are errors, as in
any vector store; null gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Up to so many dimensions a distance to a given vector is one flat expression, compiled as a whole.
UNROLLED = 256
METRICS = ("l2", "l1", "cosine")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _checked(a: Column, b: Column, value: Column) -> Column:
    wrong = (F.size(a) != F.size(b)) | (F.size(a) == 0)
    return F.when(wrong, F.raise_error(F.lit("vectors must have one length, above zero")).cast("double")).otherwise(value)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: fn(x.cast("double"), y.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, _sum(_pairs(a, b, lambda x, y: x * y)))


def norm(v: Column | str) -> Column:
    v = _col(v)
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))))


def l1(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, _sum(_pairs(a, b, lambda x, y: F.abs(x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity; NaN where a vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / size) + 0.0


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return {"l2": l2, "l1": l1, "cosine": cosine}[metric](a, b)


def distance_to(metric: str, v: Column | str, query: Sequence[float]) -> Column:
    """Distance to a given vector. Short ones unroll into plain arithmetic, which whole-stage code generation compiles; arrays would be interpreted."""
    v, n = _col(v), len(query)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if not n:
        raise ValueError("vectors must have one length, above zero")
    if n > UNROLLED:
        return distance(metric, v, F.array(*[F.lit(float(x)) for x in query]))
    at = [F.get(v, F.lit(i)).cast("double") for i in range(n)]
    total = lambda terms: _balanced(list(terms))
    if metric == "l2":
        value = F.sqrt(total((x - float(q)) * (x - float(q)) for x, q in zip(at, query, strict=True)))
    elif metric == "l1":
        value = total(F.abs(x - float(q)) for x, q in zip(at, query, strict=True))
    else:
        own = sum(float(q) ** 2 for q in query) ** 0.5
        size = F.sqrt(total(x * x for x in at)) * own
        value = F.when(size == 0, F.lit(float("nan"))).otherwise(1 - total(x * float(q) for x, q in zip(at, query, strict=True)) / size) + 0.0
    return F.when(F.size(v) != n, F.raise_error(F.lit("vectors must have one length, above zero")).cast("double")).otherwise(value)


def _balanced(terms: list[Column]) -> Column:
    """The sum as a shallow tree: deep chains overrun the analyzer's stack."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0]


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two bit vectors."""
    a, b = _col(a), _col(b)
    wrong = (F.octet_length(a) != F.octet_length(b)) | (F.octet_length(a) == 0)
    at = lambda x, i: F.conv(F.hex(F.substring(x, i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = F.sequence(F.lit(0), F.floor((F.octet_length(a) - 1) / 8).cast("int"))
    value = F.aggregate(words, F.lit(0), lambda s, i: s + F.bit_count(at(a, i).bitwiseXOR(at(b, i))))
    return F.when(wrong, F.raise_error(F.lit("bit vectors must have one length, above zero")).cast("int")).otherwise(value)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def add_int8(a: Column | str, b: Column | str, sign: int = 1) -> Column:
    """Sum of int8 vectors, wrapping around."""
    return F.zip_with(_col(a), _col(b), lambda x, y: (F.pmod(x.cast("int") + sign * y.cast("int") + 128, F.lit(256)) - 128).cast("tinyint"))


def slice_of(v: Column | str, start: int, end: int) -> Column:
    """Elements from start to before end, counted from 0."""
    if not 0 <= start < end:
        raise ValueError("a slice must have 0 <= start < end")
    v = _col(v)
    return F.when(F.size(v) < end, F.raise_error(F.lit("the slice ends beyond the vector")).cast("array<float>")).otherwise(F.slice(v, start + 1, end - start))


def normalize(v: Column | str) -> Column:
    """The vector divided by its length; NaN throughout for a zero vector."""
    v = _col(v)
    size = norm(v)
    return F.transform(v, lambda x: F.when(size == 0, F.lit(float("nan"))).otherwise(x.cast("double") / size).cast("float"))


def length(v: Column | str) -> Column:
    return F.size(_col(v))


def bit_length_of(v: Column | str) -> Column:
    return F.octet_length(_col(v)) * 8


def type_name(kind: str) -> str:
    """The element type of a column type, as the vector functions name it."""
    return {"array<float>": "float32", "array<double>": "float32", "array<tinyint>": "int8", "binary": "bit"}[kind]


@F.arrow_udf(StringType())
def _printed(vectors: pa.Array) -> pa.Array:
    """Java's formatter rounds the shortest decimal digits half up; this rounds the exact value, ties to even, as C does."""
    number = lambda x: "null" if x is None or x != x else f"{x:.6f}"
    return pa.array([None if v is None else f"[{','.join(map(number, v))}]" for v in vectors.to_pylist()], pa.string())


def to_json(v: Column | str, half_up: bool = False) -> Column:
    """The vector as JSON with six decimals, rounded as printf does or, if half_up, as SQL's round(); NaN becomes null."""
    if not half_up:
        return _printed(_col(v))
    one = lambda x: F.when(F.isnan(x.cast("double")), "null").otherwise(F.format_string("%.6f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(F.transform(_col(v), one), ","), F.lit("]"))


def bits_to_json(v: Column | str) -> Column:
    v = _col(v)
    bit = lambda i: F.shiftright(F.conv(F.hex(F.substring(v, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), 0).bitwiseAND(F.pow(F.lit(2), i % 8).cast("int")) != 0
    return F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(v) * 8 - 1), lambda i: F.when(bit(i), "1").otherwise("0")), ","), F.lit("]"))


def from_json(text: Column | str, kind: str = "float") -> Column:
    """A vector from JSON text: kind float or tinyint."""
    return F.from_json(_col(text), f"array<{kind}>")


def int8(text: Column | str) -> Column:
    """An int8 vector from JSON text; anything but whole numbers from -128 to 127 is an error."""
    v = F.from_json(_col(text), "array<double>")
    wrong = v.isNull() | F.exists(v, lambda x: x.isNull() | ~x.between(-128, 127) | (x != F.floor(x)))
    return F.when(_col(text).isNull(), F.lit(None)).when(wrong, F.raise_error(F.lit("not a vector of int8")).cast("array<tinyint>")).otherwise(F.transform(v, lambda x: x.cast("tinyint")))


def bit(raw: Column | str) -> Column:
    """A bit vector from bytes, at least one."""
    v = _col(raw)
    return F.when(F.octet_length(v) == 0, F.raise_error(F.lit("a vector has one byte at least")).cast("binary")).otherwise(v)


def quantize_int8(v: Column | str) -> Column:
    """Elements of a unit-range vector as int8: truncated steps of 2/255 from -1, clamped; NaN is 127."""

    def one(x: Column) -> Column:
        step = (x.cast("double") + 1.0) / (2.0 / 255.0) - 128.0
        whole = F.when(F.isnan(step), 127.0).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), step)))
        return whole.cast("int").cast("tinyint")

    return F.transform(_col(v), one)


def quantize_binary(v: Column | str) -> Column:
    """A bit vector of which elements are above zero, lowest bit first; the length must be a multiple of 8."""
    v = _col(v)
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, j: s + F.when(F.get(v, i * 8 + j) > 0, F.pow(F.lit(2), j).cast("int")).otherwise(0))
    packed = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 8).cast("int") - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))
    return F.when((F.size(v) % 8 != 0) | (F.size(v) == 0), F.raise_error(F.lit("the length must be a multiple of 8")).cast("binary")).otherwise(packed)


#: Scalar functions for SQL: name, parameters, body. Spark inlines them.
SQL_FUNCTIONS = (
    ("vector_l2", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    ("vector_l1", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
    ("vector_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("vector_length", "a ARRAY<DOUBLE>", "INT", "size(a)"),
    ("vector_add", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x + y)"),
    ("vector_sub", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)"),
)


def register(spark) -> None:
    """Makes the SQL functions known to a session."""
    for name, params, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
