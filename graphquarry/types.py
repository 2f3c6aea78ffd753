"""Logical types, name folding and suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from graphquarry.errors import InvalidArgument

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(name: str) -> str:
    """ASCII letters in lower case; everything else as it is."""
    return name.translate(_UPPER)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(name: str, known) -> str:
    """`` (did you mean "x"?)`` for a near miss, else nothing."""
    budget = 1 if len(name) <= 4 else 2 if len(name) <= 8 else 3
    near = sorted((d, k) for k in known if (d := _distance(fold(name), fold(k))) <= budget)
    return f' (did you mean "{near[0][1]}"?)' if near else ""


@dataclass(frozen=True)
class Type:
    """A logical type; ``a`` and ``b`` are precision and scale, or a vector's size."""

    kind: str
    a: int | None = None
    b: int | None = None
    encoding: str | None = None

    def __str__(self) -> str:
        if self.kind == "Vector":
            return f"Vector({self.a}{', ' + self.encoding if self.encoding else ''})"
        return f"Decimal({self.a},{self.b})" if self.kind == "Decimal" else self.kind

    @property
    def numeric(self) -> bool:
        return self.kind in ("Int64", "Float64", "Decimal")

    @property
    def ordered(self) -> bool:
        return self.kind in ("Bool", "Int64", "Float64", "String", "Timestamp", "Decimal", "Null")

    def spark(self) -> T.DataType:
        if self.kind == "Vector":
            return T.ArrayType(T.FloatType())
        if self.kind == "Decimal":
            return T.DecimalType(self.a, self.b)
        if self.kind == "GeoPoint":
            return T.StructType([T.StructField("lat_deg", T.DoubleType()), T.StructField("lng_deg", T.DoubleType())])
        return {"Bool": T.BooleanType(), "Int64": T.LongType(), "Float64": T.DoubleType(), "String": T.StringType(), "Timestamp": T.TimestampNTZType(), "Bytes": T.BinaryType(), "Json": T.StringType(), "Null": T.NullType()}[self.kind]


NULL, BOOL, INT64, FLOAT64, STRING = (Type(k) for k in ("Null", "Bool", "Int64", "Float64", "String"))
TIMESTAMP, BYTES, JSON, GEOPOINT = (Type(k) for k in ("Timestamp", "Bytes", "Json", "GeoPoint"))


def decimal(p: int, s: int) -> Type:
    if not (1 <= p <= 38 and 0 <= s <= p):
        raise InvalidArgument(f"Decimal({p},{s}) is not a type: 1 <= p <= 38 and s <= p")
    return Type("Decimal", p, s)


def vector(dim: int, encoding: str | None = None) -> Type:
    if dim < 1:
        raise InvalidArgument("a vector has at least one element")
    if encoding not in (None, "f32", "f16", "i8", "b1"):
        raise InvalidArgument(f"unknown vector encoding {encoding}")
    return Type("Vector", dim, None, None if encoding == "f32" else encoding)


def parse_type(text: str) -> Type:
    m = re.fullmatch(r"(\w+)(?:\(\s*(\d+)\s*(?:,\s*(\w+)\s*)?\))?", text.strip())
    if m:
        kind, a, b = m.groups()
        if kind == "Vector" and a:
            return vector(int(a), b)
        if kind == "Decimal" and a and b and b.isdigit():
            return decimal(int(a), int(b))
        if a is None and kind in ("Bool", "Int64", "Float64", "String", "Timestamp", "Bytes", "Json", "GeoPoint"):
            return Type(kind)
    raise InvalidArgument(f"unknown type {text}")


def from_spark(t: T.DataType) -> Type:
    """The logical type that a Spark column loads as."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT64
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return FLOAT64
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return TIMESTAMP
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return Type("Vector", None)
    raise InvalidArgument(f"no logical type for {t.simpleString()}")
