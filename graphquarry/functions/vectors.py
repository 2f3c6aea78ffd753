"""Vector distances as columns, and the stored encodings of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str, strict: bool) -> Column:
    """Distance in double precision, summed in order.

    With ``strict`` a zero vector's cosine is an error; without, it is 2.
    """
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    zero = F.raise_error(F.lit("the cosine of a zero vector is not defined")).cast("double") if strict else F.lit(2.0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(norm == 0.0, zero).otherwise(F.lit(1.0) - _dot(a, b) / F.when(norm == 0.0, F.lit(1.0)).otherwise(norm))


def quantised(values: list[float], encoding: str | None) -> list[float]:
    """What a vector reads back as after it is stored in an encoding."""
    v = np.array(values, np.float32)
    if encoding == "f16":
        with np.errstate(over="ignore"):  # too large ones are infinite
            v = v.astype(np.float16).astype(np.float32)
    elif encoding == "i8":
        scale = np.float32(np.abs(v).max(initial=0.0) / 127)
        v = np.round(v / scale).clip(-127, 127).astype(np.float32) * scale if scale else v
    elif encoding == "b1":
        v = np.where(v >= 0, np.float32(1), np.float32(-1))
    return [float(x) for x in v]


def _half(x: Column) -> Column:
    """The nearest half-precision number, ties to even, as a double."""
    a = F.abs(x)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0))))
    exponent = guess - F.when(F.pow(F.lit(2.0), guess) > a, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0)
    unit = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14)) - 10)
    return F.when(a >= 65520.0, F.signum(x) * F.lit(float("inf"))).otherwise(F.rint(x / unit) * unit)


def quantised_column(c: Column, encoding: str | None) -> Column:
    """``quantised`` of every row of a vector column."""
    if encoding == "f16":
        return F.transform(c, lambda x: _half(x.cast("double")).cast("float"))
    if encoding == "i8":
        scale = (F.coalesce(F.array_max(F.transform(c, F.abs)), F.lit(0.0)).cast("double") / 127).cast("float").cast("double")
        steps = F.transform(c, lambda x: (F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint((x.cast("double") / scale).cast("float").cast("double")))) * scale).cast("float"))
        return F.when(scale > 0, steps).otherwise(c)
    if encoding == "b1":
        return F.transform(c, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0).cast("float"))
    return c
