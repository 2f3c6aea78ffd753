"""Typing of expressions and their lowering to Spark columns.

Spark differs from the engine's rules in a few places, and each is corrected
here: comparisons with NaN, Int64 against Float64 (exact), division, Decimal
result types, UTC days, and exact rounded division.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry import types as L
from graphquarry.errors import InvalidArgument
from graphquarry.functions import vectors
from graphquarry.types import BOOL, FLOAT64, INT64, NULL, STRING, TIMESTAMP, Type, fold, suggestion

COMPARISONS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@dataclass
class Scope:
    """What an expression can refer to: ``binding.column`` and hidden values of bindings."""

    columns: dict[str, tuple[str, Type]]
    classes: dict[str, str] = field(default_factory=dict)
    scores: dict[str, str] = field(default_factory=dict)
    outer: "Scope | None" = None
    lower_plan: Callable | None = None
    joined: bool = False  # as an outer scope: its columns stand in the same rows

    def resolve(self, name: str) -> tuple[Column, Type]:
        key, scope, is_outer = fold(name), self, False
        while scope is not None:
            if key in scope.columns:
                physical, kind = scope.columns[key]
                c = F.col(f"`{physical}`")
                return (c.outer() if is_outer else c), kind
            scope, is_outer = scope.outer, is_outer or scope.outer is not None and not scope.outer.joined
        raise InvalidArgument(f"unknown column {name}{suggestion(name, self.columns)}")


def literal_type(v) -> Type:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOL
    if isinstance(v, int):
        return INT64
    if isinstance(v, float):
        return FLOAT64
    if isinstance(v, str):
        return STRING
    if isinstance(v, list):
        return Type("Vector", len(v))
    (kind, body), = v.items()
    if kind == "decimal":
        d = Decimal(body).as_tuple()
        scale = max(0, -d.exponent)
        return L.decimal(max(len(d.digits) + max(0, d.exponent), scale, 1), scale)
    return {"geo": L.GEOPOINT, "timestamp": TIMESTAMP, "bytes": L.BYTES, "json": L.JSON}[kind]


def literal_value(v, kind: Type | None = None):
    """The Python value that stands for a literal in a Spark row of type ``kind``."""
    if isinstance(v, dict):
        (tag, body), = v.items()
        if tag == "geo":
            return (body["lat_deg"], body["lng_deg"])
        if tag == "decimal":
            return Decimal(body)
        if tag == "bytes":
            return base64.b64decode(body)
        if tag == "json":
            return canonical_json(body)
        from datetime import datetime

        return datetime.fromisoformat(body.replace("Z", "")).replace(tzinfo=None)
    if isinstance(v, list):
        return vectors.quantised([float(x) for x in v], kind.encoding if kind else None)
    return v


def canonical_json(text: str) -> str:
    """JSON without spare space; the order of keys stays."""
    return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)


def literal_column(v) -> Column:
    kind = literal_type(v)
    if kind == NULL:
        return F.lit(None)
    if kind.kind == "Vector":
        return F.array(*(F.lit(x).cast("float") for x in v)) if v else F.array().cast("array<float>")
    value = literal_value(v)
    if kind.kind == "GeoPoint":
        return F.struct(F.lit(value[0]).alias("lat_deg"), F.lit(value[1]).alias("lng_deg"))
    if kind == TIMESTAMP:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(kind.spark())


def _same(a: Type, b: Type, what: str) -> Type:
    if a == NULL:
        return b
    if b == NULL or a == b:
        return a
    if a.kind == b.kind == "Decimal" and a.b == b.b:
        return L.decimal(max(a.a, b.a), a.b)
    if a.kind == b.kind == "Vector" and None in (a.a, b.a):
        return a if a.a else b
    raise InvalidArgument(f"{what}: {a} and {b} are not the same type")


def compare(op: str, a: Column, ta: Type, b: Column, tb: Type, plain: bool = False) -> Column:
    """IEEE for floats (NaN is unequal to all), exact between Int64 and Float64."""
    py = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}[op]
    kinds = {ta.kind, tb.kind}
    if kinds == {"Int64", "Float64"}:
        if ta.kind == "Float64":
            flipped = {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}.get(op, op)
            return compare(flipped, b, tb, a, ta)
        whole = F.when((b >= -(2.0**63)) & (b < 2.0**63), b).otherwise(F.lit(0.0)).cast("bigint")
        # -1, 0 or 1 as a stands to b
        sign = (
            F.when(b >= 2.0**63, -1)
            .when(b < -(2.0**63), 1)
            .when(a < whole, -1)
            .when(a > whole, 1)
            .when(b - whole.cast("double") > 0, -1)
            .when(b - whole.cast("double") < 0, 1)
            .otherwise(0)
        )
        out = F.when(F.isnan(b), F.lit(op == "ne")).otherwise(py(sign, F.lit(0)))
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(out)
    if kinds == {"Float64"} and not plain:
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(F.isnan(a) | F.isnan(b), F.lit(op == "ne")).otherwise(py(a, b))
    return py(a, b)


def _decimal_of(c: Column, t: Type, scale: int | None = None) -> tuple[Column, Type]:
    """Int64 as an exact Decimal."""
    if t == INT64:
        s = scale or 0
        return c.cast(T.DecimalType(min(38, 19 + s), s)), L.decimal(min(38, 19 + s), s)
    return c, t


def arithmetic(op: str, a: Column, ta: Type, b: Column, tb: Type) -> tuple[Column, Type]:
    if NULL in (ta, tb):
        t = tb if ta == NULL else ta
        t = t if t != NULL else INT64
        return F.lit(None).cast(t.spark()), t
    if not (ta.numeric and tb.numeric):
        raise InvalidArgument(f"{op} of {ta} and {tb}")
    if "Decimal" in (ta.kind, tb.kind):
        if "Float64" in (ta.kind, tb.kind):
            raise InvalidArgument("Decimal and Float64 don't mix")
        if op == "div":
            raise InvalidArgument("Decimal division would round: use round_div")
        if op == "mul":
            (a, ta), (b, tb) = _decimal_of(a, ta), _decimal_of(b, tb)
            if ta.b + tb.b > 38:
                raise InvalidArgument("the product's scale is over 38")
            t = L.decimal(min(38, ta.a + tb.a), ta.b + tb.b)
            return (a * b).cast(t.spark()), t
        scale = ta.b if ta.kind == "Decimal" else tb.b
        (a, ta), (b, tb) = _decimal_of(a, ta, scale), _decimal_of(b, tb, scale)
        if ta.b != tb.b:
            raise InvalidArgument(f"{op} of {ta} and {tb}: scales differ")
        t = L.decimal(min(38, max(ta.a, tb.a) + 1), ta.b)
        return (a + b if op == "add" else a - b).cast(t.spark()), t
    if ta == tb == INT64:
        if op == "div":
            return F.call_function("div", a, b), INT64
        return {"add": a + b, "sub": a - b, "mul": a * b}[op], INT64
    a, b = a.cast("double"), b.cast("double")
    if op == "div":
        return F.when(b == 0.0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0.0, F.lit(1.0)).otherwise(b)), FLOAT64
    return {"add": a + b, "sub": a - b, "mul": a * b}[op], FLOAT64


def _round_div(n: Column, d: Column, t: Type, places: int) -> Column:
    """Exact quotient rounded once, halves away from zero, in the numerator's type."""
    p, s = t.a, t.b

    @F.arrow_udf(T.DecimalType(p, s))
    def divide(x, y):
        import pyarrow as pa

        out = []
        for u, v in zip(x.to_pylist(), y.to_pylist()):
            if u is None or v is None:
                out.append(None)
                continue
            if v == 0:
                raise ZeroDivisionError("round_div by zero")
            nu, nd = u.as_integer_ratio()
            du, dd = v.as_integer_ratio()
            num, den = nu * dd * 10**places, nd * du
            if den < 0:
                num, den = -num, -den
            q = (2 * abs(num) + den) // (2 * den)
            q = (-q if num < 0 else q) * 10 ** (s - places)
            if abs(q) >= 10**p:
                raise OverflowError(f"round_div doesn't fit Decimal({p},{s})")
            out.append(Decimal(q).scaleb(-s))
        return pa.array(out, pa.decimal128(p, s))

    return divide(n, d)


def lower(e: dict, scope: Scope) -> tuple[Column, Type]:
    """A Spark column and its logical type."""
    if len(e) != 1:
        raise InvalidArgument("an expression has exactly one key")
    (key, v), = e.items()
    if key == "col":
        return scope.resolve(v)
    if key == "lit":
        return literal_column(v), literal_type(v)
    if key in ("classof", "scoreof"):
        known = scope.classes if key == "classof" else scope.scores
        if fold(v) not in known:
            raise InvalidArgument(f"{key}({v}): {v} is not the binding of {'an interface scan' if key == 'classof' else 'a text scan'}")
        return F.col(f"`{known[fold(v)]}`"), STRING if key == "classof" else FLOAT64
    if key in COMPARISONS:
        (a, ta), (b, tb) = (lower(x, scope) for x in v)
        if NULL in (ta, tb):
            return F.lit(None).cast("boolean"), BOOL
        if {ta.kind, tb.kind} != {"Int64", "Float64"}:
            _same(ta, tb, COMPARISONS[key])
            if not ta.ordered and (key not in ("eq", "ne") or ta.kind in ("Vector", "GeoPoint")):
                raise InvalidArgument(f"{COMPARISONS[key]} of {ta}")
        return compare(key, a, ta, b, tb), BOOL
    if key in ("and", "or", "not"):
        parts = [lower(x, scope) for x in (v if isinstance(v, list) else [v])]
        for _, t in parts:
            if t not in (BOOL, NULL):
                raise InvalidArgument(f"{key} of {t}")
        cols = [c.cast("boolean") for c, _ in parts]
        return (~cols[0] if key == "not" else cols[0] & cols[1] if key == "and" else cols[0] | cols[1]), BOOL
    if key in ("add", "sub", "mul", "div"):
        (a, ta), (b, tb) = (lower(x, scope) for x in v)
        return arithmetic(key, a, ta, b, tb)
    if key == "if":
        (c, tc), (a, ta), (b, tb) = (lower(v[k], scope) for k in ("cond", "then", "else"))
        if tc not in (BOOL, NULL):
            raise InvalidArgument(f"if on {tc}")
        t = _same(ta, tb, "if")
        return F.when(c.cast("boolean"), a.cast(t.spark())).otherwise(b.cast(t.spark())), t
    if key in ("coalesce", "least", "greatest"):
        parts = [lower(x, scope) for x in v]
        t = parts[0][1]
        for _, other in parts[1:]:
            t = _same(t, other, key)
        if key != "coalesce" and not t.ordered:
            raise InvalidArgument(f"{key} of {t}")
        cols = [c.cast(t.spark()) for c, _ in parts]
        return {"coalesce": F.coalesce, "least": F.least, "greatest": F.greatest}[key](*cols), t
    if key == "date_trunc":
        c, t = lower(v["value"], scope)
        if t not in (TIMESTAMP, NULL):
            raise InvalidArgument(f"date_trunc of {t}")
        return F.date_trunc("day", c.cast("timestamp_ntz")).cast("timestamp_ntz"), TIMESTAMP
    if key == "date_add":
        (c, t), (n, tn) = lower(v["value"], scope), lower(v["amount"], scope)
        if t not in (TIMESTAMP, NULL) or tn not in (INT64, NULL):
            raise InvalidArgument(f"date_add of {t} and {tn}")
        return c.cast("timestamp_ntz") + F.make_dt_interval(n.cast("int")), TIMESTAMP
    if key == "round":
        c, t = lower(v["value"], scope)
        if t.kind != "Decimal" or v["places"] > t.b:
            raise InvalidArgument(f"round of {t} to {v['places']} places")
        return F.round(c, v["places"]).cast(t.spark()), t
    if key == "round_div":
        (n, tn), (d, td) = lower(v["numerator"], scope), lower(v["denominator"], scope)
        if tn.kind != "Decimal" or td.kind not in ("Decimal", "Int64") or v["places"] > tn.b:
            raise InvalidArgument(f"round_div of {tn} and {td} to {v['places']} places")
        d, td = _decimal_of(d, td)
        return _round_div(n, d, tn, v["places"]), tn
    if key == "distance":
        (a, ta), (b, tb) = lower(v["left"], scope), lower(v["right"], scope)
        if ta.kind != "Vector" and ta != NULL or tb.kind != "Vector" and tb != NULL:
            raise InvalidArgument(f"distance of {ta} and {tb}")
        if ta.a and tb.a and ta.a != tb.a:
            raise InvalidArgument(f"distance of {ta} and {tb}")
        return vectors.distance(a, b, v["metric"], strict=True), FLOAT64
    if key == "scalar":
        return scope.lower_plan(v["plan"], scope)
    raise InvalidArgument(f"unknown expression {key}")


def finite(x: float) -> float:
    if not math.isfinite(x):
        raise InvalidArgument("a Float64 value is finite")
    return x
