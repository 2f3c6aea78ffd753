"""Pipeline text: lexer, parser and canonical printer.

Plans are held in their canonical JSON shape: an operator is a dict with
``op`` and its fields, an expression a dict with exactly one key. So JSON needs
no codec, and the printer and the lowering read the same structure.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable

from graphquarry.errors import InvalidArgument
from graphquarry.types import fold

# The reserved words.
RESERVED = frozenset(
    "and or not true false null as by asc desc out in both from to nodes expand filter project sort limit offset aggregate knn distance if coalesce least "
    "greatest date_trunc date_add round round_div scalar cosine l2 count sum min max avg percentile_cont create insert into values node rel table primary "
    "key update set delete where upsert copy let join on".split()
)
STAGES = ("expand", "expand_rel", "filter", "project", "sort", "limit", "aggregate", "join", "left join")
COMPARE = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
ARITHMETIC = {"+": "add", "-": "sub", "*": "mul", "/": "div"}
MAX_DEPTH = 128
# a level of nesting is eight calls deep
sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))

_TOKEN = re.compile(
    r"""[ \t\r\n]*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<quoted>`(?:[^`\\]|\\.)*`)"""
    r"""|(?P<str>"(?:[^"\\\x00-\x1f]|\\.)*")|(?P<sym>->|!=|<=|>=|[|()\[\],.=<>+\-*/;])|(?P<end>$))""",
    re.S,
)


def _unescape(body: str, at: int) -> str:
    def one(m):
        c = m[1]
        if c[0] == "u":
            return chr(int(c[2:-1], 16))
        if c in '"\\`':
            return c
        if c in "nrt":
            return {"n": "\n", "r": "\r", "t": "\t"}[c]
        raise InvalidArgument(f"at {at}: unknown escape \\{c}")

    return re.sub(r"\\(u\{[0-9A-Fa-f]{1,6}\}|.)", one, body, flags=re.S)


def lex(text: str) -> list[tuple[str, object, int]]:
    """(kind, value, 1-based position) of every token; kinds: num word name str sym end."""
    out, at = [], 0
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            at += len(text[at:]) - len(text[at:].lstrip(" \t\r\n"))
            raise InvalidArgument(f"at {at + 1}: unexpected {text[at : at + 1]!r}")
        kind, start = m.lastgroup, m.start(m.lastgroup) + 1
        value: object = m[kind]
        if kind == "num":
            value = float(value) if re.search("[.eE]", value) else int(value)
        elif kind == "quoted":
            kind, value = "name", _unescape(value[1:-1], start)
            if not value:
                raise InvalidArgument(f"at {start}: an identifier is empty")
        elif kind == "str":
            value = _unescape(value[1:-1], start)
        out.append((kind, value, start))
        if kind == "end":
            return out
        at = m.end()


class Parser:
    """Recursive descent over the tokens of one query or statement."""

    def __init__(self, text: str, is_interface: Callable[[str], bool] | None = None):
        self.text, self.tokens, self.i, self.depth = text, lex(text), 0, 0
        self.is_interface = is_interface or (lambda name: False)
        self.lets: dict[str, dict] = {}

    # -- tokens

    def peek(self, k: int = 0):
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def fail(self, what: str, k: int = 0):
        kind, value, at = self.peek(k)
        raise InvalidArgument(f"at {at}: {what}, found {'the end' if kind == 'end' else repr(value)}")

    def at(self, *values: str) -> bool:
        """Whether the next tokens are these words or symbols."""
        return all(self.peek(k)[0] in ("word", "sym") and self.peek(k)[1] == v for k, v in enumerate(values))

    def take(self, *values: str) -> bool:
        if self.at(*values):
            self.i += len(values)
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            kind, got, _ = self.peek()
            hint = f" (keywords are lower case: {value})" if kind == "word" and fold(str(got)) == value else ""
            self.fail(f"expected {value!r}{hint}")

    def name(self) -> str:
        kind, value, _ = self.peek()
        if kind == "name" or kind == "word" and value not in RESERVED:
            self.i += 1
            return value
        self.fail("expected a name")

    def string(self) -> str:
        kind, value, _ = self.peek()
        if kind != "str":
            self.fail("expected a string")
        self.i += 1
        return value

    def count(self, what: str) -> int:
        if self.at("-"):
            self.fail(f"{what} can't be negative")
        kind, value, _ = self.peek()
        if kind != "num" or not isinstance(value, int):
            self.fail(f"expected a whole number for {what}")
        self.i += 1
        return value

    def number(self):
        minus = self.take("-")
        kind, value, _ = self.peek()
        if kind != "num":
            self.fail("expected a number")
        self.i += 1
        value = -value if minus else value
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            self.fail("the number doesn't fit Int64", -1)
        return value

    def listed(self, one, close: str | None = None) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        if close:
            self.need(close)
        return out

    # -- expressions

    def expr(self) -> dict:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("expression nesting exceeds 128 levels")
        out = self._or()
        self.depth -= 1
        return out

    def _or(self) -> dict:
        left = self._and()
        while self.take("or"):
            left = {"or": [left, self._and()]}
        return left

    def _and(self) -> dict:
        left = self._not()
        while self.take("and"):
            left = {"and": [left, self._not()]}
        return left

    def _not(self) -> dict:
        n = 0
        while self.take("not"):
            n += 1
            if self.depth + n > MAX_DEPTH:
                self.fail("expression nesting exceeds 128 levels")
        out = self._compare()
        for _ in range(n):
            out = {"not": out}
        return out

    def _compare(self) -> dict:
        left = self._sum()
        kind, value, _ = self.peek()
        if kind == "sym" and value in COMPARE:
            self.i += 1
            left = {COMPARE[value]: [left, self._sum()]}
            if self.peek()[0] == "sym" and self.peek()[1] in COMPARE:
                self.fail("comparisons don't chain: parenthesize")
        return left

    def _sum(self) -> dict:
        left = self._product()
        while self.at("+") or self.at("-"):
            op = ARITHMETIC[self.peek()[1]]
            self.i += 1
            left = {op: [left, self._product()]}
        return left

    def _product(self) -> dict:
        left = self._primary()
        while self.at("*") or self.at("/"):
            op = ARITHMETIC[self.peek()[1]]
            self.i += 1
            left = {op: [left, self._primary()]}
        return left

    def _primary(self) -> dict:
        kind, value, _ = self.peek()
        if self.take("("):
            out = self.expr()
            self.need(")")
            return out
        lit = self.literal(optional=True)
        if lit is not None:
            return {"lit": lit[0]}
        following = self.peek(1)[1] == "(" and self.peek(1)[0] == "sym"
        if kind == "word" and following:
            if value in ("coalesce", "least", "greatest"):
                self.i += 2
                args = self.listed(self.expr, ")")
                if len(args) < 2:
                    self.fail(f"{value} takes two arguments at least", -1)
                return {value: args}
            if value in ("classof", "scoreof"):
                self.i += 2
                b = self.name()
                self.need(")")
                return {value: b}
            if value in ("if", "distance", "date_trunc", "date_add", "round", "round_div", "scalar"):
                self.i += 2
                out = getattr(self, f"_call_{value}")()
                self.need(")")
                return out
        if kind == "name" or kind == "word" and value not in RESERVED:
            b = self.name()
            self.need(".")
            return {"col": f"{b}.{self.name()}"}
        self.fail("expected an expression")

    def _call_if(self) -> dict:
        cond = self.expr()
        self.need(",")
        then = self.expr()
        self.need(",")
        return {"if": {"cond": cond, "then": then, "else": self.expr()}}

    def _call_distance(self) -> dict:
        left = self.expr()
        self.need(",")
        right = self.expr()
        self.need(",")
        return {"distance": {"left": left, "right": right, "metric": self.metric()}}

    def _day(self) -> None:
        if self.string() != "day":
            self.fail('the only unit is "day"', -1)
        self.need(",")

    def _call_date_trunc(self) -> dict:
        self._day()
        return {"date_trunc": {"unit": "day", "value": self.expr()}}

    def _call_date_add(self) -> dict:
        self._day()
        value = self.expr()
        self.need(",")
        return {"date_add": {"unit": "day", "value": value, "amount": self.expr()}}

    def _places(self) -> int:
        self.need(",")
        n = self.count("places")
        if n > 38:
            self.fail("places go up to 38", -1)
        return n

    def _call_round(self) -> dict:
        value = self.expr()
        return {"round": {"value": value, "places": self._places()}}

    def _call_round_div(self) -> dict:
        n = self.expr()
        self.need(",")
        d = self.expr()
        return {"round_div": {"numerator": n, "denominator": d, "places": self._places()}}

    def _call_scalar(self) -> dict:
        return {"scalar": {"plan": self.query(nested=True)}}

    def metric(self) -> str:
        for m in ("cosine", "l2"):
            if self.take(m):
                return m
        self.fail("expected cosine or l2")

    def literal(self, optional: bool = False):
        """A literal value in a one-element tuple, in its JSON form."""
        kind, value, _ = self.peek()
        if kind == "num" or self.at("-"):
            return (self.number(),)
        if kind == "str":
            self.i += 1
            return (value,)
        for word, v in (("null", None), ("true", True), ("false", False)):
            if self.take(word):
                return (v,)
        if self.take("["):
            if self.take("]"):
                return ([],)
            return ([float(x) for x in self.listed(self.number, "]")],)
        if kind == "word" and self.peek(1)[:2] == ("sym", "("):
            if value == "geo":
                self.i += 2
                lat = float(self.number())
                self.need(",")
                lng = float(self.number())
                self.need(")")
                return (canonical_geo(lat, lng),)
            if value in ("timestamp", "bytes", "decimal", "json"):
                self.i += 2
                body = self.string()
                self.need(")")
                return ({value: body},)
        if optional:
            return None
        self.fail("expected a literal")

    # -- queries

    def query(self, nested: bool = False) -> dict:
        outer = dict(self.lets)
        while self.take("let"):
            name = self.name()
            if fold(name) in self.lets:
                self.fail(f"let {name} is defined twice", -1)
            self.need("=")
            plan = self.pipeline()
            self.need(";")
            self.lets[fold(name)] = plan
        plan = self.pipeline()
        self.lets = outer
        if not nested and self.peek()[0] != "end":
            self.fail("expected a stage or the end")
        return plan

    def pipeline(self) -> dict:
        plan, near = self.source()
        while self.take("|"):
            plan, near = self.stage(plan, near)
        return plan

    def _table_column(self) -> tuple[str, str]:
        t = self.name()
        self.need(".")
        return t, self.name()

    def source(self) -> tuple[dict, str | None]:
        if self.take("nodes", "("):
            t = self.name()
            self.need(")")
            self.need("as")
            b = self.name()
            if self.is_interface(t):
                return {"op": "ScanInterface", "interface": t, "binding": b}, b
            return {"op": "ScanNodes", "table": t, "binding": b}, b
        if self.take("textscan", "("):
            t, c = self._table_column()
            self.need(",")
            q = self.string()
            self.need(",")
            if not self.take("k", "="):
                self.fail("expected k=")
            k = self.count("k")
            self.need(")")
            self.need("as")
            b = self.name()
            return {"op": "TextScan", "table": t, "column": c, "query": q, "k": k, "binding": b}, b
        if self.take("knn", "("):
            t, c = self._table_column()
            self.need(",")
            if self.take("scalar", "("):
                q: object = self._call_scalar()
                self.need(")")
            else:
                q = self.literal()[0]
                if not isinstance(q, list):
                    self.fail("expected a vector", -1)
            self.need(",")
            k = self.count("k")
            self.need(",")
            out = {"op": "KnnScan", "table": t, "column": c, "query": q, "k": k, "metric": self.metric()}
            if self.take(","):
                if not self.take("approximate"):
                    self.fail("expected approximate")
                out["mode"] = "approximate"
            self.need(")")
            return out, t
        if self.take("within", "("):
            t, c = self._table_column()
            self.need(",")
            geo = self.literal()[0]
            if not (isinstance(geo, dict) and "geo" in geo):
                self.fail("expected geo(lat, lng)", -1)
            self.need(",")
            meters = self.number()
            self.need(")")
            return {"op": "WithinScan", "table": t, "column": c, "center": geo["geo"], "meters": meters}, t
        self.fail("expected a source: nodes, textscan, knn or within")

    def stage(self, plan: dict, near: str | None) -> tuple[dict, str | None]:
        if self.at("expand") or self.at("expand_rel"):
            with_rel = self.peek()[1] == "expand_rel"
            self.i += 1
            rel = self.name()
            direction = next((d for d in ("out", "in", "both") if self.take(d)), None)
            if direction is None:
                self.fail("expected out, in or both")
            start = self.name() if self.take("from") else near
            if start is None:
                self.fail("expand needs a binding to start from")
            self.need("as")
            b = self.name()
            out = {"op": "ExpandRel" if with_rel else "Expand", "rel": rel, "direction": direction, "from_binding": start, "binding": b}
            if with_rel:
                if not self.take("via"):
                    self.fail("expected via")
                out["rel_binding"] = self.name()
            return out | {"input": plan}, b
        if self.take("filter"):
            return {"op": "Filter", "predicate": self.expr(), "input": plan}, near
        if self.take("project"):
            return {"op": "Project", "exprs": self.listed(self._item), "input": plan}, near
        if self.take("sort"):
            return {"op": "Sort", "keys": self.listed(self._key), "input": plan}, near
        if self.take("limit"):
            out = {"op": "Limit", "count": self.count("limit")}
            if self.take("offset"):
                out["offset"] = self.count("offset")
            return out | {"input": plan}, near
        if self.take("aggregate"):
            aggs = [] if self.at("by") else self.listed(self._agg)
            by = self.listed(self.expr) if self.take("by") else []
            return {"op": "Aggregate", "group_by": by, "aggs": aggs, "input": plan}, None
        if self.at("join") or self.at("left", "join"):
            left = self.take("left")
            self.i += 1
            name = self.name()
            right = self.lets.get(fold(name))
            if right is None:
                self.fail(f"no let named {name} (defined: {', '.join(sorted(self.lets)) or 'none'})", -1)
            self.need("on")
            on = self._join_keys(self.expr(), plan, right)
            out = {"op": "HashJoin"} | ({"join": "left"} if left else {})
            return out | {"on": on, "left": plan, "right": right}, near
        kind, value, _ = self.peek()
        hint = f" (keywords are lower case: {fold(value)})" if kind == "word" and fold(value) in STAGES else ""
        self.fail(f"unknown stage{hint}; stages are {', '.join(STAGES)}")

    def _join_keys(self, e: dict, left: dict, right: dict) -> list[dict]:
        if "and" in e:
            return [k for side in e["and"] for k in self._join_keys(side, left, right)]
        if "eq" not in e:
            self.fail("a join is on equalities; a non-equi predicate belongs in a following filter", -1)
        a, b = e["eq"]
        of_left, of_right = bindings_of(left), bindings_of(right)
        names = [{fold(c.split(".", 1)[0]) for c in columns_of(x)} for x in (a, b)]
        if names[0] <= of_right and names[1] <= of_left and not (names[0] <= of_left and names[1] <= of_right):
            a, b = b, a
        return [{"left": a, "right": b}]

    def _item(self) -> dict:
        e = self.expr()
        if self.take("as"):
            return {"expr": e, "as": self.name()}
        return {"expr": e, "as": print_expr(e)}

    def _key(self) -> dict:
        e = self.expr()
        order = "desc" if self.take("desc") else "asc"
        if order == "asc":
            self.take("asc")
        return {"expr": e, "order": order}

    def _agg(self) -> dict:
        fn = self.peek()[1]
        if fn not in ("count", "sum", "min", "max", "avg", "percentile_cont"):
            self.fail("expected an aggregate function")
        self.i += 1
        self.need("(")
        out = {"fn": fn}
        if fn == "percentile_cont":
            if self.literal()[0] != {"decimal": "0.5"}:
                self.fail('percentile_cont takes exactly decimal("0.5")', -1)
            self.need(",")
            out["fraction"] = "0.5"
        out["expr"] = self.expr()
        self.need(")")
        self.need("as")
        out["as"] = self.name()
        return out

    # -- statements

    def statement(self) -> dict:
        out = self._statement()
        if self.peek()[0] != "end":
            self.fail("expected the end")
        return out

    def _values(self) -> list:
        self.need("(")
        return self.listed(lambda: self.literal()[0], ")")

    def _type(self) -> str:
        kind, value, _ = self.peek()
        if kind != "word":
            self.fail("expected a type")
        self.i += 1
        out = value
        if self.take("("):
            args = self.listed(lambda: str(self.count("size")) if self.peek()[0] == "num" else self.name(), ")")
            out += f"({','.join(args)})"
        return out

    def _columns(self, keyed: bool) -> list[dict]:
        def one():
            c = {"name": self.name(), "type": self._type()}
            if keyed and self.take("primary", "key"):
                c["primary_key"] = True
            return c

        self.need("(")
        return self.listed(one, ")")

    def _statement(self) -> dict:
        if self.take("create", "node", "table"):
            return {"stmt": "CreateNodeTable", "name": self.name(), "columns": self._columns(True)}
        if self.take("create", "rel", "table"):
            out = {"stmt": "CreateRelTable", "name": self.name()}
            self.need("from")
            out["from"] = self.name()
            self.need("to")
            out["to"] = self.name()
            return out | {"columns": self._columns(False) if self.at("(") else []}
        if self.take("create", "interface"):
            return {"stmt": "CreateInterface", "name": self.name(), "columns": self._columns(False)}
        if self.take("create", "class", "for"):
            return self._class()
        if self.take("create", "hnsw", "index"):
            out = {"stmt": "CreateHnswIndex", "name": self.name()}
            self.need("on")
            out["table"], out["column"] = self._table_column()
            if not self.take("metric"):
                self.fail("expected metric")
            return out | {"metric": self.metric()}
        if self.take("insert", "into"):
            t = self.name()
            self.need("values")
            return {"stmt": "InsertNode", "table": t, "rows": self.listed(self._values)}
        if self.take("insert", "rel", "into"):
            t = self.name()
            self.need("values")

            def edge():
                self.need("(")
                a = self.literal()[0]
                self.need("->")
                b = self.literal()[0]
                values = self.listed(lambda: self.literal()[0]) if self.take(",") else []
                self.need(")")
                return {"from_key": a, "to_key": b, "values": values}

            return {"stmt": "InsertRel", "table": t, "rows": self.listed(edge)}
        if self.take("upsert"):
            t = self.name()
            self.need("values")
            return {"stmt": "UpsertNode", "table": t, "rows": self.listed(self._values)}
        if self.take("update"):
            t = self.name()
            self.need("set")

            def assign():
                c = self.name()
                self.need("=")
                return {"column": c, "value": self.literal()[0]}

            return {"stmt": "UpdateNode", "table": t, "set": self.listed(assign)} | self._where()
        if self.take("delete", "from"):
            return {"stmt": "DeleteNode", "table": self.name()} | self._where()
        if self.take("detach", "delete", "from"):
            return {"stmt": "DetachDeleteNode", "table": self.name()} | self._where()
        if self.take("copy"):
            out = {"stmt": "CopyNode", "table": self.name()}
            self.need("from")
            out["path"] = self.string()
            if self.take("sort", "by"):
                out["sort_by"] = self.name()
            return out
        if self.take("pin"):
            name = self.string()
            self.need("as")
            plan = self.query(nested=True)
            return {"stmt": "PinPlan", "name": name, "text": print_plan(plan), "plan": {"v": 0, "plan": plan}}
        if self.take("unpin"):
            return {"stmt": "UnpinPlan", "name": self.string()}
        self.fail("expected a statement")

    def _where(self) -> dict:
        self.need("where")
        c = self.name()
        self.need("=")
        return {"key_column": c, "key": self.literal()[0]}

    def _class(self) -> dict:
        out = {"stmt": "CreateClass", "table": self.name()}
        self.need("(")
        order = ("display", "plural", "label", "summary", "color", "description", "implements", "verb", "inverse")
        last = -1
        while not self.take(")"):
            if last >= 0:
                self.need(",")
            clause = self.peek()[1]
            if clause not in order or order.index(clause) <= last:
                self.fail(f"expected a clause of {', '.join(order)}, in this order")
            self.i += 1
            last = order.index(clause)
            if clause in ("summary", "implements"):
                self.need("(")
                out[clause] = self.listed(self.name, ")")
            else:
                out[clause] = self.name() if clause == "label" else self.string()
        return out


def canonical_geo(lat: float, lng: float) -> dict:
    """A GeoPoint with its longitude in [-180, 180), 0 at the poles."""
    if not (-90 <= lat <= 90) or not (-180 <= lng <= 180):
        raise InvalidArgument("latitude is in [-90, 90] and longitude in [-180, 180]")
    lng = 0.0 if abs(lat) == 90 else -180.0 if lng == 180 else lng
    return {"geo": {"lat_deg": lat + 0.0, "lng_deg": lng + 0.0}}


def columns_of(e: dict) -> list[str]:
    """Column references of an expression, not those inside scalar queries."""
    (key, v), = e.items()
    if key == "col":
        return [v]
    if key in ("lit", "scalar", "classof", "scoreof"):
        return [f"{v}.*"] if key in ("classof", "scoreof") else []
    parts = v if isinstance(v, list) else [v] if key == "not" else [x for x in v.values() if isinstance(x, dict)]
    return [c for x in parts for c in columns_of(x)]


def bindings_of(plan: dict) -> set[str]:
    """Folded names of the bindings that a plan introduces."""
    op = plan["op"]
    own = {fold(plan[k]) for k in ("binding", "rel_binding") if k in plan}
    if op in ("KnnScan", "WithinScan"):
        own = {fold(plan["table"])}
    if op == "Project":
        own = {fold(i["as"].split(".", 1)[0]) for i in plan["exprs"] if "." in i["as"]}
    for side in ("input", "left", "right"):
        if side in plan:
            own |= bindings_of(plan[side])
    return own


def parse_query(text: str, is_interface: Callable[[str], bool] | None = None) -> dict:
    return Parser(text, is_interface).query()


def parse_statement(text: str, is_interface: Callable[[str], bool] | None = None) -> dict:
    return Parser(text, is_interface).statement()


def is_statement(text: str) -> bool:
    return lex(text)[0][1] in ("create", "insert", "upsert", "update", "delete", "detach", "copy", "pin", "unpin")


# --- printing ----------------------------------------------------------------

_LEVEL = {"or": 1, "and": 2, "not": 3} | {v: 4 for v in COMPARE.values()} | {"add": 5, "sub": 5, "mul": 6, "div": 6}
_SIGN = {v: k for k, v in (COMPARE | ARITHMETIC).items()} | {"or": "or", "and": "and"}


def quote_name(name: str) -> str:
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name not in RESERVED:
        return name
    return "`" + "".join(_escape(c, "`") for c in name) + "`"


def _escape(c: str, mark: str) -> str:
    if c in (mark, "\\"):
        return "\\" + c
    if c in "\n\r\t":
        return {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
    return f"\\u{{{ord(c):x}}}" if ord(c) < 32 else c


def quote_string(s: str) -> str:
    return '"' + "".join(_escape(c, '"') for c in s) + '"'


def print_number(x) -> str:
    if isinstance(x, int):
        return str(x)
    out = repr(float(x))
    return out if re.search("[.eE]", out) else out + ".0"


def print_literal(v) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return print_number(v)
    if isinstance(v, str):
        return quote_string(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(print_number, v)) + "]"
    (kind, body), = v.items()
    if kind == "geo":
        return f"geo({print_number(body['lat_deg'])}, {print_number(body['lng_deg'])})"
    return f"{kind}({quote_string(body)})"


def _print_column(c: str) -> str:
    b, dot, name = c.partition(".")
    if not dot:
        raise InvalidArgument(f"column {c} has no binding")
    return f"{quote_name(b)}.{quote_name(name)}"


def print_expr(e: dict, level: int = 0) -> str:
    (key, v), = e.items()
    if key == "col":
        return _print_column(v)
    if key == "lit":
        return print_literal(v)
    if key in ("classof", "scoreof"):
        return f"{key}({quote_name(v)})"
    if key in ("coalesce", "least", "greatest"):
        return f"{key}({', '.join(map(print_expr, v))})"
    if key == "if":
        return f"if({print_expr(v['cond'])}, {print_expr(v['then'])}, {print_expr(v['else'])})"
    if key == "distance":
        return f"distance({print_expr(v['left'])}, {print_expr(v['right'])}, {v['metric']})"
    if key == "date_trunc":
        return f'date_trunc("day", {print_expr(v["value"])})'
    if key == "date_add":
        return f'date_add("day", {print_expr(v["value"])}, {print_expr(v["amount"])})'
    if key == "round":
        return f"round({print_expr(v['value'])}, {v['places']})"
    if key == "round_div":
        return f"round_div({print_expr(v['numerator'])}, {print_expr(v['denominator'])}, {v['places']})"
    if key == "scalar":
        return f"scalar({print_plan(v['plan'])})"
    own = _LEVEL[key]
    if key == "not":
        out = f"not {print_expr(v, own)}"
    else:
        left = print_expr(v[0], own + (own == 4))
        out = f"{left} {_SIGN[key]} {print_expr(v[1], own + 1)}"
    return f"({out})" if own < level else out


def print_plan(plan: dict) -> str:
    """Canonical text; right sides of joins become lets j1, j2, ..."""
    lets: list[str] = []
    names = iter(range(1, 1_000_000))

    def walk(p: dict) -> tuple[str, str | None]:
        op = p["op"]
        if op in ("ScanNodes", "ScanInterface"):
            return f"nodes({quote_name(p.get('table', p.get('interface')))}) as {quote_name(p['binding'])}", p["binding"]
        if op == "TextScan":
            return f"textscan({quote_name(p['table'])}.{quote_name(p['column'])}, {quote_string(p['query'])}, k={p['k']}) as {quote_name(p['binding'])}", p["binding"]
        if op == "KnnScan":
            q = print_literal(p["query"]) if isinstance(p["query"], list) else print_expr(p["query"])
            mode = ", approximate" if p.get("mode") == "approximate" else ""
            return f"knn({quote_name(p['table'])}.{quote_name(p['column'])}, {q}, {p['k']}, {p['metric']}{mode})", p["table"]
        if op == "WithinScan":
            return f"within({quote_name(p['table'])}.{quote_name(p['column'])}, {print_literal({'geo': p['center']})}, {print_number(p['meters'])})", p["table"]
        if op == "HashJoin":
            name = f"j{next(names)}"
            slot = len(lets)
            lets.append("")
            left, near = walk(p["left"])
            right, _ = walk(p["right"])
            lets[slot] = f"let {name} = {right};"
            on = " and ".join(f"{print_expr(k['left'], 5)} = {print_expr(k['right'], 5)}" for k in p["on"])
            return f"{left} | {'left ' if p.get('join') == 'left' else ''}join {name} on {on}", near
        head, near = walk(p["input"])
        if op in ("Expand", "ExpandRel"):
            start = "" if near is not None and fold(near) == fold(p["from_binding"]) else f" from {quote_name(p['from_binding'])}"
            word, via = ("expand_rel", f" via {quote_name(p['rel_binding'])}") if op == "ExpandRel" else ("expand", "")
            return f"{head} | {word} {quote_name(p['rel'])} {p['direction']}{start} as {quote_name(p['binding'])}{via}", p["binding"]
        if op == "Filter":
            return f"{head} | filter {print_expr(p['predicate'])}", near
        if op == "Project":
            items = (print_expr(i["expr"]) + ("" if i["as"] == print_expr(i["expr"]) else f" as {quote_name(i['as'])}") for i in p["exprs"])
            return f"{head} | project {', '.join(items)}", near
        if op == "Sort":
            return f"{head} | sort {', '.join(print_expr(k['expr']) + (' desc' if k['order'] == 'desc' else '') for k in p['keys'])}", near
        if op == "Limit":
            return f"{head} | limit {p['count']}" + (f" offset {p['offset']}" if p.get("offset") is not None else ""), near
        if op == "Aggregate":
            aggs = ", ".join(f"{a['fn']}({'decimal(\"0.5\"), ' if a['fn'] == 'percentile_cont' else ''}{print_expr(a['expr'])}) as {quote_name(a['as'])}" for a in p["aggs"])
            by = ", ".join(map(print_expr, p["group_by"]))
            return f"{head} | aggregate{' ' + aggs if aggs else ''}{' by ' + by if by else ''}", None
        raise InvalidArgument(f"unknown operator {op}")

    main, _ = walk(plan)
    # a let must come before its use: inner joins were numbered after outer ones
    return " ".join([*reversed(lets), main])


def to_json(plan: dict) -> str:
    return json.dumps({"v": 0, "plan": plan}, separators=(",", ":"), ensure_ascii=False)


def from_json(text: str) -> dict:
    got = json.loads(text)
    if set(got) != {"v", "plan"} or got["v"] != 0:
        raise InvalidArgument("expected {\"v\":0,\"plan\":...}")
    return got["plan"]
