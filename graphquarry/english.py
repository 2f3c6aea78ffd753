"""English questions to plans: a closed set of sentence forms over the catalog's names.

No model: every word must be grounded in the catalog, a form, or a literal, or
the question is refused with what was and wasn't recognised. Compilation gives
canonical plan text, so what runs can be read first.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from graphquarry.errors import InvalidArgument
from graphquarry.plans import text as P
from graphquarry.sources.catalog import Catalog, NodeTable
from graphquarry.types import Type, fold, suggestion

# The words of the sentence forms.
LEADS = r"(?:show|list|get|find|give me)?\s*(?:me\s+)?(?:all\s+)?(?:the\s+)?"
COMPARISONS = {"over": ">", "above": ">", "more than": ">", "greater than": ">", "under": "<", "below": "<", "less than": "<", "at least": ">=", "at most": "<=", "is not": "!=", "not": "!=", "is": "=", "equals": "=", "=": "="}
AGGREGATES = {"total": "sum", "average": "avg", "highest": "max", "lowest": "min", "maximum": "max", "minimum": "min"}
UNITS = {"m": 1.0, "meters": 1.0, "metres": 1.0, "km": 1000.0, "kilometers": 1000.0, "kilometres": 1000.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "ft": 0.3048, "feet": 0.3048}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
IRREGULAR = {"people": "person", "children": "child"}


class NoParse(InvalidArgument):
    """A question that no form fits; says what was recognised and what wasn't."""

    def __init__(self, question: str, recognized, unrecognized, nearest=()):
        self.recognized, self.unrecognized, self.nearest = list(recognized), list(unrecognized), list(nearest)[:3]
        super().__init__(f"can't read {question!r}: recognised {self.recognized}, not {self.unrecognized}" + (f"; try {self.nearest}" if self.nearest else ""))


def _singular(word: str) -> str:
    w = fold(word)
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


class Ground:
    """What the data say about names; each answer reads two rows at most."""

    def __init__(self, spark, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    def name(self, t: NodeTable, column: str, text: str) -> str | None:
        """The value as it is written in a column: exactly, or else the only one but for case."""
        c = F.col(f"`{column}`")
        found = t.frame(self.spark).where(F.lower(c) == F.lower(F.lit(text))).select(c.alias("v")).distinct().orderBy(c != F.lit(text), "v").limit(2)
        got = [r["v"] for r in found.collect()]
        return text if text in got else got[0] if len(got) == 1 else None

    def place(self, t: NodeTable, label: str, column: str, text: str) -> tuple[float, float] | None:
        """Where the only row of a name is."""
        at = F.col(f"`{column}`")
        rows = t.frame(self.spark).where((F.lower(F.col(f"`{label}`")) == F.lower(F.lit(text))) & at.isNotNull()).select(at.alias("at")).limit(2).collect()
        return (rows[0]["at"]["lat_deg"], rows[0]["at"]["lng_deg"]) if len(rows) == 1 else None


class _Compiler:
    def __init__(self, question: str, catalog: Catalog, today: dt.date | None, ground: Ground | None = None):
        self.catalog, self.today, self.ground = catalog, today, ground
        self.question = question.strip().rstrip("?.! ")

    # -- grounding

    def table(self, word: str) -> NodeTable | None:
        w = fold(word.strip())
        hits = []
        for k, t in self.catalog.nodes.items():
            c = self.catalog.classes.get(k, {})
            names = {k, fold(c.get("display", "")), fold(c.get("plural", ""))}
            if w in names or _singular(w) in names or _singular(w) in {_singular(n) for n in names if n}:
                hits.append(t)
        if len(hits) > 1:
            raise NoParse(self.question, [], [word], [t.name for t in hits])
        return hits[0] if hits else None

    def column(self, t: NodeTable, word: str) -> tuple[str, Type] | None:
        w = fold(word.strip()).replace(" ", "_")
        for n, k in t.columns:
            if fold(n) == w:
                return n, k
        ends = [(n, k) for n, k in t.columns if fold(n).split("_", 1)[-1] == w]
        return ends[0] if len(ends) == 1 else None

    def label(self, t: NodeTable) -> str:
        """The column that names a row."""
        named = self.catalog.classes.get(fold(t.name), {}).get("label")
        if named:
            return named
        for n in ("name", "title", "label"):
            if self.column(t, n):
                return self.column(t, n)[0]
        raise NoParse(self.question, [t.name], ["a name column"])

    def binding(self, t: NodeTable) -> str:
        return _singular(t.name) if t.name.lower() not in ("orders",) else "orders"

    def start(self, t: NodeTable) -> str:
        return f"nodes({P.quote_name(t.name)}) as {P.quote_name(self.binding(t))}"

    def ref(self, t: NodeTable, column: str) -> str:
        return f"{P.quote_name(self.binding(t))}.{P.quote_name(column)}"

    def literal(self, kind: Type, word: str) -> str:
        w = word.strip().strip('"')
        if kind.kind == "String":
            return P.quote_string(w)
        if kind.kind == "Bool" and w in ("true", "false"):
            return w
        if re.fullmatch(r"-?\d+(\.\d+)?", w):
            if kind.kind == "Int64" and "." not in w:
                return w
            if kind.kind == "Float64" or kind.kind == "Int64":
                return P.print_number(float(w))
            if kind.kind == "Decimal":
                whole, _, part = w.partition(".")
                if len(part) <= kind.b:
                    return f'decimal("{whole}.{part.ljust(kind.b, "0")}")' if kind.b else f'decimal("{whole}")'
        raise NoParse(self.question, [str(kind)], [word])

    def conditions(self, t: NodeTable, text: str, binding: str | None = None) -> str:
        ref = self.ref if binding is None else lambda _, c: f"{binding}.{P.quote_name(c)}"
        out = []
        for part in re.split(r"\s+and\s+(?=[A-Za-z_])", text.strip()):
            for words in sorted(COMPARISONS, key=len, reverse=True):
                m = re.fullmatch(rf"(.+?)\s+{re.escape(words)}\s+(.+)", part, re.I)
                c = self.column(t, m[1]) if m else None
                if c:
                    out.append(f"{ref(t, c[0])} {COMPARISONS[words]} {self.literal(c[1], m[2])}")
                    break
            else:
                raise NoParse(self.question, [t.name], part.split(), [n for n, _ in t.columns if suggestion(part.split()[0], [n])])
        return " and ".join(out)

    def filtered(self, t: NodeTable, text: str | None) -> str:
        return self.start(t) + (f" | filter {self.conditions(t, text)}" if text else "")

    def named(self, name: str) -> tuple[NodeTable, str]:
        """The table and column that a bare name is of: where the data have it, else the first with a label."""
        first = None
        for t in self.catalog.nodes.values():
            try:
                label = self.label(t)
            except NoParse:
                continue
            first = first or (t, label)
            if self.ground is None or dict(t.columns)[label].kind == "String" and self.ground.name(t, label, name) is not None:
                return t, label
        if first is None or self.ground is not None:
            raise NoParse(self.question, [], [name])
        return first

    def entity(self, t: NodeTable, name: str) -> str:
        """A filter on the row that a name is of."""
        label = self.label(t)
        written = self.ground.name(t, label, name) if self.ground and dict(t.columns)[label].kind == "String" else name
        return f"filter {self.ref(t, label)} = {P.quote_string(written or name)}"

    # -- forms, in the order in which they are tried

    def compile(self) -> str:
        for form in (self.similar, self.near, self.fulltext, self.without_edge, self.without, self.not_in, self.between, self.months, self.counted, self.aggregated, self.top, self.when, self.hops, self.lookup, self.listed):
            got = form()
            if got is not None:
                return P.print_plan(P.parse_query(got, self.catalog.is_interface))
        words = self.question.split()
        known = [w for w in words if self.table(w)]
        near = [t.name for t in self.catalog.nodes.values() if any(suggestion(w, [t.name]) for w in words)]
        raise NoParse(self.question, known, [w for w in words if w not in known], near)

    def match(self, pattern: str):
        return re.fullmatch(pattern, self.question, re.I)

    def similar(self):
        m = self.match(r"(?:top\s+(\d+)\s+)?(\w+)\s+similar\s+to\s+(.+)")
        t = self.table(m[2]) if m else None
        if not t:
            return None
        v = [n for n, k in t.columns if k.kind == "Vector"]
        if len(v) != 1:
            raise NoParse(self.question, [t.name], ["one vector column"])
        anchor = f"nodes({P.quote_name(t.name)}) as anchor | filter anchor.{P.quote_name(self.label(t))} = {P.quote_string(m[3])} | project anchor.{P.quote_name(v[0])}"
        return f"knn({P.quote_name(t.name)}.{P.quote_name(v[0])}, scalar({anchor}), {m[1] or 10}, cosine)"

    def near(self):
        m = self.match(rf"(how\s+many\s+)?{LEADS}(\w+)(?:\s+(?:where|with)\s+(.+?))?\s+within\s+([\d.]+)\s*(\w+)\s+of\s+(.+)")
        t = self.table(m[2]) if m else None
        if not t:
            return None
        g = [n for n, k in t.columns if k.kind == "GeoPoint"]
        if len(g) != 1 or fold(m[5]) not in UNITS:
            raise NoParse(self.question, [t.name], [m[5]])
        at = re.fullmatch(r"(?:geo\(\s*)?(-?[\d.]+)\s*,\s*(-?[\d.]+)(?:\s*\))?", m[6])
        lat, lng = (float(at[1]), float(at[2])) if at else self._place(m[6])
        name = P.quote_name(t.name)
        out = f"within({name}.{P.quote_name(g[0])}, geo({lat!r}, {lng!r}), {float(m[4]) * UNITS[fold(m[5])]!r})"
        if m[3]:
            out += f" | filter {self.conditions(t, m[3], name)}"
        return out + (f" | aggregate count({name}.{P.quote_name(t.key)}) as `count`" if m[1] else "")

    def _place(self, name: str) -> tuple[float, float]:
        hits = []
        for t in self.catalog.nodes.values() if self.ground else ():
            points = [n for n, k in t.columns if k.kind == "GeoPoint"]
            try:
                label = self.label(t)
            except NoParse:
                continue
            if len(points) == 1 and dict(t.columns)[label].kind == "String" and (at := self.ground.place(t, label, points[0], name)):
                hits.append(at)
        if len(hits) != 1:
            raise NoParse(self.question, [], [name])
        return hits[0]

    def fulltext(self):
        m = self.match(r"search\s+(\w+)\s+(\w+)\s+for\s+\"(.+)\"")
        t = self.table(m[1]) if m else None
        c = self.column(t, m[2]) if t else None
        return f"textscan({P.quote_name(t.name)}.{P.quote_name(c[0])}, {P.quote_string(m[3])}, k=10) as {P.quote_name(self.binding(t))}" if c else None

    def without_edge(self):
        m = self.match(rf"{LEADS}(\w+)\s+with\s+no\s+(\w+)")
        t = self.table(m[1]) if m else None
        if not t:
            return None
        rel = next((r for r in self.catalog.rels.values() if fold(r.name) in (fold(m[2]), _singular(m[2])) and fold(r.source) == fold(t.name)), None)
        if rel is None:
            raise NoParse(self.question, [t.name], [m[2]], [r.name for r in self.catalog.rels.values() if fold(r.source) == fold(t.name)])
        key = P.quote_name(t.key)
        a, b = f"matched.{key}", self.ref(t, t.key)
        head = f"let matches = nodes({P.quote_name(t.name)}) as matched | expand {P.quote_name(rel.name)} out as far | aggregate by {a};"
        return f"{head} {self.start(t)} | left join matches on {b} = {a} | filter coalesce({a} = {a}, false) = false | project {self.ref(t, self.label(t))}"

    def without(self):
        m = self.match(rf"{LEADS}(\w+)\s+without\s+(?:a\s+|an\s+)?(.+)")
        t = self.table(m[1]) if m else None
        c = self.column(t, m[2]) if t else None
        return f"{self.start(t)} | filter coalesce({self.ref(t, c[0])} = {self.ref(t, c[0])}, false) = false" if c else None

    def not_in(self):
        m = self.match(rf"{LEADS}(\w+)\s+not\s+in\s+(\w+)\s+(.+)")
        t = self.table(m[1]) if m else None
        c = self.column(t, m[2]) if t else None
        return f"{self.start(t)} | filter {self.ref(t, c[0])} != {self.literal(c[1], m[3])}" if c else None

    def between(self):
        m = self.match(rf"{LEADS}(\w+)\s+(?:(?:where|with)\s+)?(\w+)\s+between\s+(\S+)\s+and\s+(\S+)")
        t = self.table(m[1]) if m else None
        c = self.column(t, m[2]) if t else None
        if not c:
            return None
        x = self.ref(t, c[0])
        return f"{self.start(t)} | filter {x} >= {self.literal(c[1], m[3])} and {x} <= {self.literal(c[1], m[4])}"

    def _time(self, t: NodeTable) -> str:
        c = [n for n, k in t.columns if k.kind == "Int64" and re.search(r"(?:^|_)(?:at|time|date|ts|occurred)$|_at$", fold(n))]
        if len(c) != 1:
            raise NoParse(self.question, [t.name], ["one time column"])
        return c[0]

    def _span(self, t: NodeTable, column: str, low: dt.date, high: dt.date) -> str:
        a, b = (int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp()) for d in (low, high))
        x = self.ref(t, column)
        return f"{self.start(t)} | filter {x} >= {a} and {x} < {b}"

    def months(self):
        m = self.match(rf"{LEADS}(\w+)\s+from\s+({'|'.join(MONTHS)})\s+to\s+({'|'.join(MONTHS)})\s+(\d{{4}})")
        t = self.table(m[1]) if m else None
        if not t:
            return None
        a, b, y = MONTHS.index(fold(m[2])) + 1, MONTHS.index(fold(m[3])) + 1, int(m[4])
        if b < a:
            raise NoParse(self.question, [t.name], [m[2], m[3]])
        return self._span(t, self._time(t), dt.date(y, a, 1), dt.date(y + b // 12, b % 12 + 1, 1))

    def when(self):
        m = self.match(rf"{LEADS}(\w+)\s+(?:with\s+(\w+)\s+)?(today|yesterday|this\s+month|last\s+month|last\s+(\d+)\s+days)")
        t = self.table(m[1]) if m else None
        if not t:
            return None
        if self.today is None:
            raise NoParse(self.question, [t.name], ["a reference date"])
        d, words = self.today, re.sub(r"\s+", " ", fold(m[3]))
        first = d.replace(day=1)
        one = dt.timedelta(days=1)
        before = (first - one).replace(day=1)
        after = (first + dt.timedelta(days=32)).replace(day=1)
        low, high = {"today": (d, d + one), "yesterday": (d - one, d), "this month": (first, after), "last month": (before, first)}.get(words) or (d - int(m[4]) * one, d)
        c = self.column(t, m[2]) if m[2] else (self._time(t), None)
        return self._span(t, c[0], low, high) if c else None

    def counted(self):
        m = self.match(r"how\s+many\s+(\w+)(?:\s+(?:have|where|with)\s+(.+?))?(?:\s+by\s+(\w+))?")
        t = self.table(m[1]) if m else None
        if not t:
            return None
        by = self.column(t, m[3]) if m[3] else None
        if m[3] and not by:
            raise NoParse(self.question, [t.name], [m[3]])
        return f"{self.filtered(t, m[2])} | aggregate count({self.ref(t, t.key)}) as `count`" + (f" by {self.ref(t, by[0])}" if by else "")

    def aggregated(self):
        words = "|".join(AGGREGATES)
        m = self.match(rf"(?:what\s+is\s+)?(?:the\s+)?({words})\s+(\w+)\s+of\s+(\w+)(?:\s+where\s+(.+?))?(?:\s+by\s+(\w+))?")
        fn, column, table = (m[1], m[2], m[3]) if m else (None, None, None)
        if not m:
            m = self.match(rf"(\w+)\s+({words})\s+(\w+)(?:\s+where\s+(.+?))?(?:\s+by\s+(\w+))?")
            if not m:
                return None
            table, fn, column = m[1], m[2], m[3]
        t = self.table(table)
        c = self.column(t, column) if t else None
        if not c:
            return None
        by = self.column(t, m[5]) if m[5] else None
        if m[5] and not by:
            raise NoParse(self.question, [t.name], [m[5]])
        return f"{self.filtered(t, m[4])} | aggregate {AGGREGATES[fold(fn)]}({self.ref(t, c[0])}) as {fold(fn)}" + (f" by {self.ref(t, by[0])}" if by else "")

    def top(self):
        m = self.match(r"(top|bottom)\s+(\d+)\s+(\w+)\s+by\s+(\w+)(?:\s+where\s+(.+))?")
        t = self.table(m[3]) if m else None
        c = self.column(t, m[4]) if t else None
        return f"{self.filtered(t, m[5])} | sort {self.ref(t, c[0])}{' desc' if fold(m[1]) == 'top' else ''} | limit {m[2]}" if c else None

    def _rel(self, words: str):
        """The relationship that words name, and its direction: in for an inverse."""
        w = fold(re.sub(r"\s+", " ", words.strip()))
        for k, r in self.catalog.rels.items():
            c = self.catalog.classes.get(k, {})
            there = self.catalog.classes.get(fold(r.target), {})
            own = {k, k.replace("_", " "), fold(c.get("verb", "")), fold(c.get("display", ""))}
            if w in own or _singular(w) in {_singular(x) for x in own if x}:
                return r, "out"
            if c.get("inverse") and w in (fold(c["inverse"]), _singular(c["inverse"])):
                return r, "in"
            if w == "friends" and fold(r.source) == fold(r.target) and "know" in _singular(k) and "friends" not in (fold(there.get("plural", "")),):
                return r, "out"
        return None

    def hops(self):
        m = self.match(r"(.+?)\s+of\s+(.+?)\s+of\s+(.+)")
        far, near = (self._rel(m[1]), self._rel(m[2])) if m else (None, None)
        if not (far and near):
            m = self.match(r"who\s+(?:do|does)\s+the\s+\w+\s+(.+?)\s+(\w+)\s+(\w+)")
            far, near = (self._rel(m[3]), self._rel(m[2])) if m else (None, None)
            if far and near:
                return self._two_hops(near, far, m[1])
        else:
            return self._two_hops(near, far, m[3])
        m = self.match(r"who\s+(?:does|do)\s+(.+?)\s+(\w+)(?:\s+where\s+(.+))?")
        r = self._rel(m[2]) if m else None
        if r:
            return self._hop(r[0], r[1], m[1], m[3])
        m = self.match(r"who\s+(\w+)\s+(.+?)(?:\s+where\s+(.+))?")
        r = self._rel(m[1]) if m else None
        return self._hop(r[0], "in" if r[1] == "out" else "out", m[2], m[3]) if r else None

    def _hop(self, r, direction: str, name: str, where: str | None) -> str:
        here, there = (r.source, r.target) if direction == "out" else (r.target, r.source)
        t, far = self.catalog.node_table(here), self.catalog.node_table(there)
        kept = f" | filter {self.conditions(far, where, 'other')}" if where else ""
        return f"{self.start(t)} | {self.entity(t, name)} | expand {P.quote_name(r.name)} {direction} as other{kept} | project other.{P.quote_name(self.label(far))}"

    def _two_hops(self, near, far, name: str) -> str:
        ends = [(r.source, r.target) if way == "out" else (r.target, r.source) for r, way in (near, far)]
        if fold(ends[0][1]) != fold(ends[1][0]):
            raise NoParse(self.question, [near[0].name, far[0].name], [f"{ends[0][1]} is not {ends[1][0]}"])
        t, last = self.catalog.node_table(ends[0][0]), self.catalog.node_table(ends[1][1])
        steps = "".join(f" | expand {P.quote_name(r.name)} {way} as {b}" for (r, way), b in zip((near, far), ("hop1", "other")))
        return f"{self.start(t)} | {self.entity(t, name)}{steps} | project other.{P.quote_name(self.label(last))}"

    def lookup(self):
        m = self.match(r"(?:who|what)\s+is\s+(.+)")
        if not m:
            return None
        t, _ = self.named(m[1])
        return f"{self.start(t)} | {self.entity(t, m[1])}"

    def listed(self):
        m = self.match(rf"{LEADS}(\w+)(?:\s+(?:where|with|whose|that\s+have)\s+(.+))?")
        t = self.table(m[1]) if m else None
        return self.filtered(t, m[2]) if t else None


def compile_question(question: str, catalog: Catalog, reference_date: dt.date | None = None, ground: Ground | None = None) -> str:
    """Canonical plan text of a question; raises ``NoParse`` when no form fits.

    With ``ground`` names are looked up in the data: their case, which table
    they are of, and where a place is. Without it they are taken as written.
    """
    return _Compiler(question, catalog, reference_date, ground).compile()


def compile_statement(sentence: str, catalog: Catalog) -> str:
    """Statement text of ``set person 7 age to 40`` or ``delete person 7``."""
    c = _Compiler(sentence, catalog, None)
    m = c.match(r"set\s+(\w+)\s+(\S+)\s+(\w+)\s+to\s+(.+)")
    if m and (t := c.table(m[1])) and (col := c.column(t, m[3])):
        key = dict(t.columns)[t.key]
        return f"update {P.quote_name(t.name)} set {P.quote_name(col[0])} = {c.literal(col[1], m[4])} where {P.quote_name(t.key)} = {c.literal(key, m[2])}"
    m = c.match(r"delete\s+(\w+)\s+(\S+)")
    if m and (t := c.table(m[1])):
        return f"delete from {P.quote_name(t.name)} where {P.quote_name(t.key)} = {c.literal(dict(t.columns)[t.key], m[2])}"
    raise NoParse(sentence, [], sentence.split())
