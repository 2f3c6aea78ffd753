"""Lowering of plans to DataFrames: one function per operator.

Row order is part of a plan's meaning. Instead of sorting at each step, a frame
carries the columns that its order follows from; a sort is paid only where the
order can be observed, at ``limit`` and at the root.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.errors import InvalidArgument
from graphquarry.functions import expressions as X
from graphquarry.functions import fulltext, geo, vectors
from graphquarry.plans.text import bindings_of, print_expr
from graphquarry.types import BOOL, FLOAT64, INT64, NULL, STRING, Type, decimal, fold, suggestion


@dataclass
class Frame:
    """Rows with what is visible, what is hidden, and how they are ordered."""

    df: DataFrame
    columns: list[tuple[str, str, Type]]  # label, physical name, type
    order: list[tuple[str, bool]]  # physical name, descending
    nodes: dict[str, tuple[str, str]] = field(default_factory=dict)  # binding -> (table, key column)
    classes: dict[str, str] = field(default_factory=dict)
    scores: dict[str, str] = field(default_factory=dict)
    output_only: list[tuple[str, str, Type]] = field(default_factory=list)
    names: dict[str, tuple[str, Type]] = field(default_factory=dict)  # further names that resolve
    bindings: set[str] = field(default_factory=set)
    domain: list[str] = field(default_factory=list)  # outer values that the rows belong to

    def scope(self, lowering: "Lowering", outer: X.Scope | None) -> X.Scope:
        known = {fold(label): (p, t) for label, p, t in self.columns}
        return X.Scope(self.names | known, self.classes, self.scores, outer, lowering.scalar)

    def physical(self) -> list[str]:
        """Every column that is still of use."""
        shown = [p for _, p, _ in self.columns + self.output_only] + [p for p, _ in self.names.values()]
        hidden = [k for _, k in self.nodes.values()] + [p for p, _ in self.order] + [*self.classes.values(), *self.scores.values(), *self.domain]
        return list(dict.fromkeys(shown + hidden))

    def sort_keys(self) -> list[Column]:
        return [F.col(f"`{p}`").desc_nulls_last() if d else F.col(f"`{p}`").asc_nulls_first() for p, d in self.order]


class Lowering:
    """Lowers one plan against a catalog's snapshot."""

    def __init__(self, catalog, spark):
        self.catalog, self.spark = catalog, spark
        self.serial = itertools.count()
        self.medians: set[str] = set()
        self.made: dict[int, Frame] = {}  # inputs that are lowered already

    def name(self, hint: str) -> str:
        return f"{''.join(c if c.isalnum() else '_' for c in hint)}__{next(self.serial)}"

    # -- entry points

    def result(self, plan: dict, ordered: bool = True) -> DataFrame:
        """The plan's rows under their labels, in order if asked for."""
        f = self.lower(plan)
        df = f.df.orderBy(*f.sort_keys()) if ordered and f.order else f.df
        return df.select(*(F.col(f"`{p}`").alias(label) for label, p, _ in f.columns + f.output_only))

    def scalar(self, plan: dict, outer: X.Scope) -> tuple[Column, Type]:
        """A scalar query: null for no row, an error for two or more."""
        inner = self.lower(plan, outer)
        if len(inner.columns) + len(inner.output_only) != 1:
            raise InvalidArgument(f"a scalar query has one column, not {len(inner.columns) + len(inner.output_only)}")
        _, physical, kind = inner.columns[0]
        return inner.df.select(f"`{physical}`").scalar(), kind

    def lower(self, plan: dict, outer: X.Scope | None = None) -> Frame:
        if id(plan) in self.made:
            return self.made[id(plan)]
        fn = getattr(self, f"_{plan.get('op')}", None)
        if fn is None:
            raise InvalidArgument(f"unknown operator {plan.get('op')}")
        return fn(plan, outer)

    # -- scalar queries that group inside, which Catalyst does not decorrelate

    def _hoisted(self, f: Frame, e, outer: X.Scope | None):
        """``f`` with a column for each such query in an expression, and the expression that reads them."""
        if outer is not None or "scalar" not in str(e):
            return f, e
        if isinstance(e, list):
            out = []
            for x in e:
                f, x = self._hoisted(f, x, outer)
                out.append(x)
            return f, out
        if not isinstance(e, dict):
            return f, e
        if "scalar" in e:
            plan = e["scalar"]["plan"]
            refs = self._outer_refs(f, plan)
            if not refs or not _groups_inside(plan):
                return f, e
            return self._joined_scalar(f, plan, refs)
        out = {}
        for k, x in e.items():
            f, out[k] = self._hoisted(f, x, outer)
        return f, out

    @staticmethod
    def _outer_refs(f: Frame, plan: dict) -> dict[str, tuple[str, Type]]:
        """Columns of ``f`` that the inner plan names and does not make itself."""
        known = f.names | {fold(label): (p, t) for label, p, t in f.columns}
        own = {fold(b) for b in bindings_of(plan)}
        return {k: known[k] for k in map(fold, _names(plan)) if k in known and k.split(".")[0] not in own}

    def _joined_scalar(self, f: Frame, plan: dict, refs: dict[str, tuple[str, Type]]):
        """The query for all different outer values at once, joined back to the rows."""
        here = {k: (self.name("outer"), t) for k, (_, t) in refs.items()}
        domain = f.df.select(*(F.col(f"`{refs[k][0]}`").alias(p) for k, (p, _) in here.items())).distinct()
        inner = self._in_domain(plan, X.Scope(here, joined=True, lower_plan=self.scalar), domain, [p for p, _ in here.values()])
        if len(inner.columns) + len(inner.output_only) != 1:
            raise InvalidArgument(f"a scalar query has one column, not {len(inner.columns) + len(inner.output_only)}")
        if not inner.domain:
            raise InvalidArgument("a scalar query that groups inside names outer columns in its filters only")
        _, physical, kind = inner.columns[0]
        out, back = self.name("scalar"), {p: self.name("back") for p, _ in here.values()}
        one = F.when(F.count("*") > 1, F.raise_error(F.lit("scalar subquery returned more than one row")).cast(kind.spark())).otherwise(F.first(F.col(f"`{physical}`")))
        found = inner.df.groupBy(*inner.domain).agg(one.alias(out)).withColumnsRenamed(back)
        same = [F.col(f"`{refs[k][0]}`").eqNullSafe(F.col(back[p])) for k, (p, _) in here.items()]
        df = f.df.join(found, same, "left").drop(*back.values())
        return replace(f, df=df, names=f.names | {fold(out): (out, kind)}), {"col": out}

    def _in_domain(self, plan: dict, outer: X.Scope, domain: DataFrame, keys: list[str]) -> Frame:
        """A plan's rows for every outer value, which the first filter that names one brings in."""
        op = plan.get("op")
        if op not in ("Filter", "Project", "Aggregate", "Sort"):
            return self.lower(plan)
        f = self._in_domain(plan["input"], outer, domain, keys)
        if op == "Filter" and not f.domain and any(fold(n) in outer.columns for n in _names(plan["predicate"])):
            c, t = X.lower(plan["predicate"], f.scope(self, outer))
            if t not in (BOOL, NULL):
                raise InvalidArgument(f"a filter is Bool, not {t}")
            return replace(f, df=f.df.join(domain, c.cast("boolean")), domain=keys)
        self.made[id(plan["input"])] = f
        out = getattr(self, f"_{op}")(plan, outer)
        if op == "Aggregate" and out.domain and not plan["group_by"]:  # one row for every outer value, of no rows too
            left = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in keys]
            zero = {a["as"] for a in plan["aggs"] if a["fn"] == "count"}
            shown = [(F.coalesce(F.col(f"a.`{p}`"), F.lit(0)) if label in zero else F.col(f"a.`{p}`")).alias(p) for label, p, _ in out.columns]
            out = replace(out, df=domain.alias("d").join(out.df.alias("a"), left, "left").select("d.*", *shown))
        return out

    # -- sources

    def _scan(self, table: str, binding: str) -> Frame:
        t = self.catalog.node_table(table)
        names = {c: self.name(f"{binding}_{c}") for c, _ in t.columns}
        key, at = self.name(f"pk_{binding}"), self.name("ord")
        df = t.frame(self.spark)
        df = df.select(*(F.col(f"`{c}`").alias(p) for c, p in names.items()), F.col(f"`{t.key}`").alias(key), F.col("`__ord`").alias(at))
        columns = [(f"{binding}.{c}", names[c], kind) for c, kind in t.columns]
        return Frame(df, columns, [(at, False)], {fold(binding): (t.name, key)}, bindings={fold(binding)})

    def _ScanNodes(self, plan, outer) -> Frame:
        return self._scan(plan["table"], plan["binding"])

    def _ScanInterface(self, plan, outer) -> Frame:
        face = self.catalog.interface(plan["interface"])
        b = plan["binding"]
        names = [(c, self.name(f"{b}_{c}"), kind) for c, kind in face.columns]
        cls, at, nth = self.name("class"), self.name("ord"), self.name("nth")
        parts = []
        for i, t in enumerate(self.catalog.implementers(face.name)):
            own = {fold(c): c for c, _ in t.columns}
            picked = [F.col(f"`{own[fold(c)]}`").cast(kind.spark()).alias(p) for c, p, kind in names]
            parts.append(t.frame(self.spark).select(*picked, F.lit(t.name).alias(cls), F.lit(i).alias(nth), F.col("`__ord`").alias(at)))
        if parts:
            df = parts[0]
            for more in parts[1:]:
                df = df.unionByName(more)
        else:
            fields = [f"`{p}` {kind.spark().simpleString()}" for _, p, kind in names]
            df = self.spark.createDataFrame([], ", ".join([*fields, f"`{cls}` string", f"`{nth}` int", f"`{at}` bigint"]))
        return Frame(df, [(f"{b}.{c}", p, kind) for c, p, kind in names], [(nth, False), (at, False)], classes={fold(b): cls}, bindings={fold(b)})

    def _TextScan(self, plan, outer) -> Frame:
        f = self._scan(plan["table"], plan["binding"])
        physical, kind = self._column_of(f, plan["binding"], plan["column"])
        if kind != STRING:
            raise InvalidArgument(f"textscan needs a String column, {plan['column']} is {kind}")
        if plan["k"] < 1:
            raise InvalidArgument("textscan needs k of 1 at least")
        points, score = self.name("points"), self.name("score")
        key = f.nodes[fold(plan["binding"])][1]
        df = fulltext.search(f.df, physical, plan["query"], points)
        df = df.orderBy(F.col(points).desc(), F.col(key).asc()).limit(plan["k"])
        df = df.withColumn(score, F.col(points).cast("double") / float(fulltext.ONE))
        return replace(f, df=df, order=[(points, True), (key, False)], scores={fold(plan["binding"]): score})

    def _column_of(self, f: Frame, binding: str, column: str) -> tuple[str, Type]:
        for label, p, kind in f.columns:
            if fold(label) == fold(f"{binding}.{column}"):
                return p, kind
        raise InvalidArgument(f"unknown column {binding}.{column}{suggestion(column, [c[0].split('.', 1)[1] for c in f.columns])}")

    def _KnnScan(self, plan, outer) -> Frame:
        f = self._scan(plan["table"], plan["table"])
        physical, kind = self._column_of(f, plan["table"], plan["column"])
        if kind.kind != "Vector":
            raise InvalidArgument(f"knn needs a Vector column, {plan['column']} is {kind}")
        q = plan["query"]
        if isinstance(q, list):
            if kind.a and len(q) != kind.a:
                raise InvalidArgument(f"the query has {len(q)} elements, the column is {kind}")
            query = X.literal_column(q)
            df = f.df.withColumn("__q", query)
        else:
            inner = Lowering(self.catalog, self.spark)
            inner.serial = self.serial
            sub = inner.lower(q["scalar"]["plan"])
            if len(sub.columns) != 1 or sub.columns[0][2].kind != "Vector" or kind.a and sub.columns[0][2].a not in (None, kind.a):
                raise InvalidArgument(f"a knn query gives one {kind}, not {', '.join(str(c[2]) for c in sub.columns)}")
            found = sub.df.select(f"`{sub.columns[0][1]}`").scalar()  # run once, then a literal
            none = F.raise_error(F.lit("knn query vector is null")).cast("array<float>")
            df = f.df.withColumn("__q", F.coalesce(found, none))
        away = self.name("distance")
        at = f.order[0][0]
        df = df.where(F.col(f"`{physical}`").isNotNull()).withColumn(away, vectors.distance(F.col(f"`{physical}`"), F.col("__q"), plan["metric"], strict=False)).drop("__q")
        df = df.orderBy(F.col(away).asc(), F.col(at).asc()).limit(plan["k"])
        return replace(f, df=df, order=[(away, False), (at, False)], output_only=[("distance", away, FLOAT64)])

    def _WithinScan(self, plan, outer) -> Frame:
        f = self._scan(plan["table"], plan["table"])
        physical, kind = self._column_of(f, plan["table"], plan["column"])
        if kind.kind != "GeoPoint":
            raise InvalidArgument(f"within needs a GeoPoint column, {plan['column']} is {kind}")
        meters = X.finite(float(plan["meters"]))
        if meters <= 0:
            raise InvalidArgument("within needs a radius over 0")
        c = plan["center"]
        return replace(f, df=f.df.where(geo.within(F.col(f"`{physical}`"), c["lat_deg"], c["lng_deg"], meters)))

    # -- traversal

    def _Expand(self, plan, outer) -> Frame:
        return self._expand(plan, outer, None)

    def _ExpandRel(self, plan, outer) -> Frame:
        return self._expand(plan, outer, plan["rel_binding"])

    def _expand(self, plan, outer, rel_binding: str | None) -> Frame:
        f = self.lower(plan["input"], outer)
        start, b = fold(plan["from_binding"]), plan["binding"]
        if start not in f.nodes:
            raise InvalidArgument(f"{plan['from_binding']} is not bound to nodes{suggestion(plan['from_binding'], f.nodes)}")
        introduced = [fold(b)] + ([fold(rel_binding)] if rel_binding else [])
        self._unbound(f, introduced)
        table, key = f.nodes[start]
        rel = self.catalog.rel_table(plan["rel"])
        here, source, target = fold(table), fold(rel.source), fold(rel.target)
        direction = plan["direction"]
        if direction == "both" and source != target:
            if here not in (source, target):
                raise InvalidArgument(f"{rel.name} doesn't touch {table}")
            direction = "out" if here == source else "in"
        if direction == "out" and here != source or direction == "in" and here != target:
            raise InvalidArgument(f"{rel.name} goes from {rel.source} to {rel.target}, not {direction} of {table}")
        near, far, leg, at = (self.name(x) for x in ("near", "far", "leg", "edge"))
        props = [(c, self.name(f"{rel_binding}_{c}"), kind) for c, kind in rel.columns] if rel_binding else []
        edges = rel.frame(self.spark)

        def way(a: str, z: str, n: int) -> DataFrame:
            return edges.select(F.col(f"`{a}`").alias(near), F.col(f"`{z}`").alias(far), F.lit(n).alias(leg), F.col("`__ord`").alias(at), *(F.col(f"`{c}`").alias(p) for c, p, _ in props))

        if direction == "out":
            e = way("__from", "__to", 0)
        elif direction == "in":
            e = way("__to", "__from", 0)
        else:  # a self-loop once, on the out side
            e = way("__from", "__to", 0).union(way("__to", "__from", 1).where(F.col(f"`{near}`") != F.col(f"`{far}`")))
        other = rel.target if direction == "out" else rel.source
        n = self._scan(other, b)
        other_key = n.nodes[fold(b)][1]
        df = f.df.join(e, F.col(f"`{key}`") == F.col(f"`{near}`")).join(n.df.drop(n.order[0][0]), F.col(f"`{far}`") == F.col(f"`{other_key}`"))
        columns = f.columns + n.columns + [(f"{rel_binding}.{c}", p, kind) for c, p, kind in props]
        return replace(f, df=df.drop(near, far), columns=columns, order=f.order + [(leg, False), (at, False)], nodes=f.nodes | n.nodes, output_only=[], bindings=f.bindings | set(introduced))

    @staticmethod
    def _unbound(f: Frame, names) -> None:
        for n in names:
            if n in f.bindings:
                raise InvalidArgument(f"the binding {n} is taken")

    # -- rows

    def _Filter(self, plan, outer) -> Frame:
        f = self.lower(plan["input"], outer)
        f, predicate = self._hoisted(f, plan["predicate"], outer)
        c, t = X.lower(predicate, f.scope(self, outer))
        if t not in (BOOL, NULL):
            raise InvalidArgument(f"a filter is Bool, not {t}")
        return replace(f, df=f.df.where(c.cast("boolean")))

    def _Project(self, plan, outer) -> Frame:
        f, exprs = self._hoisted(self.lower(plan["input"], outer), plan["exprs"], outer)
        scope = f.scope(self, outer)
        columns, extra, seen, new = [], {}, set(), []
        for item in exprs:
            label = item["as"]
            if fold(label) in seen:
                raise InvalidArgument(f"two outputs are named {label}")
            seen.add(fold(label))
            c, t = X.lower(item["expr"], scope)
            if "col" in item["expr"] and fold(item["expr"]["col"]) in scope.columns:
                p = scope.columns[fold(item["expr"]["col"])][0]
                extra[fold(item["expr"]["col"])] = (p, t)
                shown = next((x for x, q, _ in f.columns if q == p), label)
                label = shown if fold(label) == fold(item["expr"]["col"]) else label
            else:
                p = self.name("x")
                new.append(c.alias(p))
            columns.append((label, p, t))
        hidden = [k for _, k in f.nodes.values()] + [p for p, _ in f.order] + [*f.classes.values(), *f.scores.values(), *f.domain]
        kept = dict.fromkeys([*hidden, *(p for p, _ in extra.values())])
        df = f.df.select(*(F.col(f"`{k}`") for k in kept), *new)
        return replace(f, df=df, columns=columns, names=extra, output_only=[])

    def _Sort(self, plan, outer) -> Frame:
        f, sorts = self._hoisted(self.lower(plan["input"], outer), plan["keys"], outer)
        scope, keys, new = f.scope(self, outer), [], []
        for k in sorts:
            c, t = X.lower(k["expr"], scope)
            if not t.ordered:
                raise InvalidArgument(f"{t} has no order")
            p = self.name("key")
            new.append((c if t != NULL else F.lit(0)).alias(p))
            keys.append((p, k["order"] == "desc"))
        return replace(f, df=f.df.select(*(F.col(f"`{p}`") for p in f.physical()), *new), order=keys + f.order)

    def _Limit(self, plan, outer) -> Frame:
        f = self.lower(plan["input"], outer)
        df = f.df.orderBy(*f.sort_keys())
        if plan.get("offset"):
            df = df.offset(plan["offset"])
        return replace(f, df=df.limit(plan["count"]))

    # -- joins

    def _HashJoin(self, plan, outer) -> Frame:
        left, right = self.lower(plan["left"], outer), self.lower(plan["right"], outer)
        shared = left.bindings & right.bindings
        if shared:
            raise InvalidArgument(f"both sides bind {', '.join(sorted(shared))}")
        if not plan["on"]:
            raise InvalidArgument("a join needs a key")
        a, b = left.scope(self, None), right.scope(self, None)
        cond = None
        for k in plan["on"]:
            if "scalar" in str(k):
                raise InvalidArgument("a join key holds no scalar query")
            (x, tx), (y, ty) = X.lower(k["left"], a), X.lower(k["right"], b)
            if tx != ty or tx == NULL:
                raise InvalidArgument(f"join keys have one type, not {tx} and {ty}")
            if tx.kind in ("Vector", "GeoPoint"):
                raise InvalidArgument(f"{print_expr(k['left'])} can't be a join key: it is {tx}")
            same = x == y
            if tx == FLOAT64:
                same = same & ~F.isnan(x)  # NaN joins nothing
            cond = same if cond is None else cond & same
        df = left.df.join(right.df, cond, "left" if plan.get("join") == "left" else "inner")
        return Frame(df, left.columns + right.columns, left.order + right.order, left.nodes | right.nodes, left.classes | right.classes, left.scores | right.scores, [], left.names | right.names, left.bindings | right.bindings)

    # -- aggregates

    def _Aggregate(self, plan, outer) -> Frame:
        f, aggs = self._hoisted(self.lower(plan["input"], outer), plan["aggs"], outer)
        if not plan["group_by"] and not plan["aggs"]:
            raise InvalidArgument("an aggregate needs a function or a group")
        scope = f.scope(self, outer)
        groups, outs, seen = [], [], set()
        keys = []
        for e in plan["group_by"]:
            c, t = X.lower(e, scope)
            if not t.ordered:
                raise InvalidArgument(f"{t} can't be a group key")
            p = self.name("g")
            keys.append(c.cast(t.spark()).alias(p))
            groups.append((print_expr(e), p, t))
        for a in aggs:
            c, t = X.lower(a["expr"], scope)
            p = self.name("agg")
            value, kind = self._aggregate(a, c, t)
            if a["fn"] == "percentile_cont":
                self.medians.add(p)
            outs.append((a["as"], p, kind, value.alias(p)))
        for label in [g[0] for g in groups] + [o[0] for o in outs]:
            if fold(label) in seen:
                raise InvalidArgument(f"two outputs are named {label}")
            seen.add(fold(label))
        medians = [(o[1], o[2], o[3]) for o in outs if isinstance(o[3], Column) and o[1] in self.medians]
        values = [o[3] for o in outs if o[1] not in self.medians] or [F.count("*").alias(self.name("n"))]
        keys += [F.col(f"`{p}`") for p in f.domain]
        df = f.df.groupBy(*keys).agg(*values) if keys else f.df.select(*values)
        for p, t, value in medians:
            df = _with_median(df, f.df, keys, [g[1] for g in groups] + f.domain, value, p, t)
        return Frame(df, groups + [(label, p, t) for label, p, t, _ in outs], [(p, False) for _, p, _ in groups], bindings=set(), domain=f.domain)

    @staticmethod
    def _aggregate(a: dict, c: Column, t: Type) -> tuple[Column, Type]:
        fn = a["fn"]
        if fn == "count":
            return F.count(c), INT64
        if fn in ("min", "max"):
            if not t.ordered:
                raise InvalidArgument(f"{fn} of {t}")
            return (F.min if fn == "min" else F.max)(c), t
        if fn == "percentile_cont":
            if t.kind != "Decimal":
                raise InvalidArgument(f"percentile_cont of {t}")
            return c, t  # of all values; see _with_median
        if t == NULL:
            return F.max(c.cast("double" if fn == "avg" else "bigint")), FLOAT64 if fn == "avg" else INT64
        if not t.numeric:
            raise InvalidArgument(f"{fn} of {t}")
        if fn == "sum":
            return F.sum(c), decimal(min(38, t.a + 10), t.b) if t.kind == "Decimal" else t
        if t.kind == "Decimal":
            raise InvalidArgument("avg of Decimal would round")
        return (F.sum(c).cast("double") / F.count(c) if t == INT64 else F.avg(c)), FLOAT64


def _names(e) -> list[str]:
    """Every column that an expression or plan names."""
    if isinstance(e, list):
        return [n for x in e for n in _names(x)]
    if isinstance(e, dict):
        own = [e["col"]] if isinstance(e.get("col"), str) else []
        return own + [n for k, x in e.items() if k != "lit" for n in _names(x)]
    return []


def _groups_inside(plan: dict) -> bool:
    """Whether a plan of filters, projections, sorts and aggregates groups below another step."""
    chain = []
    while plan.get("op") in ("Filter", "Project", "Aggregate", "Sort"):
        chain.append(plan)
        plan = plan["input"]
    return any(p["op"] == "Aggregate" and p["group_by"] for p in chain)


def _with_median(df: DataFrame, rows: DataFrame, keys: list[Column], names: list[str], value: Column, p: str, t: Type) -> DataFrame:
    """``df``, one row a group, with the exact middle of each group's values.

    Values are counted first, so a group is as many rows as it has different
    values, and the middles are found by running counts over them in order;
    nothing is collected. An error if the mean of two middles does not fit.
    """
    v, n, upto, all_, middle = (f"{x}_{p}" for x in ("v", "n", "upto", "all", "middle"))
    counted = rows.select(*keys, value.alias(v)).where(F.col(f"`{v}`").isNotNull()).groupBy(*names, v).agg(F.count("*").alias(n))
    of = Window.partitionBy(*(names or [F.lit(0)]))
    ranked = counted.withColumn(upto, F.sum(n).over(of.orderBy(v))).withColumn(all_, F.sum(n).over(of))
    first, last = F.floor((F.col(all_) + 1) / 2), F.floor(F.col(all_) / 2) + 1

    def at(rank):
        return F.max(F.when((F.col(upto) >= rank) & (F.col(upto) - F.col(n) < rank), F.col(v)))

    total = (at(first) + at(last)).cast(f"decimal(38,{t.b})")
    half = F.round(total * F.lit(0.5).cast("decimal(2,1)"), t.b + 1 if t.b < 37 else 37)
    exact = half.cast(t.spark())
    checked = F.when(half.isNull() | (exact == half), exact).otherwise(F.raise_error(F.lit(f"the median doesn't fit {t}")).cast(t.spark()))
    found = ranked.groupBy(*names).agg(checked.alias(middle)) if names else ranked.agg(checked.alias(middle))
    if not names:
        return df.crossJoin(found).withColumnRenamed(middle, p)  # one row and one row
    other = [f"{k}_{middle}" for k in names]
    found = found.select(*(F.col(k).alias(o) for k, o in zip(names, other)), middle)
    return df.join(found, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(names, other)], "left").drop(*other).withColumnRenamed(middle, p)
