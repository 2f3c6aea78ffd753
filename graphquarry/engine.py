"""The engine: queries, statements, transactions and versions.

A version is an immutable ``Catalog``. A transaction works on its own copy and
publishes it as a whole; the first of two that touch the same key or name wins.
With a path, a commit writes the rows that were added to a table as one more
Parquet folder, or the whole table as a new one where rows were changed or
deleted, and then one new catalog file, so readers never see half a commit.
"""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.errors import InvalidArgument, NotFound, TransactionConflict
from graphquarry.functions import expressions as X
from graphquarry.operators.lower import Lowering
from graphquarry.plans import text as P
from graphquarry.sources import load
from graphquarry.sources.catalog import Catalog, Interface, NodeTable, RelTable
from graphquarry.types import INT64, STRING, Type, fold, parse_type, suggestion

NODE_CLAUSES = ("display", "plural", "label", "summary", "color", "description", "implements")
REL_CLAUSES = ("display", "color", "description", "verb", "inverse")


def configure(spark: SparkSession) -> None:
    """Session settings that plans rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", "false")


def _value(v, kind: Type, what: str):
    """A literal checked against a column's type, as a Python value."""
    got = X.literal_type(v)
    if got.kind == "Null":
        return None
    if kind.kind == "Float64" and got == INT64:
        v, got = float(v), kind
    if kind.kind == "Decimal" and got.kind == "Decimal" and got.b <= kind.b and got.a - got.b <= kind.a - kind.b:
        got = kind
    if kind.kind == "Vector" and got.kind == "Vector" and got.a == kind.a:
        got = kind
    if got != kind:
        raise InvalidArgument(f"{what}: {got} is not {kind}")
    if kind.kind == "Float64":
        X.finite(v)
    return X.literal_value(v, kind)


class Snapshot:
    """Reads of one version."""

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    def parse(self, text: str) -> dict:
        return P.parse_query(text, self.catalog.is_interface)

    def plan(self, plan: dict | str, ordered: bool = True) -> DataFrame:
        plan = P.from_json(plan) if isinstance(plan, str) else plan
        return Lowering(self.catalog, self.spark).result(plan, ordered)

    def query(self, text: str, ordered: bool = True) -> DataFrame:
        return self.plan(self.parse(text), ordered)

    def explain(self, text: str) -> str:
        """Canonical text of a query, and Spark's plan for it."""
        df = self.query(text)
        return P.print_plan(self.parse(text)) + "\n" + df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def run_pin(self, name: str) -> DataFrame:
        pin = self.catalog.pins.get(fold(name))
        if pin is None:
            raise NotFound(f"no pin named {name}{suggestion(name, [p['name'] for p in self.catalog.pins.values()])}")
        return self.plan(pin["plan"]["plan"])

    def schema(self) -> dict:
        return self.catalog.summary()

    def neighborhood(self, table: str, key, limit: int = 500) -> DataFrame:
        """The rows around one node: rel, direction, table and key of each neighbour."""
        t = self.catalog.node_table(table)
        parts = []
        for r in self.catalog.rels.values():
            e = r.frame(self.spark)
            for here, there, a, b, way in ((r.source, r.target, "__from", "__to", "out"), (r.target, r.source, "__to", "__from", "in")):
                if fold(here) == fold(t.name):
                    parts.append(e.where(F.col(a) == F.lit(key)).select(F.lit(r.name).alias("rel"), F.lit(way).alias("direction"), F.lit(there).alias("table"), F.col(b).cast("string").alias("key")))
        if not parts:
            return self.spark.createDataFrame([], "rel string, direction string, `table` string, key string")
        return reduce(DataFrame.union, parts).distinct().orderBy("rel", "direction", "table", "key").limit(limit)


class Transaction(Snapshot):
    """Statements on a private version, published by ``commit``."""

    def __init__(self, engine: "Engine"):
        super().__init__(engine.spark, engine.catalog)
        self.engine, self.base = engine, engine.catalog
        self.touched: set[tuple] = set()  # (table, key) or (name,)
        self.open = True

    def execute(self, statement: str | dict) -> None:
        if not self.open:
            raise InvalidArgument("the transaction is over")
        s = P.parse_statement(statement, self.catalog.is_interface) if isinstance(statement, str) else statement
        fn = getattr(self, f"_{s.get('stmt')}", None)
        if fn is None:
            raise InvalidArgument(f"unknown statement {s.get('stmt')}")
        fn(s)

    def commit(self) -> None:
        if self.open:
            self.open = False
            self.engine._publish(self)

    def rollback(self) -> None:
        self.open = False

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.rollback() if kind else self.commit()

    # -- schema

    def _new_name(self, name: str) -> None:
        if not name:
            raise InvalidArgument("a name is empty")
        if self.catalog.taken(name):
            raise InvalidArgument(f"the name {name} is taken")
        self.touched.add((fold(name),))

    @staticmethod
    def _columns(columns) -> tuple[tuple[str, Type], ...]:
        out = tuple((c["name"], parse_type(c["type"])) for c in columns)
        if len({fold(n) for n, _ in out}) != len(out):
            raise InvalidArgument("two columns have one name")
        return out

    @staticmethod
    def _empty(columns, edge: bool = False, key: Type = INT64, other: Type = INT64):
        ends = [T.StructField("__from", key.spark()), T.StructField("__to", other.spark())] if edge else []
        schema = T.StructType([*ends, *(T.StructField(n, k.spark()) for n, k in columns), T.StructField("__ord", T.LongType())])
        return lambda spark: spark.createDataFrame([], schema)

    def _CreateNodeTable(self, s) -> None:
        self._new_name(s["name"])
        columns = self._columns(s["columns"])
        keys = [c["name"] for c in s["columns"] if c.get("primary_key")]
        if len(keys) != 1:
            raise InvalidArgument("a node table has exactly one primary key")
        if dict(columns)[keys[0]] not in (INT64, STRING):
            raise InvalidArgument("a primary key is Int64 or String")
        self.catalog = self.catalog.with_("nodes", s["name"], NodeTable(s["name"], columns, keys[0], self._empty(columns)))

    def _CreateRelTable(self, s) -> None:
        self._new_name(s["name"])
        a, b = self.catalog.node_table(s["from"]), self.catalog.node_table(s["to"])
        columns = self._columns(s["columns"])
        for n, k in columns:
            if k.kind not in ("Bool", "Int64", "Float64", "String", "Vector"):
                raise InvalidArgument(f"a relationship's column can't be {k}: {n}")
        empty = self._empty(columns, True, dict(a.columns)[a.key], dict(b.columns)[b.key])
        self.catalog = self.catalog.with_("rels", s["name"], RelTable(s["name"], a.name, b.name, columns, empty))

    def _CreateInterface(self, s) -> None:
        self._new_name(s["name"])
        self.catalog = self.catalog.with_("interfaces", s["name"], Interface(s["name"], self._columns(s["columns"])))

    def _CreateClass(self, s) -> None:
        name = s["table"]
        is_node = fold(name) in self.catalog.nodes
        t = self.catalog.node_table(name) if is_node else self.catalog.rel_table(name)
        clauses = {k: v for k, v in s.items() if k not in ("stmt", "table")}
        allowed = NODE_CLAUSES if is_node else REL_CLAUSES
        for k in clauses:
            if k not in allowed:
                raise InvalidArgument(f"a class for {t.name} has no clause {k}")
        if fold(name) in self.catalog.classes:
            raise InvalidArgument(f"{t.name} has a class")
        known = {fold(n): k for n, k in t.columns}
        for c in [*clauses.get("summary", ()), *([clauses["label"]] if "label" in clauses else [])]:
            if fold(c) not in known:
                raise InvalidArgument(f"unknown column {c}{suggestion(c, [n for n, _ in t.columns])}")
        for i in clauses.get("implements", ()):
            for n, k in self.catalog.interface(i).columns:
                if known.get(fold(n)) != k:
                    raise InvalidArgument(f"{t.name} doesn't implement {i}: it needs {n} {k}")
        self.touched.add((fold(name), "class"))
        self.catalog = self.catalog.with_("classes", name, clauses)

    def _CreateHnswIndex(self, s) -> None:
        t = self.catalog.node_table(s["table"])
        kind = {fold(n): k for n, k in t.columns}.get(fold(s["column"]))
        if kind is None or kind.kind != "Vector":
            raise InvalidArgument(f"an index is on a Vector column, {s['column']} is {kind}")
        if any(fold(i["table"]) == fold(t.name) and fold(i["column"]) == fold(s["column"]) for i in self.catalog.indexes.values()):
            raise InvalidArgument(f"{t.name}.{s['column']} has an index")
        self.touched.add((fold(s["name"]), "index"))
        self.catalog = self.catalog.with_("indexes", s["name"], {k: v for k, v in s.items() if k != "stmt"})

    def _PinPlan(self, s) -> None:
        self.plan(s["plan"]["plan"])  # must be valid
        self.touched.add((s["name"], "pin"))
        self.catalog = self.catalog.with_("pins", s["name"], {k: v for k, v in s.items() if k != "stmt"})

    def _UnpinPlan(self, s) -> None:
        self.touched.add((s["name"], "pin"))
        self.catalog = self.catalog.without("pins", s["name"])

    # -- rows

    def _rows(self, t: NodeTable, rows) -> list[tuple]:
        out = []
        for r in rows:
            if len(r) != len(t.columns):
                raise InvalidArgument(f"{t.name} has {len(t.columns)} columns, not {len(r)}")
            row = tuple(_value(v, k, f"{t.name}.{n}") for v, (n, k) in zip(r, t.columns))
            if row[[n for n, _ in t.columns].index(t.key)] is None:
                raise InvalidArgument(f"{t.name}.{t.key} can't be null")
            out.append(row)
        return out

    def _made(self, columns, rows) -> DataFrame:
        schema = T.StructType([T.StructField(n, k.spark()) for n, k in columns])
        return self.spark.createDataFrame(rows, schema)

    def _keys(self, t: NodeTable, keys) -> set:
        """Which of some keys the table has."""
        kind = dict(t.columns)[t.key]
        found = t.frame(self.spark).select(F.col(f"`{t.key}`").alias("k")).join(F.broadcast(self._made([("k", kind)], [(k,) for k in keys])), "k", "left_semi")
        return {r[0] for r in found.distinct().collect()}  # at most as many as were given

    def _put(self, kind: str, t, df: DataFrame, next_ord: int, new: DataFrame | None = None) -> None:
        """``df`` as the table's rows; ``new`` if they are those before and these."""
        added = None if new is None or t.added is None else (*t.added, new)
        self.catalog = self.catalog.with_(kind, t.name, replace(t, frame=lambda spark: df, next_ord=next_ord, added=added))

    def _InsertNode(self, s) -> None:
        t = self.catalog.node_table(s["table"])
        rows = self._rows(t, s["rows"])
        at = [n for n, _ in t.columns].index(t.key)
        keys = [r[at] for r in rows]
        if len(set(keys)) != len(keys):
            raise InvalidArgument("a key is repeated")
        if there := self._keys(t, keys):
            raise InvalidArgument(f"{t.name} has the key {sorted(there)[0]!r}")
        self.touched |= {(fold(t.name), k) for k in keys}
        new = self._made([*t.columns, ("__ord", INT64)], [(*r, t.next_ord + i) for i, r in enumerate(rows)])
        self._put("nodes", t, t.frame(self.spark).unionByName(new), t.next_ord + len(rows), new)

    def _UpsertNode(self, s) -> None:
        t = self.catalog.node_table(s["table"])
        at = [n for n, _ in t.columns].index(t.key)
        rows = list({r[at]: r for r in self._rows(t, s["rows"])}.values())  # a repeated key keeps its last row
        self.touched |= {(fold(t.name), r[at]) for r in rows}
        old = t.frame(self.spark)
        new = self._made([*t.columns, ("__new", INT64)], [(*r, t.next_ord + i) for i, r in enumerate(rows)])
        kept = old.select(F.col(f"`{t.key}`").alias("__k"), "__ord").join(F.broadcast(new.select(F.col(f"`{t.key}`").alias("__k"))), "__k", "left_semi")
        placed = new.join(kept, F.col(f"`{t.key}`") == F.col("__k"), "left").select(*(f"`{n}`" for n, _ in t.columns), F.coalesce("__ord", "__new").alias("__ord"))
        rest = old.join(F.broadcast(new.select(F.col(f"`{t.key}`").alias("__k"))), F.col(f"`{t.key}`") == F.col("__k"), "left_anti")
        self._put("nodes", t, rest.unionByName(placed), t.next_ord + len(rows))

    def _addressed(self, s) -> tuple[NodeTable, object]:
        t = self.catalog.node_table(s["table"])
        if fold(s["key_column"]) != fold(t.key):
            raise InvalidArgument(f"{t.name} is addressed by {t.key}")
        k = _value(s["key"], dict(t.columns)[t.key], f"{t.name}.{t.key}")
        if k is None or not self._keys(t, [k]):
            raise NotFound(f"{t.name} has no key {k!r}")
        self.touched.add((fold(t.name), k))
        return t, k

    def _UpdateNode(self, s) -> None:
        t, k = self._addressed(s)
        known, df = {fold(n): (n, kind) for n, kind in t.columns}, t.frame(self.spark)
        for a in s["set"]:
            if fold(a["column"]) not in known:
                raise InvalidArgument(f"unknown column {a['column']}{suggestion(a['column'], [n for n, _ in t.columns])}")
            n, kind = known[fold(a["column"])]
            if n == t.key:
                raise InvalidArgument("a primary key can't be set")
            _value(a["value"], kind, f"{t.name}.{n}")
            df = df.withColumn(n, F.when(F.col(f"`{t.key}`") == F.lit(k), X.literal_column(a["value"]).cast(kind.spark())).otherwise(F.col(f"`{n}`")))
        self._put("nodes", t, df, t.next_ord)

    def _DeleteNode(self, s) -> None:
        t = self.catalog.node_table(s["table"])
        for r in self.catalog.rels.values():
            if fold(t.name) in (fold(r.source), fold(r.target)):
                raise InvalidArgument(f"{r.name} names {t.name}: use detach delete")
        t, k = self._addressed(s)
        self._put("nodes", t, t.frame(self.spark).where(F.col(f"`{t.key}`") != F.lit(k)), t.next_ord)

    def _DetachDeleteNode(self, s) -> None:
        t, k = self._addressed(s)
        for r in list(self.catalog.rels.values()):
            gone = F.lit(False)
            for end, c in ((r.source, "__from"), (r.target, "__to")):
                if fold(end) == fold(t.name):
                    gone = gone | (F.col(c) == F.lit(k))
            self._put("rels", r, r.frame(self.spark).where(~gone), r.next_ord)
        self._put("nodes", t, t.frame(self.spark).where(F.col(f"`{t.key}`") != F.lit(k)), t.next_ord)

    def _InsertRel(self, s) -> None:
        r = self.catalog.rel_table(s["table"])
        a, b = self.catalog.node_table(r.source), self.catalog.node_table(r.target)
        ka, kb = dict(a.columns)[a.key], dict(b.columns)[b.key]
        rows = []
        for i, e in enumerate(s["rows"]):
            if len(e["values"]) != len(r.columns):
                raise InvalidArgument(f"{r.name} has {len(r.columns)} columns, not {len(e['values'])}")
            rows.append((_value(e["from_key"], ka, "from"), _value(e["to_key"], kb, "to"), *(_value(v, k, f"{r.name}.{n}") for v, (n, k) in zip(e["values"], r.columns)), r.next_ord + i))
        for t, keys in ((a, {x[0] for x in rows}), (b, {x[1] for x in rows})):
            if missing := keys - self._keys(t, keys):
                raise NotFound(f"{t.name} has no key {sorted(missing, key=str)[0]!r}")
            self.touched |= {(fold(t.name), k, "edge") for k in keys}
        new = self._made([("__from", ka), ("__to", kb), *r.columns, ("__ord", INT64)], rows)
        self._put("rels", r, r.frame(self.spark).unionByName(new), r.next_ord + len(rows), new)

    def _CopyNode(self, s) -> None:
        if fold(s["table"]) in self.catalog.rels:
            return self._copy_rel(s)
        t = self.catalog.node_table(s["table"])
        df, key = load.read(self.spark, s["path"], list(t.columns)), f"`{t.key}`"
        bad = df.groupBy(key).count().where(f"{key} is null or count > 1").limit(1).collect()
        if bad:
            raise InvalidArgument(f"{s['path']}: the key {bad[0][0]!r} is {'missing' if bad[0][0] is None else 'repeated'}")
        if df.join(t.frame(self.spark).select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_semi").limit(1).count():
            raise InvalidArgument(f"{s['path']}: a key is in {t.name}")
        self._append("nodes", t, df, s.get("sort_by"))

    def _copy_rel(self, s) -> None:
        r = self.catalog.rel_table(s["table"])
        if s.get("sort_by"):
            raise InvalidArgument("a relationship table isn't sorted on load")
        a, b = self.catalog.node_table(r.source), self.catalog.node_table(r.target)
        df = load.read(self.spark, s["path"], [("from", dict(a.columns)[a.key]), ("to", dict(b.columns)[b.key]), *r.columns])
        for t, c in ((a, "from"), (b, "to")):
            lost = df.join(t.frame(self.spark).select(F.col(f"`{t.key}`").alias("__k")), F.col(f"`{c}`") == F.col("__k"), "left_anti").limit(1).collect()
            if lost:
                raise NotFound(f"{s['path']}: {t.name} has no key {lost[0][c]!r}")
        self._append("rels", r, df.withColumnsRenamed({"from": "__from", "to": "__to"}), None)

    def _append(self, kind: str, t, df: DataFrame, sort_by: str | None) -> None:
        """Rows in file order, or sorted; ordinals rise in that order without one global task."""
        if sort_by:
            known = {fold(n): (n, k) for n, k in t.columns}
            if fold(sort_by) not in known or known[fold(sort_by)][1].kind not in ("Int64", "Float64", "GeoPoint"):
                raise InvalidArgument(f"{t.name} can't be sorted by {sort_by} on load")
            c = F.col(f"`{known[fold(sort_by)][0]}`")
            df = df.withColumn("__f", F.monotonically_increasing_id()).orderBy(c.asc_nulls_last(), "__f").drop("__f")
        df = df.withColumn("__ord", F.monotonically_increasing_id() + t.next_ord)
        self.touched.add((fold(t.name),))
        self._put(kind, t, t.frame(self.spark).unionByName(df), t.next_ord + (df.rdd.getNumPartitions() << 33), df)


class Engine(Snapshot):
    """A database: in memory, or in a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str | None = None, catalog: Catalog | None = None):
        configure(spark)
        super().__init__(spark, catalog or Catalog())
        self.path, self.paths, self.generation = path, {}, 0
        self.log: list[tuple[int, set]] = []
        if path:
            self._open()

    # -- storage

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _open(self) -> None:
        fs, make = self._fs()
        if fs.exists(make(self.path)):
            names = [f.getPath().getName() for f in fs.listStatus(make(self.path))]
            versions = sorted(int(n.split(".")[1]) for n in names if n.startswith("catalog.") and n.endswith(".json"))
            if versions:
                self.generation = versions[-1]
                text = self.spark.read.text(f"{self.path}/catalog.{self.generation}.json", wholetext=True).first()[0]
                self.catalog, self.paths = Catalog.from_json(text)

    def _publish(self, tx: Transaction) -> None:
        for generation, touched in self.log:
            if generation > getattr(tx, "generation", self.generation) and self._clash(touched, tx.touched):
                raise TransactionConflict("another transaction touched the same key or name first")
        catalog = tx.catalog
        if self.catalog is not tx.base:  # others committed since: their untouched tables stay
            catalog = self._merged(tx)
        self.generation += 1
        if self.path:
            catalog = self._write(catalog)
        self.log.append((self.generation, tx.touched))
        self.catalog = catalog

    @staticmethod
    def _clash(a: set, b: set) -> bool:
        if a & b:
            return True
        whole = {x[0] for x in a if len(x) == 1} & {x[0] for x in b} | {x[0] for x in b if len(x) == 1} & {x[0] for x in a}
        edges = {x[:2] for x in a if len(x) == 3} & {x for x in b if len(x) == 2} | {x[:2] for x in b if len(x) == 3} & {x for x in a if len(x) == 2}
        return bool(whole | edges)

    def _merged(self, tx: Transaction) -> Catalog:
        out = self.catalog
        for kind in ("nodes", "rels", "interfaces", "classes", "indexes", "pins"):
            mine, base, now = getattr(tx.catalog, kind), getattr(tx.base, kind), dict(getattr(out, kind))
            for k, v in mine.items():
                if base.get(k) is not v:
                    if kind in ("nodes", "rels") and k in base and now.get(k) is not base[k]:
                        raise TransactionConflict(f"another transaction wrote to {v.name} first")
                    now[k] = v
            for k in base.keys() - mine.keys():
                now.pop(k, None)
            out = replace(out, **{kind: now})
        return out

    def _write(self, catalog: Catalog) -> Catalog:
        paths = dict(self.paths)
        for kind in ("nodes", "rels"):
            for k, t in getattr(catalog, kind).items():
                if getattr(self.catalog, kind).get(k) is not t:
                    folder = f"{self.path}/{k}.{self.generation}"
                    whole = t.added is None or k not in paths
                    rows = t.frame(self.spark) if whole else reduce(DataFrame.unionByName, t.added) if t.added else None
                    if rows is not None:
                        rows.write.parquet(folder)
                        paths[k] = [folder] if whole else [*paths[k], folder]
                    catalog = catalog.with_(kind, t.name, replace(t, frame=lambda spark, p=tuple(paths[k]): spark.read.parquet(*p), added=()))
        fs, make = self._fs()
        draft, final = make(f"{self.path}/draft.{self.generation}"), make(f"{self.path}/catalog.{self.generation}.json")
        out = fs.create(draft, True)
        out.write(bytearray(catalog.to_json(paths).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise TransactionConflict("another writer published this version first")
        self.paths = paths
        return catalog

    # -- use

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "Engine":
        """A new database in a folder that holds none."""
        out = cls(spark, path)
        if out.generation:
            raise InvalidArgument(f"{path} holds a database")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Engine":
        """The database in a folder."""
        out = cls(spark, path)
        if not out.generation:
            raise NotFound(f"{path} holds no database")
        return out

    def checkpoint(self) -> int:
        """The version that readers see; every commit is one."""
        return self.generation

    def compact(self) -> int:
        """One folder for each table again, as a new version; how many tables had more."""
        with self.begin() as tx:
            for kind in ("nodes", "rels"):
                for k, t in getattr(self.catalog, kind).items():
                    if len(self.paths.get(k, ())) > 1:
                        tx.touched.add((k,))
                        tx.catalog = tx.catalog.with_(kind, t.name, replace(t, added=None))
        return sum((k,) in tx.touched for k in self.paths)

    def close(self) -> None:
        """Forget the tables; what was committed stays in the folder."""
        self.catalog, self.log = Catalog(), []

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.catalog)

    def begin(self) -> Transaction:
        tx = Transaction(self)
        tx.generation = self.generation
        return tx

    def execute(self, statement: str | dict) -> None:
        """One statement in a transaction of its own."""
        with self.begin() as tx:
            tx.execute(statement)

    def run(self, text: str):
        """A query's rows, or None for a statement."""
        return self.execute(text) if P.is_statement(text) else self.query(text)

    def ask(self, question: str, reference_date=None) -> DataFrame:
        from graphquarry.english import Ground, compile_question

        return self.query(compile_question(question, self.catalog, reference_date, Ground(self.spark, self.catalog)))

    def pin(self, name: str, query: str) -> None:
        self.execute({"stmt": "PinPlan", "name": name, "text": query, "plan": {"v": 0, "plan": self.parse(query)}})

    def unpin(self, name: str) -> None:
        self.execute({"stmt": "UnpinPlan", "name": name})

    def stats(self) -> dict[str, int]:
        """Rows of every table."""
        return {t.name: t.frame(self.spark).count() for t in [*self.catalog.nodes.values(), *self.catalog.rels.values()]}

    def dump(self):
        """Statements that rebuild the database, one at a time."""
        for t in self.catalog.nodes.values():
            cols = ", ".join(f"{P.quote_name(n)} {k}{' primary key' if n == t.key else ''}" for n, k in t.columns)
            yield f"create node table {P.quote_name(t.name)} ({cols})"
        for r in self.catalog.rels.values():
            cols = f" ({', '.join(f'{P.quote_name(n)} {k}' for n, k in r.columns)})" if r.columns else ""
            yield f"create rel table {P.quote_name(r.name)} from {P.quote_name(r.source)} to {P.quote_name(r.target)}{cols}"
        for i in self.catalog.interfaces.values():
            yield f"create interface {P.quote_name(i.name)} ({', '.join(f'{P.quote_name(n)} {k}' for n, k in i.columns)})"
        for k, c in self.catalog.classes.items():
            name = (self.catalog.nodes | self.catalog.rels)[k].name
            parts = []
            for clause, v in c.items():
                shown = f"({', '.join(map(P.quote_name, v))})" if isinstance(v, (list, tuple)) else P.quote_name(v) if clause == "label" else P.quote_string(v)
                parts.append(f"{clause} {shown}")
            yield f"create class for {P.quote_name(name)} ({', '.join(parts)})"
        for t in self.catalog.nodes.values():
            for row in t.frame(self.spark).orderBy(f"`{t.key}`").toLocalIterator():
                yield f"insert into {P.quote_name(t.name)} values ({', '.join(_literal(row[n], k) for n, k in t.columns)})"
        for r in self.catalog.rels.values():
            for row in r.frame(self.spark).orderBy("__ord").toLocalIterator():
                values = "".join(", " + _literal(row[n], k) for n, k in r.columns)
                yield f"insert rel into {P.quote_name(r.name)} values ({P.print_literal(row['__from'])} -> {P.print_literal(row['__to'])}{values})"


def _literal(v, kind: Type) -> str:
    if v is None:
        return "null"
    if kind.kind == "Timestamp":
        return P.print_literal({"timestamp": v.isoformat()})
    if kind.kind == "Decimal":
        return P.print_literal({"decimal": f"{v:f}"})
    if kind.kind == "Bytes":
        import base64

        return P.print_literal({"bytes": base64.b64encode(v).decode()})
    if kind.kind == "Json":
        return P.print_literal({"json": json.dumps(json.loads(v), separators=(",", ":"), ensure_ascii=False)})
    if kind.kind == "GeoPoint":
        return P.print_literal({"geo": v.asDict()})
    return P.print_literal(list(v) if kind.kind == "Vector" else v)
