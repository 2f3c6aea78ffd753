"""Registered queries that run statements first: loading, changes, transactions, pins, English.

Each works on a database of its own - the star graph, or an empty one - so that
nothing outlives it, and has DuckDB SQL for the rows that it gives.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.engine import Engine
from graphquarry.english import Ground, compile_question, compile_statement
from graphquarry.plans import text as P
from graphquarry.sources.shared import scratch

SCENARIOS: dict[str, tuple[Callable[[Engine, str], DataFrame], str]] = {}


def _scenario(name: str, sql: str, empty: bool = False):
    """Register ``fn(engine, sf_dir)``; the engine holds the star graph, or nothing."""

    def add(fn):
        fn.starts_empty = empty
        SCENARIOS[name] = (fn, sql)
        return fn

    return add


def _steps(name: str, steps: list[str], query: str, sql: str, empty: bool = False) -> None:
    @_scenario(name, sql, empty)
    def run(e: Engine, sf_dir: str) -> DataFrame:
        for s in steps:
            e.execute(s.replace("{dir}", sf_dir))
        return e.query(query, ordered=False)


# --- schema and rows

_steps(
    "ddl_node_table",
    [
        "create node table City (id Int64 primary key, name String, score Float64, founded Timestamp, price Decimal(10,2), ok Bool)",
        'insert into City values (1, "Ely", 2.5, timestamp("1109-08-02T00:00:00Z"), decimal("12.50"), true), (2, "Wells", 4, null, null, false), (3, null, null, timestamp("1969-12-31T23:59:59.5Z"), decimal("0.05"), null)',
    ],
    "nodes(City) as c | project c.id as id, c.name as name, c.score as score, c.founded as founded, c.price as price, c.ok as ok",
    "SELECT * FROM (VALUES (1::BIGINT, 'Ely', 2.5::DOUBLE, TIMESTAMP '1109-08-02 00:00:00', 12.50::DECIMAL(10,2), true), (2, 'Wells', 4.0, NULL, NULL, false), (3, NULL, NULL, TIMESTAMP '1969-12-31 23:59:59.5', 0.05, NULL)) t(id, name, score, founded, price, ok)",
    True,
)
_steps(
    "ddl_rel_table",
    [
        "create rel table Borders from Region to Region (since Int64, note String)",
        'insert rel into Borders values (0 -> 2, 1869, "canal"), (2 -> 3, 1000, null), (3 -> 0, 711, "strait"), (1 -> 1, 1, "itself")',
    ],
    "nodes(Region) as r | expand_rel Borders both as s via b | project r.r_name as r, s.r_name as s, b.since as since, b.note as note",
    "WITH e(a, b, since, note) AS (VALUES (0, 2, 1869::BIGINT, 'canal'), (2, 3, 1000, NULL), (3, 0, 711, 'strait'), (1, 1, 1, 'itself')), w AS (SELECT * FROM e UNION ALL SELECT b, a, since, note FROM e WHERE a <> b) SELECT x.r_name AS r, y.r_name AS s, since, note FROM w JOIN region x ON x.r_regionkey = a JOIN region y ON y.r_regionkey = b",
)
_steps(
    "ddl_interface_class",
    [
        "create interface Priced (label String)",
        "create node table Seat (id Int64 primary key, label String)",
        "create node table Bench (id Int64 primary key, label String, long Bool)",
        'create class for Seat (display "Seat", label label, implements (Priced))',
        'create class for Bench (display "Bench", plural "Benches", implements (Priced))',
        'insert into Seat values (1, "stool"), (2, null)',
        'insert into Bench values (7, "pew", true)',
    ],
    "nodes(Priced) as p | project classof(p) as class, p.label as label",
    "SELECT * FROM (VALUES ('Seat', 'stool'), ('Seat', NULL), ('Bench', 'pew')) t(class, label)",
    True,
)
_steps("dml_insert", ['insert into Region values (90, "ATLANTIS", "ATLANTIS"), (91, "LEMURIA", null)'], "nodes(Region) as r | project r.r_regionkey as k, r.r_name as name", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region UNION ALL VALUES (90, 'ATLANTIS'), (91, 'LEMURIA')")
_steps("dml_upsert", ['upsert Region values (0, "NEW", "NEW"), (91, "FIRST", null), (91, "LAST", null)'], "nodes(Region) as r | project r.r_regionkey as k, r.r_name as name", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region WHERE r_regionkey <> 0 UNION ALL VALUES (0, 'NEW'), (91, 'LAST')")
_steps("dml_update", ['update Customer set c_mktsegment = "MOVED", c_acctbal = decimal("0.01") where c_custkey = 7'], "nodes(Customer) as c | aggregate count(c.c_custkey) as n, sum(c.c_acctbal) as s by c.c_mktsegment", 'SELECT CASE WHEN c_custkey = 7 THEN \'MOVED\' ELSE c_mktsegment END AS "c.c_mktsegment", count(*) AS n, CAST(sum(CASE WHEN c_custkey = 7 THEN 0.01 ELSE CAST(c_acctbal AS DECIMAL(15,2)) END) AS DECIMAL(25,2)) AS s FROM customer GROUP BY 1')
_steps("dml_delete", ["delete from Page where page_id = 5"], "nodes(Page) as p | project p.page_id as id, p.url as url", "SELECT page_id AS id, url FROM pages WHERE page_id <> 5")
_steps("dml_detach_delete", ["detach delete from Nation where n_nationkey = 3"], "nodes(Region) as r | expand InRegion in as n | expand CustomerNation in as c | aggregate count(c.c_custkey) as k by n.n_name", 'SELECT n_name AS "n.n_name", count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 GROUP BY 1')
_steps(
    "dml_insert_rel",
    ["insert rel into Follows values (1 -> 2, 9), (3 -> 3, 8)"],
    "nodes(Customer) as c | expand_rel Follows out as d via e | aggregate sum(e.weight) as w, count(d.c_custkey) as n by c.c_custkey",
    "WITH e AS (SELECT c_custkey AS f, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey // 2 + 1 END AS t, c_custkey % 7 AS w FROM customer UNION ALL VALUES (1, 2, 9), (3, 3, 8)) SELECT f AS \"c.c_custkey\", CAST(sum(w) AS BIGINT) AS w, count(*) AS n FROM e WHERE t IN (SELECT c_custkey FROM customer) GROUP BY 1",
)

# --- loading

_NATION = "create node table Land (n_nationkey Int64 primary key, n_name String, n_regionkey Int64)"
_LAND = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"
_steps("load_parquet", [_NATION, 'copy Land from "{dir}/nation.parquet"'], "nodes(Land) as l | project l.n_nationkey as k, l.n_name as name, l.n_regionkey as r", _LAND, True)
_steps(
    "load_sorted",
    ["create node table Client (c_custkey Int64 primary key, c_name String, c_nationkey Int64, c_acctbal Float64, c_mktsegment String)", 'copy Client from "{dir}/customer.parquet" sort by c_acctbal'],
    "nodes(Client) as c | limit 40 offset 5 | project c.c_custkey as k",
    "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 5",
    True,
)
_steps(
    "load_vectors_knn_index",
    ["create node table Vec (vec_id Int64 primary key, embedding Vector(64), label Int64)", 'copy Vec from "{dir}/embeddings.parquet"', "create hnsw index near on Vec.embedding metric l2"],
    "knn(Vec.embedding, scalar(nodes(Vec) as v | filter v.vec_id = 11 | project v.embedding), 12, l2, approximate) | project Vec.vec_id as id, Vec.label as label",
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 11) SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings, q ORDER BY list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(embedding, e), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), lambda s, x: s + x), vec_id LIMIT 12",
    True,
)


@_scenario("load_csv", _LAND, True)
def _load_csv(e: Engine, sf_dir: str) -> DataFrame:
    path = scratch(e.spark)
    e.spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey", "n_nationkey").write.csv(path, header=True)
    e.execute(_NATION)
    e.execute(f"copy Land from {P.quote_string(path)}")
    return e.query("nodes(Land) as l | project l.n_nationkey as k, l.n_name as name, l.n_regionkey as r", ordered=False)


@_scenario(
    "load_csv_quoted",
    "SELECT 'line one' || chr(10) || 'of \"' || n_name || '\", and more' AS note, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN '' ELSE n_name END AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation",
    True,
)
def _load_csv_quoted(e: Engine, sf_dir: str) -> DataFrame:
    path = scratch(e.spark)
    third = F.col("n_nationkey") % 3
    name = F.when(third == 0, "").when(third == 1, '""').otherwise(F.col("n_name"))
    line = F.concat(F.lit('"line one\nof ""'), "n_name", F.lit('"", and more",'), name, F.lit(","), F.col("n_nationkey").cast("string"))
    rows = e.spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("value"), "n_nationkey")
    text = rows.agg(F.concat(F.lit("note,name,k\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "value"))), lambda r: r["value"]), "\n")).alias("value"))
    text.coalesce(1).write.text(path)
    e.execute("create node table Land (k Int64 primary key, name String, note String)")
    e.execute(f"copy Land from {P.quote_string(path)}")
    return e.query("nodes(Land) as l | project l.k as k, l.name as name, l.note as note", ordered=False)


@_scenario("load_csv_rel", "SELECT n_name AS nation, r_name AS region, CAST(n_nationkey * 2 AS BIGINT) AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
def _load_csv_rel(e: Engine, sf_dir: str) -> DataFrame:
    path = scratch(e.spark)
    e.spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("to"), (F.col("n_nationkey") * 2).alias("w"), F.col("n_nationkey").alias("from")).write.csv(path, header=True)
    e.execute("create rel table LiesIn from Nation to Region (w Int64)")
    e.execute(f"copy LiesIn from {P.quote_string(path)}")
    return e.query("nodes(Nation) as n | expand_rel LiesIn out as r via l | project n.n_name as nation, r.r_name as region, l.w as w", ordered=False)


# --- transactions, versions, folders

_REGIONS = "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region"


@_scenario("tx_rollback_commit", f"{_REGIONS} UNION ALL VALUES (81), (82)")
def _transactions(e: Engine, sf_dir: str) -> DataFrame:
    lost = e.begin()
    lost.execute('insert into Region values (80, "X", "X")')
    lost.rollback()
    with e.begin() as tx:
        tx.execute('insert into Region values (81, "Y", "Y")')
        tx.execute('insert into Region values (82, "Z", "Z")')
    return e.query("nodes(Region) as r | project r.r_regionkey as k", ordered=False)


@_scenario("tx_snapshot", _REGIONS)
def _snapshot(e: Engine, sf_dir: str) -> DataFrame:
    before = e.snapshot()
    e.execute('insert into Region values (80, "X", "X")')
    return before.query("nodes(Region) as r | project r.r_regionkey as k", ordered=False)


@_scenario("tx_later_commits_merge", f"{_REGIONS} UNION ALL VALUES (83)")
def _merge(e: Engine, sf_dir: str) -> DataFrame:
    a, b = e.begin(), e.begin()
    a.execute('insert into Region values (83, "A", "A")')
    b.execute('update Nation set n_name = "B" where n_nationkey = 1')
    a.commit()
    b.commit()
    return e.query("nodes(Region) as r | project r.r_regionkey as k", ordered=False)


@_scenario("folder_reopened", "SELECT * FROM (VALUES (1::BIGINT, 'one'), (2, 'deux'), (4, 'four')) t(id, name)", True)
def _folder(e: Engine, sf_dir: str) -> DataFrame:
    path = scratch(e.spark)
    first = Engine.create(e.spark, path)
    first.execute("create node table T (id Int64 primary key, name String)")
    first.execute('insert into T values (1, "one"), (2, "two"), (3, "three")')
    first.execute('update T set name = "deux" where id = 2')
    first.close()
    again = Engine.open(e.spark, path)
    again.execute("delete from T where id = 3")
    again.execute('insert into T values (4, "four")')
    again.checkpoint()
    return Engine.open(e.spark, path).query("nodes(T) as t | project t.id as id, t.name as name", ordered=False)


@_scenario("dump_replayed", "SELECT * FROM (VALUES ('Ann', 'Bo', 2.5::DOUBLE), ('Bo', 'Bo', NULL)) t(a, b, w)", True)
def _dump(e: Engine, sf_dir: str) -> DataFrame:
    for s in ("create node table P (id Int64 primary key, name String)", "create rel table L from P to P (w Float64)", 'insert into P values (1, "Ann"), (2, "Bo")', "insert rel into L values (1 -> 2, 2.5), (2 -> 2, null)"):
        e.execute(s)
    other = Engine(e.spark)
    for s in e.dump():
        other.execute(s)
    return other.query("nodes(P) as p | expand_rel L out as q via l | project p.name as a, q.name as b, l.w as w", ordered=False)


@_scenario("pin_run", "SELECT r_name AS name FROM region WHERE r_regionkey >= 2")
def _pins(e: Engine, sf_dir: str) -> DataFrame:
    e.pin("late", "nodes(Region) as r | filter r.r_regionkey >= 2 | project r.r_name as name")
    e.execute('pin "gone" as nodes(Region) as r')
    e.unpin("gone")
    return e.run_pin("late")


@_scenario("plan_json", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey = 1")
def _json(e: Engine, sf_dir: str) -> DataFrame:
    return e.plan(P.to_json(e.parse("nodes(Nation) as n | filter n.n_regionkey = 1 | project n.n_nationkey as k")), ordered=False)


@_scenario(
    "neighborhood",
    "WITH e AS (SELECT 'CustomerNation' AS rel, 'in' AS direction, 'Customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_nationkey = 3 UNION SELECT 'SupplierNation', 'in', 'Supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3 UNION SELECT 'InRegion', 'out', 'Region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3) SELECT * FROM e ORDER BY rel, direction, \"table\", key LIMIT 500",
)
def _neighbours(e: Engine, sf_dir: str) -> DataFrame:
    return e.neighborhood("Nation", 3)


@_scenario("stats", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {table}" for name, table in (("Region", "region"), ("Nation", "nation"), ("Placed", "orders"), ("Contains", "lineitem"))))
def _stats(e: Engine, sf_dir: str) -> DataFrame:
    found = e.stats()
    return e.spark.createDataFrame([(k, found[k]) for k in ("Region", "Nation", "Placed", "Contains")], "name string, n long")


# --- values

_steps("a3_sum_float64", [], "nodes(Orders) as o | expand_rel Contains out as p via l | aggregate sum(l.l_quantity) as q, avg(l.l_quantity) as m by p.p_brand", 'SELECT p_brand AS "p.p_brand", sum(l_quantity) AS q, avg(l_quantity) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1')
_steps(
    "e6_bytes_json_equal",
    ["create node table B (id Int64 primary key, raw Bytes, doc Json)", 'insert into B values (1, bytes("aGk="), json("{\\"a\\": 1}")), (2, bytes("aG8="), json("{\\"a\\":1}")), (3, null, json("{\\"b\\":1,\\"a\\":1}")), (4, bytes(""), null)'],
    'nodes(B) as b | project b.id as id, b.raw = bytes("aGk=") as raw, b.doc = json("{\\"a\\":1}") as doc, b.raw != bytes("aGk=") as other',
    "SELECT * FROM (VALUES (1::BIGINT, true, true, false), (2, false, true, true), (3, NULL, false, NULL), (4, false, NULL, true)) t(id, raw, doc, other)",
    True,
)
_steps(
    "e25_scoreof",
    [],
    'textscan(Document.text, "the ont", k=200) as d | project d.doc_id as id, scoreof(d) > 1.0 as one, scoreof(d) > 2.0 as two',
    """WITH toks AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CAST(len(t) AS HUGEINT) AS dl, CAST(len(list_filter(t, lambda x: x = 'the')) AS HUGEINT) AS a, CAST(len(list_filter(t, lambda x: x = 'ont')) AS HUGEINT) AS b FROM toks),
s AS (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(dl) AS HUGEINT) AS total, CAST(count(*) FILTER (a > 0) AS HUGEINT) AS da, CAST(count(*) FILTER (b > 0) AS HUGEINT) AS db FROM c),
sc AS (SELECT doc_id,
 CASE WHEN a > 0 THEN ln(2.0 * (n + 1) / (2 * da + 1)) * (a * 2.2) / (a + 1.2 * (0.25 + 0.75 * dl * n / total)) ELSE 0 END + CASE WHEN b > 0 THEN ln(2.0 * (n + 1) / (2 * db + 1)) * (b * 2.2) / (b + 1.2 * (0.25 + 0.75 * dl * n / total)) ELSE 0 END AS score FROM c, s WHERE a + b > 0)
SELECT doc_id AS id, score > 1.0 AS one, score > 2.0 AS two FROM sc ORDER BY round(score, 7) DESC, doc_id LIMIT 200""",
)

# --- English

_FOLLOWS = "(SELECT c_custkey AS f, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey // 2 + 1 END AS t FROM customer)"


def _question(name: str, question: str, sql: str, keep: str | None = None, steps: tuple[str, ...] = (), empty: bool = False, today: dt.date | None = None) -> None:
    """``keep`` is a pattern of the columns that are compared."""

    @_scenario(name, sql, empty)
    def run(e: Engine, sf_dir: str) -> DataFrame:
        for s in steps:
            e.execute(s)
        df = e.query(compile_question(question, e.catalog, today, Ground(e.spark, e.catalog)), ordered=False)
        return df.select(*(F.col(f"`{c}`") for c in df.columns if keep is None or c in keep.split(",")))


_KEY = "customer.c_custkey"
_question("nl_top", "top 7 customers by c_acctbal where c_mktsegment is BUILDING", "SELECT c_custkey AS \"customer.c_custkey\" FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY CAST(c_acctbal AS DECIMAL(15,2)) DESC, c_custkey LIMIT 7", _KEY)
_question("nl_bottom", "bottom 3 customers by c_acctbal", 'SELECT c_custkey AS "customer.c_custkey" FROM customer ORDER BY CAST(c_acctbal AS DECIMAL(15,2)), c_custkey LIMIT 3', _KEY)
_question("nl_not_in", "customers not in c_mktsegment BUILDING", "SELECT c_custkey AS \"customer.c_custkey\" FROM customer WHERE c_mktsegment <> 'BUILDING'", _KEY)
_question("nl_no_edge", "show customers with no Placed", 'SELECT c_name AS "customer.name" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)')
_question("nl_hop_out", "who does Customer#000000007 follow", f"SELECT y.c_name AS \"other.name\" FROM {_FOLLOWS} e JOIN customer x ON x.c_custkey = f JOIN customer y ON y.c_custkey = t WHERE x.c_name = 'Customer#000000007'")
_question("nl_hop_in", "who follows Customer#000000005", f"SELECT x.c_name AS \"other.name\" FROM {_FOLLOWS} e JOIN customer x ON x.c_custkey = f JOIN customer y ON y.c_custkey = t WHERE y.c_name = 'Customer#000000005'")
_question("nl_two_hops", "follows of follows of Customer#000000005", f"SELECT z.c_name AS \"other.name\" FROM {_FOLLOWS} e JOIN {_FOLLOWS} g ON e.t = g.f JOIN customer x ON x.c_custkey = e.f JOIN customer z ON z.c_custkey = g.t WHERE x.c_name = 'Customer#000000005'")
_question("nl_hop_filter", "who follows Customer#000000005 where c_acctbal over 100", f"SELECT x.c_name AS \"other.name\" FROM {_FOLLOWS} e JOIN customer x ON x.c_custkey = f JOIN customer y ON y.c_custkey = t WHERE y.c_name = 'Customer#000000005' AND CAST(x.c_acctbal AS DECIMAL(15,2)) > 100")
_question("nl_lookup", "what is EUROPE", "SELECT CAST(r_regionkey AS BIGINT) AS \"region.r_regionkey\", r_name AS \"region.r_name\" FROM region WHERE r_name = 'EUROPE'", "region.r_regionkey,region.r_name")
_LAT, _LNG = "((c_custkey * 37) % 18000 / 100.0::DOUBLE - 90)", "((c_custkey * 91) % 36000 / 100.0::DOUBLE - 180)"
_ARC = f"2 * 6371007.180918475 * asin(least(1.0, sqrt(power(sin(radians({_LAT} - {{lat}}) / 2), 2) + cos(radians({_LAT})) * cos(radians({{lat}})) * power(sin(radians({_LNG} - {{lng}}) / 2), 2))))"
_question("nl_within", "customers within 2500 km of 10, 20", f'SELECT c_custkey AS "Customer.c_custkey" FROM customer WHERE {_ARC.format(lat=10, lng=20)} <= 2500000', "Customer.c_custkey")
_question("nl_within_place", "customers within 2000 km of Customer#000000042", f'SELECT c_custkey AS "Customer.c_custkey" FROM customer WHERE {_ARC.format(lat="((42 * 37) % 18000 / 100.0::DOUBLE - 90)", lng="((42 * 91) % 36000 / 100.0::DOUBLE - 180)")} <= 2000000', "Customer.c_custkey")
_question("nl_fulltext", 'search documents text for "zzzzz"', 'SELECT doc_id AS "document.doc_id" FROM documents WHERE false', "document.doc_id")
_VISITS = (
    "create node table Visit (id Int64 primary key, title String, visited_at Int64, city String)",
    'insert into Visit values (1, "a", 1704067200, "Ely"), (2, "b", 1709251199, null), (3, "c", 1709251200, "Ely"), (4, "d", 1711929600, "York"), (5, "e", null, "York")',
)
_question("nl_months", "visits from january to february 2024", 'SELECT * FROM (VALUES (1::BIGINT), (2)) t("visit.id")', "visit.id", _VISITS, True)
_question("nl_last_days", "visits last 31 days", 'SELECT * FROM (VALUES (2::BIGINT), (3)) t("visit.id")', "visit.id", _VISITS, True, dt.date(2024, 3, 15))
_question("nl_this_month", "visits this month", 'SELECT * FROM (VALUES (3::BIGINT)) t("visit.id")', "visit.id", _VISITS, True, dt.date(2024, 3, 15))
_question("nl_without", "visits without city", 'SELECT * FROM (VALUES (2::BIGINT)) t("visit.id")', "visit.id", _VISITS, True)
_FACES = ("create node table Face (id Int64 primary key, name String, embedding Vector(2))", 'insert into Face values (1, "Ada", [1.0, 0.0]), (2, "Bo", [0.0, 1.0]), (3, "Cy", [0.9, 0.1]), (4, "Di", null)')
_question("nl_similar", "top 2 faces similar to Ada", 'SELECT * FROM (VALUES (1::BIGINT), (3)) t("Face.id")', "Face.id", _FACES, True)


@_scenario("nl_statements", "SELECT c_custkey AS k, CASE WHEN c_custkey = 7 THEN 'MOVED' ELSE c_mktsegment END AS s FROM customer")
def _statements(e: Engine, sf_dir: str) -> DataFrame:
    e.execute(compile_statement("set customer 7 c_mktsegment to MOVED", e.catalog))
    e.execute(compile_statement("delete page 5", e.catalog))
    return e.query("nodes(Customer) as c | project c.c_custkey as k, c.c_mktsegment as s", ordered=False)
