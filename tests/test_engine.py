"""Queries and statements against literal rows."""

import datetime as dt
from decimal import Decimal

import pytest

from graphquarry.engine import Engine
from graphquarry.english import NoParse, compile_question, compile_statement
from graphquarry.errors import InvalidArgument, NotFound, TransactionConflict


def rows(df):
    return [tuple(r) for r in df.collect()]


def build(spark, *statements, path=None):
    e = Engine(spark, path)
    with e.begin() as tx:
        for s in statements:
            tx.execute(s)
    return e


#: Ports and the hours between them; Oslo has a round trip, and two lines to Kiel.
PORTS = (
    "create node table Port (id Int64 primary key, name String)",
    "create rel table Sails from Port to Port (hours Int64)",
    'insert into Port values (10, "Oslo"), (20, "Kiel"), (30, "Riga"), (40, "Turku"), (50, "Gdynia")',
    "insert rel into Sails values (20 -> 10, 19), (10 -> 10, 2), (10 -> 40, 31), (30 -> 10, 26), (10 -> 20, 20), (10 -> 20, 23), (50 -> 30, 9)",
)


@pytest.fixture(scope="module")
def ports(spark):
    return build(spark, *PORTS)


def test_expand_directions(ports):
    q = 'nodes(Port) as p | filter p.name = "Oslo" | expand Sails {} as o | project o.name'
    assert [r[0] for r in rows(ports.query(q.format("out")))] == ["Oslo", "Turku", "Kiel", "Kiel"]
    assert [r[0] for r in rows(ports.query(q.format("in")))] == ["Kiel", "Oslo", "Riga"]
    assert [r[0] for r in rows(ports.query(q.format("both")))] == ["Oslo", "Turku", "Kiel", "Kiel", "Kiel", "Riga"]


def test_expand_rel_keeps_parallel_edges(ports):
    q = "nodes(Port) as p | filter p.id = 10 | expand_rel Sails both as o via e | project e.hours"
    assert [r[0] for r in rows(ports.query(q))] == [2, 31, 20, 23, 19, 26]
    total = ports.query("nodes(Port) as p | expand_rel Sails both as o via e | aggregate sum(e.hours) as s by p.name | sort p.name")
    assert rows(total) == [("Gdynia", 9), ("Kiel", 62), ("Oslo", 121), ("Riga", 35), ("Turku", 31)]


def test_expand_refusals(ports):
    for q, says in [
        ("nodes(Port) as p | expand Sail out as o", "did you mean"),
        ("nodes(Port) as p | expand Sails out as P", "taken"),
        ("nodes(Port) as p | aggregate count(p.id) as n | expand Sails out from p as o", "not bound"),
        ("nodes(Pors) as p", "did you mean"),
        ("nodes(Port) as p | filter p.nme = 1", "did you mean"),
        ("nodes(Port) as p | filter p.name = 1", "not the same type"),
        ("nodes(Port) as p | filter p.id", "not Int64"),
        ("nodes(Port) as p | project p.id as x, p.name as X", "named"),
        ("nodes(Port) as p | aggregate sum(p.name) as s", "sum of String"),
    ]:
        with pytest.raises(InvalidArgument, match=says):
            ports.query(q)


def test_identity_survives_project(ports):
    q = "nodes(Port) as p | project p.name as who | expand Sails out from p as o | aggregate count(o.id) as n"
    assert rows(ports.query(q)) == [(7,)]


def test_neighborhood_and_names_fold(ports):
    got = {tuple(r) for r in ports.neighborhood("PORT", 30).collect()}
    assert got == {("Sails", "in", "Port", "50"), ("Sails", "out", "Port", "10")}
    assert ports.query("nodes(pOrT) as P | project p.NAME").columns == ["P.name"]


def test_joins_order_and_nulls(spark):
    e = build(
        spark,
        "create node table Person (id Int64 primary key, name String, city String)",
        "create node table City (id Int64 primary key, code String, name String, score Float64)",
        'insert into Person values (1, "A", "x"), (2, "B", null), (3, "C", "y"), (4, "D", "none")',
        'insert into City values (1, "y", "Y1", 1.0), (2, "x", "X1", 2.0), (3, "x", "X2", null)',
    )
    q = "let c = nodes(City) as c; nodes(Person) as p | {} join c on c.code = p.city | project p.id, c.name"
    assert rows(e.query(q.format(""))) == [(1, "X1"), (1, "X2"), (3, "Y1")]
    assert rows(e.query(q.format("left"))) == [(1, "X1"), (1, "X2"), (2, None), (3, "Y1"), (4, None)]
    nan = "let c = nodes(City) as c | project c.id, c.score / 0.0 - c.score / 0.0 as `c.nan`; let d = nodes(City) as d | project d.id, d.score / 0.0 - d.score / 0.0 as `d.nan`;"
    assert rows(e.query(nan + " nodes(Person) as p | join c on p.id = c.id | join d on c.nan = d.nan")) == []
    with pytest.raises(InvalidArgument, match="one type"):
        e.query("let c = nodes(City) as c; nodes(Person) as p | join c on p.id = c.code")


def test_expressions(spark):
    e = build(
        spark,
        "create node table R (id Int64 primary key, a Int64, f Float64, d Decimal(10,2), t Timestamp, b Bool)",
        'insert into R values (1, 7, 0.0, decimal("1.50"), timestamp("1969-12-31T23:59:59"), true), (2, null, -0.5, null, null, null), (3, 9007199254740993, 9007199254740992.0, decimal("-2.25"), timestamp("2024-02-28T10:00:00"), false)',
    )

    def one(expr, where=1):
        return rows(e.query(f"nodes(R) as r | filter r.id = {where} | project {expr} as x"))[0][0]

    assert one("(0 - r.a) / 2") == -3
    assert one("1.0 / r.f") == float("inf")
    assert one("r.f / r.f = r.f / r.f") is False
    assert one("r.f / r.f != r.f / r.f") is True
    assert one("r.a = r.f", 3) is False and one("r.a > r.f", 3) is True
    assert one("r.a > 1", 2) is None and one("r.a > 1 or true", 2) is True
    assert one("r.d * r.d") == Decimal("2.2500")
    assert one("r.d + 1") == Decimal("2.50")
    assert one("round(r.d, 1)", 3) == Decimal("-2.30")
    assert one("round_div(r.d, decimal(\"7\"), 2)", 3) == Decimal("-0.32")
    assert one('date_trunc("day", r.t)') == dt.datetime(1969, 12, 31)
    assert one('date_add("day", r.t, 2)', 3) == dt.datetime(2024, 3, 1, 10)
    assert one("if(r.b, 1, 2)", 2) == 2
    assert one("least(r.a, 3, null)") == 3 and one("greatest(r.a, null)", 2) is None
    assert one("coalesce(r.d, decimal(\"9.99\"))", 2) == Decimal("9.99")
    assert one("if(r.id = 1, 5, 1 / 0)") == 5
    for bad in ("r.d / r.d", "r.d + r.f", "r.d = decimal(\"1.5\")", "r.a + r.b", "least(r.id, r.f)"):
        with pytest.raises(InvalidArgument):
            one(bad)
    with pytest.raises(Exception, match="OVERFLOW"):
        one("r.a * 9000000000000000000")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one("r.a / 0")


def test_aggregates(spark):
    e = build(
        spark,
        "create node table S (id Int64 primary key, g String, v Int64, d Decimal(6,2))",
        'insert into S values (1, "a", 1, decimal("1.00")), (2, null, 2, decimal("2.00")), (3, "a", null, decimal("3.00")), (4, "b", 5, null)',
    )
    q = 'nodes(S) as s | aggregate count(s.v) as n, sum(s.v) as t, avg(s.v) as m, percentile_cont(decimal("0.5"), s.d) as h by s.g'
    assert rows(e.query(q)) == [(None, 1, 2, 2.0, Decimal("2.00")), ("a", 1, 1, 1.0, Decimal("2.00")), ("b", 1, 5, 5.0, None)]
    assert rows(e.query("nodes(S) as s | filter s.id > 9 | aggregate count(s.id) as n, sum(s.v) as t")) == [(0, None)]
    assert rows(e.query("nodes(S) as s | filter s.id > 9 | aggregate count(s.id) as n by s.g")) == []
    assert rows(e.query("nodes(S) as s | aggregate by s.g")) == [(None,), ("a",), ("b",)]
    with pytest.raises(InvalidArgument, match="round"):
        e.query("nodes(S) as s | aggregate avg(s.d) as m")
    e.execute('insert into S values (5, "c", 1, decimal("1.00")), (6, "c", 1, decimal("1.01"))')
    with pytest.raises(Exception, match="median"):
        e.query('nodes(S) as s | filter s.g = "c" | aggregate percentile_cont(decimal("0.5"), s.d) as h').collect()


def test_scalar_queries(ports):
    q = "nodes(Port) as p | project p.id, scalar(nodes(Port) as o | filter o.id = p.id + 20 | project o.name) as later"
    assert rows(ports.query(q)) == [(10, "Riga"), (20, "Turku"), (30, "Gdynia"), (40, None), (50, None)]
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        ports.query("nodes(Port) as p | project scalar(nodes(Port) as o | project o.id) as x").collect()
    with pytest.raises(InvalidArgument, match="one column"):
        ports.query("nodes(Port) as p | project scalar(nodes(Port) as o) as x")


def test_interfaces_text_geo_vectors(spark):
    e = build(
        spark,
        "create node table Person (id Int64 primary key, name String, role String)",
        "create node table Project (id Int64 primary key, title String, name String)",
        "create interface Nameable (name String)",
        "create interface Dormant (name String)",
        "create class for Project (implements (Nameable))",
        "create class for Person (label name, implements (Nameable))",
        'insert into Project values (1, "t", "P")',
        'insert into Person values (1, "Ada", "x"), (2, "Bob", "y")',
        "create node table Doc (id Int64 primary key, body String, at GeoPoint, v Vector(2))",
        'insert into Doc values (1, "Rust graph rust", geo(0, 0), [1, 0]), (2, "graph", geo(0, 1), [0, 1]), (3, null, null, null), (4, "RUST", geo(90, 55), [0, 0]), (5, "graph", geo(0, -179.9), [1, 0])',
    )
    assert rows(e.query("nodes(Nameable) as x | project classof(x) as c, x.name")) == [("Person", "Ada"), ("Person", "Bob"), ("Project", "P")]
    assert rows(e.query("nodes(Dormant) as x")) == []
    got = rows(e.query('textscan(Doc.body, "rust GRAPH rust", k=4) as d | project d.id, scoreof(d) as s'))
    assert [r[0] for r in got] == [1, 4, 2, 5] and got[2][1] == got[3][1] > 0
    assert rows(e.query('textscan(Doc.body, "...", k=4) as d')) == []
    assert [r[0] for r in rows(e.query("within(Doc.at, geo(0, 0), 111200) | project Doc.id"))] == [1, 2]
    assert [r[0] for r in rows(e.query("within(Doc.at, geo(0, 180), 20000) | project Doc.id"))] == [5]
    assert [r[0] for r in rows(e.query("within(Doc.at, geo(89.99, 0), 5000) | project Doc.id"))] == [4]
    near = e.query("knn(Doc.v, [1, 0], 10, cosine)")
    assert near.columns[-1] == "distance"
    assert [(r[0], r[-1]) for r in rows(near)] == [(1, 0.0), (5, 0.0), (2, 1.0), (4, 2.0)]
    assert [r[0] for r in rows(e.query("knn(Doc.v, scalar(nodes(Doc) as d | filter d.id = 2 | project d.v), 1, l2) | project Doc.id"))] == [2]
    with pytest.raises(Exception, match="query vector is null"):
        e.query("knn(Doc.v, scalar(nodes(Doc) as d | filter d.id = 3 | project d.v), 1, l2)").collect()
    with pytest.raises(InvalidArgument, match="elements"):
        e.query("knn(Doc.v, [1], 1, l2)")
    assert rows(e.query("knn(Doc.v, [1, 0], 0, l2)")) == []


def test_changes(spark):
    e = build(spark, *PORTS)
    with pytest.raises(InvalidArgument, match="has the key"):
        e.execute('insert into Port values (30, "Pori")')
    e.execute('upsert Port values (30, "Rauma"), (70, "Pori"), (70, "Vaasa")')
    assert rows(e.query("nodes(Port) as p")) == [(10, "Oslo"), (20, "Kiel"), (30, "Rauma"), (40, "Turku"), (50, "Gdynia"), (70, "Vaasa")]
    e.execute('update Port set name = "Hanko" where id = 40')
    with pytest.raises(NotFound):
        e.execute('update Port set name = "Pori" where id = 77')
    with pytest.raises(InvalidArgument, match="detach"):
        e.execute("delete from Port where id = 10")
    with pytest.raises(NotFound):
        e.execute("insert rel into Sails values (10 -> 77, 1)")
    e.execute("detach delete from Port where id = 10")
    assert rows(e.query("nodes(Port) as p | project p.name")) == [("Kiel",), ("Rauma",), ("Hanko",), ("Gdynia",), ("Vaasa",)]
    assert rows(e.query("nodes(Port) as p | expand Sails both as o | project p.id, o.id")) == [(30, 50), (50, 30)]
    e.pin("all", "nodes(Port) as p | aggregate count(p.id) as n")
    assert rows(e.run_pin("all")) == [(5,)]
    e.unpin("all")
    with pytest.raises(NotFound):
        e.run_pin("all")


def test_transactions(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = build(spark, *PORTS, path=path)
    before = e.snapshot()
    a, b = e.begin(), e.begin()
    a.execute('update Port set name = "Bergen" where id = 10')
    one = "nodes(Port) as p | filter p.id = 10 | project p.name"
    assert rows(a.query(one)) == [("Bergen",)] and rows(e.query(one)) == [("Oslo",)]
    b.execute('update Port set name = "Moss" where id = 10')
    a.commit()
    with pytest.raises(TransactionConflict):
        b.commit()
    assert rows(before.query(one)) == [("Oslo",)]
    again = Engine.open(spark, path)
    assert rows(again.query(one)) == [("Bergen",)]
    with pytest.raises(InvalidArgument):
        Engine.create(spark, path)
    with pytest.raises(NotFound):
        Engine.open(spark, f"file://{tmp_path}/none")
    copy = Engine(spark)
    for s in again.dump():
        copy.execute(s)
    assert rows(copy.query("nodes(Port) as p")) == rows(again.query("nodes(Port) as p"))
    assert again.stats() == {"Port": 5, "Sails": 7} and again.checkpoint() == again.generation


def test_copy(spark, tmp_path):
    e = build(spark, "create node table R (id Int64 primary key, score Float64, name String, ok Bool, v Vector(2), at GeoPoint)")
    (tmp_path / "r.csv").write_text('name,id,ok,score,v,at\n"a ""q"", b",2,true,-0.0,"[1, 2]","geo(1, 2)"\n"",1,,1.5,,\n,3,false,,,\n')
    e.execute(f'copy R from "file://{tmp_path}/r.csv" sort by score')
    got = rows(e.query("nodes(R) as r | project r.id, r.name, r.ok, r.score"))
    assert got == [(2, 'a "q", b', True, -0.0), (1, "", None, 1.5), (3, None, False, None)]
    with pytest.raises(InvalidArgument, match="a key is in"):
        e.execute(f'copy R from "file://{tmp_path}/r.csv"')
    (tmp_path / "bad.csv").write_text("id,name\n1,x\n")
    with pytest.raises(InvalidArgument, match="header"):
        e.execute(f'copy R from "file://{tmp_path}/bad.csv"')
    e.execute("create node table Q (id Int64 primary key, name String)")
    spark.createDataFrame([(5, "e"), (4, None)], "id int, name string").coalesce(1).write.parquet(f"file://{tmp_path}/q.parquet")
    e.execute(f'copy Q from "file://{tmp_path}/q.parquet"')
    assert rows(e.query("nodes(Q) as q | sort q.id")) == [(4, None), (5, "e")]


CATALOG = (
    "create node table Person (id Int64 primary key, name String, age Int64, score Float64, embedding Vector(2))",
    "create node table Sale (id Int64 primary key, revenue Int64, amount Decimal(10,2), region String, ordered_at Int64)",
    "create rel table Knows from Person to Person",
    "create rel table Bought from Person to Sale",
)


@pytest.mark.parametrize(
    "question, plan",
    [
        ("show all people", "nodes(Person) as person"),
        ("people where age over 30 and score below 100.5", "nodes(Person) as person | filter person.age > 30 and person.score < 100.5"),
        ("who is Ada", 'nodes(Person) as person | filter person.name = "Ada"'),
        ("who does ada know?", 'nodes(Person) as person | filter person.name = "ada" | expand Knows out as other | project other.name'),
        ("who knows Ada", 'nodes(Person) as person | filter person.name = "Ada" | expand Knows in as other | project other.name'),
        ("how many people have age over 30", "nodes(Person) as person | filter person.age > 30 | aggregate count(person.id) as `count`"),
        ("how many sales by region", "nodes(Sale) as sale | aggregate count(sale.id) as `count` by sale.region"),
        ("total revenue of sales by region", "nodes(Sale) as sale | aggregate sum(sale.revenue) as total by sale.region"),
        ("top 5 people by age", "nodes(Person) as person | sort person.age desc | limit 5"),
        ("top 3 people similar to ada", 'knn(Person.embedding, scalar(nodes(Person) as anchor | filter anchor.name = "ada" | project anchor.embedding), 3, cosine)'),
        ("sales revenue between 100 and 200", "nodes(Sale) as sale | filter sale.revenue >= 100 and sale.revenue <= 200"),
        ("sales without region", "nodes(Sale) as sale | filter coalesce(sale.region = sale.region, false) = false"),
        ("sales not in region north", 'nodes(Sale) as sale | filter sale.region != "north"'),
        ("sales from march to may 2026", "nodes(Sale) as sale | filter sale.ordered_at >= 1772323200 and sale.ordered_at < 1780272000"),
        ("sales with ordered_at yesterday", "nodes(Sale) as sale | filter sale.ordered_at >= 1767225600 and sale.ordered_at < 1767312000"),
    ],
)
def test_english(spark, question, plan):
    e = build(spark, *CATALOG)
    assert compile_question(question, e.catalog, dt.date(2026, 1, 2)) == plan
    e.query(plan)


def test_english_statements_and_refusals(spark):
    e = build(spark, *CATALOG)
    assert compile_statement("set person 7 age to 40", e.catalog) == "update Person set age = 40 where id = 7"
    assert compile_statement("delete person 7", e.catalog) == "delete from Person where id = 7"
    for q in ("frobnicate the widgets", "people where height over 3", "sales by the sea shore"):
        with pytest.raises(NoParse):
            compile_question(q, e.catalog)


def test_loaded_vectors_are_checked_and_encoded(spark, tmp_path):
    import numpy as np

    from graphquarry.functions import vectors

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 6)) * 10.0 ** rng.integers(-9, 6, (40, 1)), [[0, -0.0, 1, 65519, 65520, -7e4], [2.0**-24, 2.0**-25, 3 * 2.0**-25, 2.0**-14, 1 + 2.0**-11, 1 + 3 * 2.0**-11]]]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").write.parquet(f"{tmp_path}/v.parquet")
    for encoding in ("f16", "i8", "b1", "f32"):
        e = build(spark, f"create node table V (id Int64 primary key, v Vector(6, {encoding}))", f'copy V from "{tmp_path}/v.parquet"')
        got = {r[0]: list(r[1]) for r in e.query("nodes(V) as v | project v.id as id, v.v as v").collect()}
        for i, v in enumerate(x):
            assert got[i] == vectors.quantised(v.tolist(), encoding), (encoding, i)
    for body in ("[1.0, 2.0, 3.0]", "[1.0]", "[1.0, x]", "[]", "1, 2", "[1.0, 1e39]"):
        (tmp_path / "bad.csv").write_text(f'id,v\n1,"[1.0, 2.0]"\n2,"{body}"\n')
        e = build(spark, "create node table W (id Int64 primary key, v Vector(2))")
        e.execute(f'copy W from "{tmp_path}/bad.csv"')
        with pytest.raises(Exception, match="not a Vector"):
            e.query("nodes(W) as w").collect()
    (tmp_path / "good.csv").write_text('id,v\n1,"[1.0, -2e1]"\n2,\n')
    e = build(spark, "create node table W (id Int64 primary key, v Vector(2))", f'copy W from "{tmp_path}/good.csv"')
    assert rows(e.query("nodes(W) as w | project w.v as v")) == [([1.0, -20.0],), (None,)]
    with pytest.raises(NotFound):
        e.execute(f'copy W from "{tmp_path}/none.csv"')


def test_scores_equal_integer_arithmetic(spark):
    from graphquarry.functions import fulltext as T

    long = "é" * 40
    texts = ["Ada ada, ADA!", "the ada's adas", None, "", "ÉTÉ été ete", long + "x " + long, "a" * 70 + " " + "a" * 64, "x" * 3000 + " ada", "ada " * 500 + "bob"]
    e = build(spark, "create node table D (id Int64 primary key, body String)", *(f"insert into D values ({i}, {'null' if t is None else chr(34) + t + chr(34)})" for i, t in enumerate(texts)))
    for q in ("ada", "ada bob", "été", "ÉTÉ", "a" * 80, long, "ada's", "none", "bob ada ADA s"):
        terms = list(dict.fromkeys(T.tokenise(q)))
        toks = {i: T.tokenise(t) for i, t in enumerate(texts) if t is not None}
        n, total = len(toks), sum(map(len, toks.values()))
        want = {}
        for i, ts in toks.items():
            s = sum(T.term_score(T.idf(n, sum(x in y for y in toks.values())), ts.count(x), len(ts), n, total) for x in terms)
            if any(x in ts for x in terms):
                want[i] = s
        got = {r[0]: r[1] for r in T.search(e.catalog.node_table("D").frame(spark), "body", q, "s").select("id", "s").collect()}
        assert {k: int(v) for k, v in got.items()} == want, q


def test_command_line(spark, tmp_path):
    from graphquarry.__main__ import run

    folder = f"{tmp_path}/db"
    assert list(run(spark, folder, "create", None)) == []
    for s in ("create node table T (id Int64 primary key, name String)", 'insert into T values (1, "é"), (2, null)'):
        assert list(run(spark, folder, "execute", s)) == []
    assert list(run(spark, folder, "query", "nodes(T) as t | project t.name as n, t.id as id")) == ['{"n": "é", "id": 1}', '{"n": null, "id": 2}']
    assert list(run(spark, folder, "ask", "how many ts")) == ['{"count": 2}'] and list(run(spark, folder, "stats", None)) == ['{"T": 2}']
    assert len(list(run(spark, folder, "dump", None))) == 3 and list(run(spark, folder, "plan", "nodes(T) as t"))[0] == "nodes(T) as t"


def test_scalar_that_groups_inside(spark):
    e = build(
        spark,
        "create node table Day (id Int64 primary key, day Int64, cost Decimal(12,2))",
        'insert into Day values (1, 1, decimal("10.00")), (2, 1, decimal("5.00")), (3, 2, decimal("8.00")), (4, 3, decimal("4.00")), (5, 5, decimal("90.00")), (6, null, decimal("1.00"))',
    )
    past = 'scalar(nodes(Day) as h | aggregate sum(h.cost) as `past.cost` by h.day | filter h.day >= d.day - 3 and h.day < d.day | aggregate {}) as m'
    q = "nodes(Day) as d | aggregate sum(d.cost) as `now.cost` by d.day | project d.day as day, " + past
    got = {r[0]: r[1] for r in rows(e.query(q.format('percentile_cont(decimal("0.5"), past.cost) as x')))}
    assert got == {1: None, 2: Decimal("15.00"), 3: Decimal("11.50"), 5: Decimal("6.00"), None: None}
    got = {r[0]: r[1] for r in rows(e.query(q.format("count(past.cost) as x")))}
    assert got == {1: 0, 2: 1, 3: 2, 5: 2, None: 0}
    two = "nodes(Day) as d | filter scalar(nodes(Day) as h | aggregate sum(h.cost) as `p.c` by h.day | filter h.day < d.day | project p.c) > decimal(\"1.00\")"
    with pytest.raises(Exception, match="more than one row"):
        e.query(two).collect()
    top = "nodes(Day) as d | sort scalar(nodes(Day) as h | aggregate sum(h.cost) as `p.c` by h.day | filter h.day = d.day | aggregate max(p.c) as x) desc, d.id | limit 3 | project d.id as id"
    assert [r[0] for r in rows(e.query(top))] == [5, 1, 2]


def test_names_are_looked_up(spark):
    e = build(
        spark,
        "create node table Guide (id Int64 primary key, name String, fee Int64)",
        "create node table Hut (id Int64 primary key, name String, at GeoPoint)",
        "create rel table Meets from Guide to Guide",
        "create rel table Minds from Guide to Hut",
        'create class for Minds (verb "looks after", inverse "is kept by")',
        'insert into Guide values (1, "Ulla", 30), (2, "Per", 50), (3, "Tove", 70)',
        'insert into Hut values (5, "Ravn", geo(60.0, 10.0)), (6, "Gaas", geo(60.01, 10.0)), (7, "Elg", geo(61.0, 10.0))',
        "insert rel into Meets values (1 -> 2), (2 -> 3), (3 -> 1), (2 -> 1)",
        "insert rel into Minds values (2 -> 5), (3 -> 7)",
    )
    assert rows(e.ask("meets of meets of ulla")) == [("Tove",), ("Ulla",)]
    assert rows(e.ask("who do the guides ulla meets meets")) == [("Tove",), ("Ulla",)]
    assert rows(e.ask("looks after of meets of Ulla")) == [("Ravn",)]
    assert rows(e.ask("meets of is kept by of elg")) == [("Ulla",)]
    assert rows(e.ask("who meets ulla where fee over 60")) == [("Tove",)]
    assert [r[1] for r in rows(e.ask("huts within 2 km of ravn"))] == ["Ravn", "Gaas"]
    assert rows(e.ask("how many huts within 200 km of geo(60.5, 10)")) == [(3,)]
    assert rows(e.ask("what is elg"))[0][:2] == (7, "Elg")
    for q in ("huts within 2 km of nowhere", "looks after of looks after of per", "what is nothing"):
        with pytest.raises(NoParse):
            e.ask(q)


def test_commits_write_what_they_add(spark, tmp_path):
    import os

    e = build(spark, *PORTS, path=f"file://{tmp_path}/db")
    files = lambda: {d: sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/db/{d}")) for d in os.listdir(f"{tmp_path}/db") if os.path.isdir(f"{tmp_path}/db/{d}")}
    first = files()
    e.execute('insert into Port values (60, "Pori")')
    with e.begin() as tx:
        tx.execute('insert into Port values (70, "Vaasa")')
        tx.execute("insert rel into Sails values (60 -> 70, 4), (70 -> 60, 5)")
        tx.execute('insert into Port values (80, "Kemi")')
    added = {d: n for d, n in files().items() if d not in first}
    assert len(added) == 3 and {d.split(".")[0] for d in added} == {"port", "sails"}
    assert [spark.read.parquet(f"file://{tmp_path}/db/{d}").count() for d in sorted(added)] == [1, 2, 2]
    want = rows(e.query("nodes(Port) as p"))
    assert [r[0] for r in want] == [10, 20, 30, 40, 50, 60, 70, 80]
    again = Engine.open(spark, f"file://{tmp_path}/db")
    assert rows(again.query("nodes(Port) as p")) == want and len(again.paths["port"]) == 3
    again.execute('update Port set name = "Bergen" where id = 60')
    assert len(again.paths["port"]) == 1 and len(again.paths["sails"]) == 2
    assert again.compact() == 1 and again.compact() == 0 and len(again.paths["sails"]) == 1
    last = Engine.open(spark, f"file://{tmp_path}/db")
    assert rows(last.query("nodes(Port) as p | filter p.id = 60")) == [(60, "Bergen")] and last.stats() == {"Port": 8, "Sails": 9}
    last.execute("detach delete from Port where id = 80")
    last.execute('insert into Port values (80, "Oulu")')
    assert rows(Engine.open(spark, f"file://{tmp_path}/db").query("nodes(Port) as p | filter p.id = 80")) == [(80, "Oulu")]
