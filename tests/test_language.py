"""Parsing, printing and JSON of plans and statements."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphquarry.errors import InvalidArgument
from graphquarry.plans.text import from_json, parse_query, parse_statement, print_expr, print_plan, to_json

TEXTS = [
    "nodes(P) as p | filter p.age > 30 and not (p.a = 1 or p.b - (p.c - 2) < -3.5) | project p.name, p.age + 1 as n | sort p.name desc | limit 3 offset 1",
    "let a = nodes(C) as c; let b = nodes(D) as d | join a on d.x = c.y; nodes(P) as p | left join b on c.k = p.k and p.z = d.z",
    "nodes(E) as e | aggregate count(e.id) as n, percentile_cont(decimal(\"0.5\"), e.v) as m by e.k, date_trunc(\"day\", e.t)",
    "knn(E.v, scalar(nodes(E) as e | filter e.id = 7 | project e.v), 10, cosine, approximate)",
    "within(P.l, geo(1, 2.5), 100) | expand Knows both as q | expand_rel R in from P as z via e",
    'textscan(D.body, "a \\"b\\"", k=3) as d | project scoreof(d), if(d.x = null, 1, 2) as y, classof(d) as c',
    "nodes(`my table`) as b | project round_div(b.x, 3, 2), least(b.x, b.y, 1), date_add(\"day\", b.t, 1), distance(b.v, [1, 0.5], l2)",
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    plan = parse_query(text)
    printed = print_plan(plan)
    assert parse_query(printed) == plan
    assert print_plan(parse_query(printed)) == printed
    assert from_json(to_json(plan)) == plan


@pytest.mark.parametrize(
    "text, says",
    [
        ("nodes(P) as p | Filter p.a = 1", "lower case"),
        ("nodes(P) as p | filter p.a < p.b < p.c", "parenthesize"),
        ("nodes(P) as p | limit -1", "negative"),
        ("nodes(P) as p | widen p.a", "stages are"),
        ("nodes(P) as p | join q on p.a = q.b", "no let named"),
        ("let q = nodes(Q) as q; nodes(P) as p | join q on p.a < q.b", "following filter"),
        ("nodes(P) as p | filter p.a = 9223372036854775808", "Int64"),
        ("nodes(P) as p | filter " + "(" * 129 + "true" + ")" * 129, "128"),
        ("nodes(P) as p | project coalesce(p.a)", "two arguments"),
        ("expand R out as q", "source"),
    ],
)
def test_refusals(text, says):
    with pytest.raises(InvalidArgument, match=says):
        parse_query(text)


def test_statements():
    s = parse_statement("create node table Person (id Int64 primary key, name String, v Vector(3, i8), d Decimal(10,2))")
    assert [c["type"] for c in s["columns"]] == ["Int64", "String", "Vector(3,i8)", "Decimal(10,2)"]
    assert parse_statement("insert rel into Knows values (1 -> 2, 5), (2 -> 1, null)")["rows"][1] == {"from_key": 2, "to_key": 1, "values": [None]}
    assert parse_statement("detach delete from P where id = 7") == {"stmt": "DetachDeleteNode", "table": "P", "key_column": "id", "key": 7}
    assert parse_statement('pin "a b" as nodes(P) as p')["text"] == "nodes(P) as p"
    assert parse_statement('create class for P (display "X", label name, implements (A, B))')["implements"] == ["A", "B"]
    with pytest.raises(InvalidArgument):
        parse_statement('create class for P (label name, display "X")')


leaves = st.one_of(
    st.integers(-(2**63), 2**63 - 1).map(lambda x: {"lit": x}),
    st.floats(allow_nan=False, allow_infinity=False).map(lambda x: {"lit": x}),
    st.text(st.characters(codec="utf-8")).map(lambda x: {"lit": x}),
    st.sampled_from([{"lit": None}, {"lit": True}, {"col": "a.b"}, {"col": "a.my col"}, {"col": "`.and"}]),
)
exprs = st.recursive(
    leaves,
    lambda e: st.one_of(
        st.tuples(st.sampled_from("eq ne lt le gt ge and or add sub mul div".split()), e, e).map(lambda t: {t[0]: [t[1], t[2]]}),
        e.map(lambda x: {"not": x}),
        st.lists(e, min_size=2, max_size=3).map(lambda x: {"coalesce": x}),
        st.tuples(e, e, e).map(lambda t: {"if": {"cond": t[0], "then": t[1], "else": t[2]}}),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(exprs)
def test_expressions_round_trip(e):
    plan = {"op": "Filter", "predicate": e, "input": {"op": "ScanNodes", "table": "T", "binding": "a"}}
    text = print_plan(plan)
    assert parse_query(text) == plan, print_expr(e)
