"""Registered queries: plan text over the star graph, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphquarry.engine import Engine
from graphquarry.scenarios import SCENARIOS
from graphquarry.sources.catalog import Catalog
from graphquarry.sources.star import graph

D = "DECIMAL(15,2)"
#: name: (plan text, SQL or None where SQL can't express it)
TEXTS: dict[str, tuple[str, str | None]] = {
    "q_flagship": (
        'nodes(Orders) as o | filter o.o_totalprice > decimal("100000.00") | aggregate count(o.o_orderkey) as n, sum(o.o_totalprice) as total by o.o_orderstatus | sort o.o_orderstatus',
        'SELECT o_orderstatus AS "o.o_orderstatus", count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY 1',
    ),
}


def _register(name: str, text: str, sql: str | None) -> None:
    TEXTS[name] = (text, sql)


# sources
_register("s1_scan_nodes", "nodes(Nation) as n | project n.n_nationkey as k, n.n_name as name", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
_register(
    "s2_scan_interface",
    "nodes(Nameable) as x | project classof(x) as class, x.name as name",
    "SELECT 'Region' AS class, r_name AS name FROM region UNION ALL SELECT 'Nation', n_name FROM nation UNION ALL SELECT 'Customer', c_name FROM customer UNION ALL SELECT 'Supplier', s_name FROM supplier UNION ALL SELECT 'Part', p_name FROM part",
)
_register("s2_scan_interface_empty", "nodes(Dormant) as x | project classof(x) as class, x.name as name", "SELECT 'x' AS class, 'x' AS name WHERE false")
_register(
    "s3_textscan",
    'textscan(Document.text, "the ont", k=20) as d | project d.doc_id as id',
    """WITH toks AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CAST(len(t) AS HUGEINT) AS dl, CAST(len(list_filter(t, lambda x: x = 'the')) AS HUGEINT) AS a, CAST(len(list_filter(t, lambda x: x = 'ont')) AS HUGEINT) AS b FROM toks),
s AS (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(dl) AS HUGEINT) AS total, CAST(count(*) FILTER (a > 0) AS HUGEINT) AS da, CAST(count(*) FILTER (b > 0) AS HUGEINT) AS db FROM c),
sc AS (SELECT doc_id,
 CASE WHEN a > 0 THEN ln(2.0 * (n + 1) / (2 * da + 1)) * (a * 2.2) / (a + 1.2 * (0.25 + 0.75 * dl * n / total)) ELSE 0 END + CASE WHEN b > 0 THEN ln(2.0 * (n + 1) / (2 * db + 1)) * (b * 2.2) / (b + 1.2 * (0.25 + 0.75 * dl * n / total)) ELSE 0 END AS score FROM c, s WHERE a + b > 0)
SELECT doc_id AS id FROM sc ORDER BY round(score, 7) DESC, doc_id LIMIT 20""",
)
_VEC = "[" + ", ".join(str(round(((i * 37) % 19 - 9) / 10, 1)) for i in range(64)) + "]"
_DUCK_VEC = f"CAST({_VEC} AS FLOAT[])"
_DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), lambda s, x: s + x)"
_L2 = "sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), lambda s, x: s + x))"
_register("s4_knn_l2", f"knn(Embedding.embedding, {_VEC}, 10, l2) | project Embedding.vec_id as id", f"SELECT vec_id AS id FROM embeddings ORDER BY {_L2.format(a='embedding', b=_DUCK_VEC)}, vec_id LIMIT 10")
_COS = "1.0 - {d} / (sqrt({x}) * sqrt({y}))".format(d=_DOT.format(a="{a}", b="{b}"), x=_DOT.format(a="{a}", b="{a}"), y=_DOT.format(a="{b}", b="{b}"))
_register("s4_knn_cosine", f"knn(Embedding.embedding, {_VEC}, 10, cosine, approximate) | project Embedding.vec_id as id", f"SELECT vec_id AS id FROM embeddings ORDER BY {_COS.format(a='embedding', b=_DUCK_VEC)}, vec_id LIMIT 10")
_register(
    "s4_knn_scalar",
    "knn(Embedding.embedding, scalar(nodes(Embedding) as e | filter e.vec_id = 7 | project e.embedding), 5, l2) | project Embedding.vec_id as id",
    f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id FROM embeddings, q ORDER BY {_L2.format(a='embedding', b='e')}, vec_id LIMIT 5",
)
_LAT, _LNG = "((c_custkey * 37) % 18000 / 100.0::DOUBLE - 90)", "((c_custkey * 91) % 36000 / 100.0::DOUBLE - 180)"
_register(
    "s5_within",
    "within(Customer.place, geo(10.0, 20.0), 3000000) | project Customer.c_custkey as id",
    f"SELECT c_custkey AS id FROM customer WHERE 2 * 6371007.180918475 * asin(least(1.0, sqrt(power(sin(radians({_LAT} - 10) / 2), 2) + cos(radians({_LAT})) * cos(radians(10)) * power(sin(radians({_LNG} - 20) / 2), 2)))) <= 3000000",
)

# traversal
_register("g1_expand_in", "nodes(Region) as r | expand InRegion in as n | project r.r_name as region, n.n_name as nation", "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey")
_FOLLOWS = "(SELECT c_custkey AS f, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey // 2 + 1 END AS t, c_custkey % 7 AS weight FROM customer)"
_register(
    "g1_two_hops",
    "nodes(Customer) as c | expand Placed out as o | expand Contains out as p | aggregate count(p.p_partkey) as n by p.p_brand",
    'SELECT p_brand AS "p.p_brand", count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1',
)
_register(
    "g1_expand_after_project",
    "nodes(Customer) as c | project c.c_name as who | expand Placed out from c as o | project o.o_orderkey as o",
    "SELECT o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey",
)
_register(
    "g2_expand_rel",
    'nodes(Orders) as o | expand_rel Contains out as p via l | filter l.l_returnflag = "R" and l.l_quantity > 45.0 | project o.o_orderkey as o, p.p_partkey as p, l.l_linenumber as line, l.l_quantity as q',
    "SELECT l_orderkey AS o, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45",
)
_register(
    "g2_expand_rel_both",
    "nodes(Customer) as c | expand_rel Follows both as d via e | aggregate sum(e.weight) as w, count(d.c_custkey) as n by c.c_mktsegment",
    f"WITH e AS {_FOLLOWS}, b AS (SELECT f AS a, t AS b, weight FROM e UNION ALL SELECT t, f, weight FROM e WHERE f <> t) SELECT c.c_mktsegment AS \"c.c_mktsegment\", CAST(sum(weight) AS BIGINT) AS w, count(*) AS n FROM b JOIN customer c ON c.c_custkey = b.a JOIN customer d ON d.c_custkey = b.b GROUP BY 1",
)

# rows
_register("r1_filter", "nodes(Lineitem) as l | filter l.l_linenumber = 1 and not (l.l_returnflag = \"N\" or l.l_linestatus = \"O\") | project l.l_orderkey as o, l.l_partkey as p", "SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber = 1 AND NOT (l_returnflag = 'N' OR l_linestatus = 'O')")
_register("r2_project", "nodes(Orders) as o | project o.o_orderkey as k, o.o_orderkey * 2 + 1 as odd, o.o_totalprice as price", f"SELECT o_orderkey AS k, o_orderkey * 2 + 1 AS odd, CAST(o_totalprice AS {D}) AS price FROM orders")
_register("r3_sort_limit", "nodes(Orders) as o | sort o.o_orderpriority desc, o.o_totalprice | limit 25 offset 5 | project o.o_orderkey as k", f"SELECT o_orderkey AS k FROM orders ORDER BY o_orderpriority DESC, CAST(o_totalprice AS {D}), o_orderkey LIMIT 25 OFFSET 5")
_register("r4_limit_scan_order", "nodes(Document) as d | limit 7 offset 3 | project d.doc_id as id", "SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 7 OFFSET 3")
_register("r5_top_k_stable", "nodes(Customer) as c | sort c.c_mktsegment | limit 40 | project c.c_custkey as k", "SELECT c_custkey AS k FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 40")

# joins
_register("j1_inner", "let s = nodes(Label) as l; nodes(Document) as d | join s on d.doc_id = l.doc_id | project d.doc_id as id, l.quality as quality, d.lang as lang", "SELECT d.doc_id AS id, CAST(quality AS BIGINT) AS quality, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
_register("j2_left", "let s = nodes(Label) as l; nodes(Document) as d | left join s on d.doc_id = l.doc_id | project d.doc_id as id, l.toxic as toxic", "SELECT d.doc_id AS id, CAST(toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_register(
    "j3_composite",
    "let s = nodes(Supplier) as s; nodes(Customer) as c | join s on c.c_nationkey = s.s_nationkey and s.s_suppkey = c.c_custkey | project c.c_custkey as k",
    "SELECT c_custkey AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_suppkey = c_custkey",
)
_register(
    "j3_join_after_aggregate",
    "let t = nodes(Orders) as o | aggregate sum(o.o_totalprice) as `t.total` by o.o_custkey | project o.o_custkey as `o.k`, t.total; nodes(Customer) as c | left join t on c.c_custkey = o.k | project c.c_custkey as k, t.total as total",
    f"SELECT c_custkey AS k, total FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS {D})) AS DECIMAL(25,2)) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
_register("j4_anti", "let s = nodes(Label) as l; nodes(Document) as d | left join s on d.doc_id = l.doc_id | filter coalesce(l.doc_id = l.doc_id, false) = false | project d.doc_id as id", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_register("j5_semi", "let s = nodes(Label) as l | aggregate by l.doc_id | project l.doc_id as `l.id`; nodes(Document) as d | join s on d.doc_id = l.id | project d.doc_id as id", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")

# aggregates
_register(
    "a1_to_a6_grouped",
    "nodes(Lineitem) as l | aggregate count(l.line_id) as n, sum(l.l_linenumber) as s, sum(l.l_quantity) as q, min(l.l_shipdate) as first, max(l.l_extendedprice) as dearest, avg(l.l_linenumber) as mean by l.l_returnflag",
    f'SELECT l_returnflag AS "l.l_returnflag", count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(CAST(l_quantity AS {D})) AS DECIMAL(25,2)) AS q, min(l_shipdate) AS first, max(CAST(l_extendedprice AS {D})) AS dearest, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS mean FROM lineitem GROUP BY 1',
)
_register("a_ungrouped_empty", "nodes(Orders) as o | filter o.o_orderkey < 0 | aggregate count(o.o_orderkey) as n, max(o.o_orderkey) as m, sum(o.o_custkey) as s", "SELECT count(*) AS n, max(o_orderkey) AS m, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
_register("a_distinct", "nodes(Orders) as o | aggregate by o.o_orderstatus, o.o_orderpriority", 'SELECT DISTINCT o_orderstatus AS "o.o_orderstatus", o_orderpriority AS "o.o_orderpriority" FROM orders')
_register("a_null_group", "nodes(Orders) as o | aggregate count(o.o_orderkey) as n by if(o.o_orderkey < 100, null, o.o_orderstatus)", "SELECT CASE WHEN o_orderkey < 100 THEN NULL ELSE o_orderstatus END AS \"if(o.o_orderkey < 100, null, o.o_orderstatus)\", count(*) AS n FROM orders GROUP BY 1")
_register(
    "a8_median",
    'nodes(Customer) as c | aggregate percentile_cont(decimal("0.5"), coalesce(c.c_acctbal * 10, null)) as m by c.c_mktsegment',
    f"""SELECT c_mktsegment AS "c.c_mktsegment", CAST(CASE WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1] * 10 ELSE (a[len(a) // 2] + a[len(a) // 2 + 1]) * 5 END AS DECIMAL(34,2)) AS m FROM (SELECT c_mktsegment, list_sort(list(CAST(c_acctbal AS {D}))) AS a FROM customer GROUP BY 1)""",
)

# expressions
_register("e3_compare", "nodes(Event) as e | filter e.event_type != \"click\" and e.user_id <= 100 | project e.event_id as id", "SELECT event_id AS id FROM events WHERE event_type <> 'click' AND user_id <= 100")
_register("e4_int_float_exact", "nodes(Orders) as o | project o.o_orderkey as k, o.o_orderkey < 10.5 as lt, o.o_orderkey = 7.0 as eq, 9007199254740993 = 9007199254740992.0 as big", "SELECT o_orderkey AS k, o_orderkey < 10.5 AS lt, o_orderkey = 7 AS eq, false AS big FROM orders")
_register("e8_int_arithmetic", "nodes(Orders) as o | project o.o_orderkey as k, o.o_orderkey - o.o_custkey as d, (0 - o.o_orderkey) / 7 as q, o.o_orderkey * 3 + 1 as m", "SELECT o_orderkey AS k, o_orderkey - o_custkey AS d, (0 - o_orderkey) // 7 AS q, o_orderkey * 3 + 1 AS m FROM orders")
TEXTS["e8_int_arithmetic"] = (TEXTS["e8_int_arithmetic"][0], "SELECT o_orderkey AS k, o_orderkey - o_custkey AS d, CAST(trunc((0 - o_orderkey) / 7.0) AS BIGINT) AS q, o_orderkey * 3 + 1 AS m FROM orders")
_register(
    "e11_decimal",
    'nodes(Lineitem) as l | project l.l_orderkey as k, l.l_extendedprice + l.l_tax as a, l.l_extendedprice - l.l_discount as s, l.l_extendedprice * l.l_discount as m, l.l_extendedprice * 3 as t, l.l_quantity > decimal("25.00") as big',
    f"SELECT l_orderkey AS k, CAST(CAST(l_extendedprice AS {D}) + CAST(l_tax AS {D}) AS DECIMAL(16,2)) AS a, CAST(CAST(l_extendedprice AS {D}) - CAST(l_discount AS {D}) AS DECIMAL(16,2)) AS s, CAST(CAST(l_extendedprice AS {D}) * CAST(l_discount AS {D}) AS DECIMAL(30,4)) AS m, CAST(CAST(l_extendedprice AS {D}) * 3 AS DECIMAL(34,2)) AS t, CAST(l_quantity AS {D}) > 25 AS big FROM lineitem",
)
_register("e15_if_coalesce", "nodes(Orders) as o | project o.o_orderkey as k, if(o.o_orderkey < 50, \"low\", o.o_orderstatus) as s, coalesce(if(o.o_custkey < 20, null, o.o_custkey), 0) as c", "SELECT o_orderkey AS k, CASE WHEN o_orderkey < 50 THEN 'low' ELSE o_orderstatus END AS s, CASE WHEN o_custkey < 20 THEN 0 ELSE o_custkey END AS c FROM orders")
_register("e17_least_greatest", "nodes(Orders) as o | project o.o_orderkey as k, least(o.o_orderkey, if(o.o_custkey < 30, null, o.o_custkey)) as l, greatest(o.o_orderkey, o.o_custkey, 100) as g", "SELECT o_orderkey AS k, CASE WHEN o_custkey < 30 THEN o_orderkey ELSE least(o_orderkey, o_custkey) END AS l, greatest(o_orderkey, o_custkey, 100) AS g FROM orders")
_register("e18_date_trunc", 'nodes(Event) as e | aggregate count(e.event_id) as n by date_trunc("day", e.ts)', "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS \"date_trunc(\"\"day\"\", e.ts)\", count(*) AS n FROM events GROUP BY 1")
_register("e19_date_add", 'nodes(Event) as e | project e.event_id as id, date_add("day", e.ts, 0 - 3) as t', "SELECT event_id AS id, ts - INTERVAL 3 DAY AS t FROM events")
_register("e20_round", "nodes(Lineitem) as l | project l.l_orderkey as k, l.l_linenumber as n, round(l.l_extendedprice, 1) as r", f"SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(round(CAST(l_extendedprice AS {D}), 1) AS {D}) AS r FROM lineitem")
_register(
    "e21_round_div",
    "nodes(Orders) as o | project o.o_orderkey as k, round_div(o.o_totalprice, 7, 2) as q",
    f"SELECT o_orderkey AS k, CAST((CAST(CAST(o_totalprice AS {D}) * 100 AS HUGEINT) * 2 + 7) // 14 AS DECIMAL(38,0)) / 100 AS q FROM orders",
)
TEXTS["e21_round_div"] = (TEXTS["e21_round_div"][0], f"SELECT o_orderkey AS k, CAST(CAST((CAST(CAST(o_totalprice AS {D}) * 100 AS HUGEINT) * 2 + 7) // 14 AS DECIMAL(20,0)) * 0.01 AS {D}) AS q FROM orders")
_register("e22_distance", f"nodes(Embedding) as e | project e.vec_id as id, distance(e.embedding, {_VEC}, l2) as d, distance(e.embedding, {_VEC}, cosine) as c", f"SELECT vec_id AS id, {_L2.format(a='embedding', b=_DUCK_VEC)} AS d, {_COS.format(a='embedding', b=_DUCK_VEC)} AS c FROM embeddings")
_register("e26_is_null", "nodes(Orders) as o | filter coalesce(if(o.o_orderkey < 9, null, o.o_custkey) = o.o_custkey, false) = false | project o.o_orderkey as k", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey < 9")

# scalar queries
_register("x1_scalar_uncorrelated", "nodes(Orders) as o | filter o.o_totalprice >= scalar(nodes(Orders) as x | aggregate max(x.o_totalprice) as m) | project o.o_orderkey as k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)")
_register("x2_scalar_correlated", "nodes(Customer) as c | project c.c_custkey as k, scalar(nodes(Orders) as o | filter o.o_custkey = c.c_custkey | aggregate count(o.o_orderkey) as n) as n", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
_register("x3_scalar_none", "nodes(Nation) as n | project n.n_nationkey as k, scalar(nodes(Region) as r | filter r.r_regionkey = n.n_nationkey | project r.r_name) as name", "SELECT CAST(n_nationkey AS BIGINT) AS k, r_name AS name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
_register("x4_scalar_in_sort", "nodes(Nation) as n | sort scalar(nodes(Customer) as c | filter c.c_nationkey = n.n_nationkey | aggregate count(c.c_custkey) as k) desc | limit 5 | project n.n_nationkey as k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation ORDER BY (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) DESC, n_nationkey LIMIT 5")

_register(
    "x5_scalar_groups_inside",
    "nodes(Nation) as n | project n.n_nationkey as k, scalar(nodes(Customer) as c | aggregate count(c.c_custkey) as `g.n` by c.c_nationkey, c.c_mktsegment | filter c.c_nationkey = n.n_nationkey | aggregate max(g.n) as m) as m",
    "WITH g AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT CAST(n_nationkey AS BIGINT) AS k, max(g.n) AS m FROM nation LEFT JOIN g ON g.k = n_nationkey GROUP BY 1",
)
_register(
    "x6_scalar_trailing_median",
    'nodes(Nation) as n | project n.n_nationkey as k, scalar(nodes(Customer) as c | aggregate sum(c.c_acctbal * 10) as `h.s` by c.c_nationkey | filter c.c_nationkey >= n.n_nationkey - 3 and c.c_nationkey < n.n_nationkey | aggregate percentile_cont(decimal("0.5"), h.s) as m) as m, scalar(nodes(Customer) as d | aggregate sum(d.c_acctbal) as `t.s` by d.c_nationkey | filter d.c_nationkey > n.n_nationkey | aggregate count(t.s) as m) as later',
    f"""WITH h AS (SELECT c_nationkey AS k, sum(CAST(c_acctbal AS {D})) AS s FROM customer GROUP BY 1), w AS (SELECT n_nationkey AS k, list_sort(list(h.s) FILTER (h.k >= n_nationkey - 3 AND h.k < n_nationkey)) AS a, count(h.s) FILTER (h.k > n_nationkey) AS later FROM nation CROSS JOIN h GROUP BY 1)
SELECT CAST(k AS BIGINT) AS k, CAST(CASE WHEN a IS NULL OR len(a) = 0 THEN NULL WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1] * 10 ELSE (a[len(a) // 2] + a[len(a) // 2 + 1]) * 5 END AS DECIMAL(38,2)) AS m, later FROM w""",
)

# traversal and expressions over whole tables
_register("g1_expand_out", "nodes(Customer) as c | expand Placed out as o | project c.c_custkey as c, o.o_orderkey as o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey")
_register(
    "g1_expand_both_self",
    "nodes(Customer) as c | expand Follows both as d | project c.c_custkey as a, d.c_custkey as b",
    f"WITH e AS {_FOLLOWS}, b AS (SELECT f AS a, t AS b FROM e UNION ALL SELECT t, f FROM e WHERE f <> t) SELECT b.a, b.b FROM b JOIN customer x ON x.c_custkey = b.a JOIN customer y ON y.c_custkey = b.b",
)
_register("g1_expand_both_distinct", "nodes(Orders) as o | expand Placed both as c | project o.o_orderkey as o, c.c_custkey as c", "SELECT o_orderkey AS o, o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey")
_register("e7_kleene", "nodes(Orders) as o | project o.o_orderkey as k, null and o.o_orderkey < 5 as a, null or o.o_orderkey < 5 as b, not (o.o_orderkey = null) as c", "SELECT o_orderkey AS k, NULL AND o_orderkey < 5 AS a, NULL OR o_orderkey < 5 AS b, CAST(NULL AS BOOLEAN) AS c FROM orders")
_register("e10_float_division", "nodes(Orders) as o | project o.o_orderkey as k, o.o_orderkey / 4.0 as q, 1.0 / 0.0 > 5.0 as inf, 0.0 / 0.0 = 0.0 / 0.0 as nan", "SELECT o_orderkey AS k, o_orderkey / 4.0::DOUBLE AS q, true AS inf, false AS nan FROM orders")

#: English questions: name -> (question, SQL)
QUESTIONS: dict[str, tuple[str, str]] = {
    "nl_list": ("show all regions", "SELECT CAST(r_regionkey AS BIGINT) AS \"region.r_regionkey\", r_name AS \"region.r_name\", r_name AS \"region.name\" FROM region"),
    "nl_filter": ("labels where quality over 0", "SELECT doc_id AS \"label.doc_id\", CAST(quality AS BIGINT) AS \"label.quality\", CAST(toxic AS BIGINT) AS \"label.toxic\" FROM labels WHERE quality > 0"),
    "nl_count": ("how many customers", "SELECT count(*) AS count FROM customer"),
    "nl_count_by": ("how many customers by c_mktsegment", "SELECT c_mktsegment AS \"customer.c_mktsegment\", count(*) AS count FROM customer GROUP BY 1"),
    "nl_total": ("total o_totalprice of orders by o_orderstatus", f"SELECT o_orderstatus AS \"orders.o_orderstatus\", CAST(sum(CAST(o_totalprice AS {D})) AS DECIMAL(25,2)) AS total FROM orders GROUP BY 1"),
    "nl_between": ("labels quality between 0 and 0", "SELECT doc_id AS \"label.doc_id\", CAST(quality AS BIGINT) AS \"label.quality\", CAST(toxic AS BIGINT) AS \"label.toxic\" FROM labels WHERE quality = 0"),
}


_catalogs: dict[tuple[int, str], tuple[SparkSession, Catalog]] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over a folder of tables, whose schemas are read once a session."""
    key = (id(spark), sf_dir)
    if key not in _catalogs or _catalogs[key][0] is not spark:
        if len(_catalogs) >= 16:
            _catalogs.clear()
        _catalogs[key] = (spark, graph(spark, sf_dir))
    return Engine(spark, catalog=_catalogs[key][1])


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(text, ordered=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _runner(text) for name, (text, _) in TEXTS.items()}
    for name, (question, _) in QUESTIONS.items():
        out[name] = lambda spark, sf_dir, q=question: engine(spark, sf_dir).ask(q)
    for name, (fn, _) in SCENARIOS.items():
        out[name] = lambda spark, sf_dir, fn=fn: fn(Engine(spark) if fn.starts_empty else engine(spark, sf_dir), sf_dir)
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TEXTS.items() if sql} | {name: sql for name, (_, sql) in QUESTIONS.items()} | {name: sql for name, (_, sql) in SCENARIOS.items()}
