"""Every registered graph query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from graphquarry import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = Q.queries()[name](spark, DIR)
    got, cols = [tuple(r) for r in df.collect()], df.columns
    found = duck.execute(Q.oracle_sql()[name])
    theirs = [d[0] for d in found.description]
    assert sorted(cols) == sorted(theirs)

    def canonical(rows, names):
        return sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)

    assert canonical(got, cols) == canonical(found.fetchall(), theirs)


def test_whole_tables(spark, duck):
    rows = {n: Q.queries()[n](spark, DIR).count() for n in ("g1_expand_out", "g1_expand_both_distinct", "e7_kleene", "e10_float_division")}
    assert set(rows.values()) == {duck.execute("select count(*) from orders").fetchone()[0]}
