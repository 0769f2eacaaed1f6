"""Every registered query against DuckDB at the smallest size, and the dialect's own rules."""

import math

import duckdb
import pytest

from relspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_oracle(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=repr)
    assert got == want


def test_plans_prune_and_push(spark):
    plan = catalogue.queries()["filter_compare"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "o_orderdate" not in plan


@pytest.mark.parametrize(
    "sql",
    [
        catalogue.oracle_sql()["lateral_topn"],
        "SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 OFFSET 1) x ON true",
        "SELECT c_custkey, x.p FROM customer, LATERAL (SELECT -o_totalprice AS p, o_orderkey k FROM orders WHERE o_custkey = c_custkey ORDER BY ABS(p + 150000), k, o_orderdate LIMIT 2) x",
        "SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY ABS(o_totalprice - c_acctbal), 1 LIMIT 1) x",
        "SELECT c_custkey, x.o_orderstatus FROM customer, LATERAL (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey GROUP BY o_orderstatus ORDER BY COUNT(*) DESC, MAX(o_orderkey) LIMIT 1) x",
        "SELECT c_custkey, x.k FROM customer, LATERAL (SELECT y.k FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice, o_orderkey LIMIT 3) y WHERE y.s = 'O') x",
        "SELECT c_custkey, (SELECT o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderpriority COLLATE NOCASE DESC, o_orderkey LIMIT 1) AS d FROM customer",
    ],
)
def test_limits_of_correlated_subqueries_follow_the_sort_keys(spark, con, sql):
    """Rows of a key arrive in any order when executors fetch from each other; so the numbers that stand for LIMIT need an order of their own."""
    df = catalogue.run_sql(spark, SF, sql)
    numbered = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number() windowspecdefinition" in line]
    assert numbered and all("SC NULLS" in line for line in numbered)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, con.execute(sql).fetchall()))
