"""Every named query against its SQL in DuckDB, and the shape of some plans."""

import decimal

import duckdb
import pytest

from vaultql.plans import catalog, changes, indexed, vault  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLE[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_predicates_reach_the_scan(spark):
    shown = plan(catalog.QUERIES["find_in"](spark, SF))
    assert "PushedFilters: [In(source" in shown and "text" not in shown.split("ReadSchema")[1].split(">")[0]


@pytest.mark.parametrize("name", ["closest_match", "find_links_to_all", "link_ambiguous", "stem_collisions"])
def test_no_cartesian_products(spark, name):
    shown = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
