"""Every query of the core beside its DuckDB statement, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from weftgraph.operators import extract_queries, graph_queries, training_queries

TABLES = os.environ.get("WEFT_TABLES", "/root/testdata/sf0.001")
CORE = training_queries.queries() | graph_queries.queries() | extract_queries.queries()
SQL = __spark_entry__.oracle_sql()
#: Queries that no statement expresses; each has a test of its own.
WITHOUT = {"r11_communities", "r14_sprawl", "x_facts", "x_nodes", "x_edges", "x_boundaries", "x_diagnostics", "x_totals", "x12_functions", "x3_scene_nodes", "j1_resources", "x_rules", "i_export_type_mismatch"}
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_every_query_is_compared_or_listed():
    assert {n for n in CORE if n not in SQL} == WITHOUT


@pytest.mark.parametrize("name", sorted(n for n in CORE if n in SQL))
def test_query_equals_its_statement(spark, duck, name):
    df = CORE[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["r14_sprawl", "x_facts", "x_totals", "x12_functions", "x3_scene_nodes", "j1_resources"])
def test_other_queries_run(spark, name):
    assert CORE[name](spark, TABLES).count() >= 0
