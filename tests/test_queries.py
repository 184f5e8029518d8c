"""A sample of registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodegraph.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["impact", "criticality", "layer_kinds", "analyze_changes", "cohesion", "bm25", "tfidf_search", "watch_batches"])
def test_query(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want and want


@pytest.mark.parametrize("name", ["graph_stats", "criticality", "refactor_suggestions", "coupling", "orphans", "infer_role", "orders_without_lines", "customers_without_orders"])
def test_whole_query(spark, name):
    """All orders and lines, against SQL; some of the anti-joins have no rows."""
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(map(repr, cur.fetchall()))


def test_whole_roles_hold_every_page(spark):
    got = entry.queries()["infer_role"](spark, SF).collect()
    assert sum(r.pages for r in got) == tables.table(spark, SF, "pages").count() and len({r.role for r in got}) > 2


def test_whole_edges(spark):
    """Every order imports its customer, every order and supplier of a line is called."""
    e = tables.star_graph(spark, SF).edges
    t = lambda name: tables.table(spark, SF, name)
    assert e.where("kind = 'imports' and from_id like 'file:order/%'").count() == t("orders").count()
    assert e.where("kind = 'calls' and from_id like 'file:order/%'").count() == t("lineitem").select("l_orderkey", "l_suppkey").distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["layers", "view_edges", "deps_direct", "derive_name", "wiki_pages", "dominant_language", "bundle_symbols"])
def test_broadcasts_are_measured(spark, name):
    """Stored ids are fifty times smaller than in memory, so no plan may broadcast a table for the size of its files."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before != "-1"
