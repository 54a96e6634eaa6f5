"""Queries on tables the samples don't hold: other values, or many rows for one key."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph import GraphSession, JunctionEdge, NodeMapping, queries
from weftgraph.operators import patterns

from tests.test_queries import ORACLE, QUERIES, SF, TABLES, plain


def tables(folder, **changed):
    """A folder of the sample's tables, those given made by SQL instead; and a connection to it."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if t in changed:
            con.sql(f"COPY ({changed[t].format(t=f"'{SF}/{t}.parquet'")}) TO '{path}' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", path)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return str(folder), con


def same(spark, folder, con, name):
    got, found = QUERIES[name](spark, folder), con.sql(ORACLE[name])
    have = sorted(str([plain(r[c]) for c in found.columns]) for r in got.collect())
    want = sorted(str([plain(x) for x in r]) for r in found.fetchall())
    assert have == want
    return len(want)


def test_set_edge_leaves_out_edges_that_were_zero_before(spark, tmp_path):
    folder, con = tables(tmp_path, customer="SELECT * REPLACE(CASE WHEN c_custkey % 10 = 0 THEN 0.0 WHEN c_custkey % 10 = 1 THEN 9500.0 ELSE c_acctbal END AS c_acctbal) FROM {t}")
    assert same(spark, folder, con, "set_edge") > 10


def test_exists_with_two_outer_nodes_keeps_one_row_for_each_node(spark, tmp_path):
    """What EXISTS holds against the outer rows doesn't grow with the pairs of customers and suppliers."""
    changed = {"customer": "SELECT * REPLACE(CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 < 9 THEN 9999 - c_custkey % 7 * 300 ELSE c_acctbal END AS c_acctbal) FROM {t}",
               "supplier": "SELECT t.* REPLACE(s_suppkey + 1000 * i AS s_suppkey, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal) FROM {t} t, range(50) r(i)"}
    folder, con = tables(tmp_path, **changed)
    assert same(spark, folder, con, "exists_two_outer") > 10
    assert same(spark, folder, con, "exists_free_start") > 0
    plan = QUERIES["exists_two_outer"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    semi = plan[plan.index("LeftSemi") :]
    assert "max(" in semi and "c_acctbal" not in semi.split("Aggregate", 1)[1]


def test_exists_comparisons_against_sql(spark, tmp_path):
    """Every comparison with an outer value, either way round, negated and inside OR; nulls and equal values among them."""
    numbers = "CASE WHEN {k} % 11 = 0 THEN NULL ELSE (hash({k}) % 4)::DOUBLE END"
    changed = {"customer": "SELECT * REPLACE(" + numbers.replace("{k}", "c_custkey") + " AS c_acctbal) FROM {t}",
               "supplier": "SELECT * REPLACE(" + numbers.replace("{k}", "s_suppkey") + " AS s_acctbal) FROM {t}"}
    folder, con = tables(tmp_path, **changed)
    g = queries.graph(spark, folder)
    for op, turned in (("=", "="), ("<>", "<>"), ("<", ">"), ("<=", ">="), (">", "<"), (">=", "<=")):
        for cond in (f"s.s_acctbal {op} c.c_acctbal", f"c.c_acctbal {turned} s.s_acctbal", f"s.s_acctbal {op} c.c_acctbal AND s.s_nationkey = c.c_nationkey"):
            inside = f"EXISTS {{ (s:Supplier)-[:BASED_IN]->(n) WHERE {cond} }}"
            sql = f"EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey = c_nationkey AND {cond})"
            wrapped = [(inside, sql), (f"NOT {inside}", f"NOT {sql}"), (f"c.c_custkey < 20 OR {inside}", f"c.c_custkey < 20 OR {sql}")]
            for held, asked in wrapped if cond.startswith("c.") else wrapped[:1]:
                got = g.compile(f"MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) WHERE {held} RETURN c.c_custkey AS k")
                want = con.sql(f"SELECT c_custkey FROM customer c WHERE {asked}").fetchall()
                assert sorted(r.k for r in got.collect()) == sorted(k for (k,) in want), held


@pytest.mark.parametrize("longest", [10**6, 0])
def test_pairs_of_a_comma_pattern_are_dealt_over_tasks(spark, tmp_path, monkeypatch, longest):
    """With the shorter side broadcast, and where it is too long for that; one nation holds most rows."""
    monkeypatch.setattr(patterns, "PAIRS", 300)
    monkeypatch.setattr(patterns, "LEAST_BYTES", 0)
    monkeypatch.setattr(patterns, "BROADCAST_ROWS", longest)
    changed = {"customer": "SELECT * REPLACE(CASE WHEN c_custkey % 3 > 0 THEN 1 WHEN c_custkey % 30 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey) FROM {t}",
               "supplier": "SELECT t.* REPLACE(s_suppkey + 1000 * i AS s_suppkey, CASE WHEN i < 30 THEN 1 ELSE s_nationkey END AS s_nationkey, s_acctbal + 3000 AS s_acctbal) FROM {t} t, range(60) r(i)"}
    folder, con = tables(tmp_path, **changed)
    pairs = same(spark, folder, con, "comma_bridge")
    assert pairs > 3000
    sizes = QUERIES["comma_bridge"](spark, folder).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < pairs / 2
    # The bindings may be the shorter side, too, and pairs needn't be joined by equal values.
    g = queries.graph(spark, folder)
    got = g.compile("MATCH (s:Supplier), (c:Customer) WHERE c.c_nationkey = s.s_nationkey AND s.s_acctbal > 8000 RETURN count(*) AS n, sum(c.c_custkey * 7 + s.s_suppkey) AS t").first()
    assert (got.n, got.t) == con.sql("SELECT count(*), sum(c_custkey * 7 + s_suppkey)::BIGINT FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 8000").fetchall()[0]
    got = g.compile("MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey < s.s_nationkey RETURN count(*) AS n").first()
    assert (got.n,) == con.sql("SELECT count(*) FROM customer JOIN supplier ON c_nationkey < s_nationkey").fetchall()[0]


def test_length_of_a_path_reads_no_nodes_of_it(spark):
    """The joins of all_shortest_paths carry ends and lengths only; no edges are written by levels."""
    got = QUERIES["all_shortest_paths"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "nodes" not in plan and "hops" in plan


def test_shortest_paths_of_one_type_keep_their_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1)], "a long, b long")
    g = GraphSession(spark)
    g.register_node(NodeMapping("Stop", spark.createDataFrame([(k,) for k in range(1, 6)], "sid long"), "sid"))
    g.register_edge(JunctionEdge("LEADS", "Stop", "Stop", pairs, "a", "b"))
    got = g.compile("MATCH p = allShortestPaths((x:Stop {sid: 1})-[:LEADS*1..4]-(y:Stop)) RETURN y.sid AS y, length(p) AS n, size(relationships(p)) AS m, relationships(p)[0].labels[0] AS t, [q IN nodes(p) | q.id] AS via")
    have = sorted((r.y, r.n, r.m, r.t, tuple(r.via)) for r in got.collect())
    assert have == [(2, 1, 1, "LEADS", ("1", "2")), (3, 2, 2, "LEADS", ("1", "2", "3")), (3, 2, 2, "LEADS", ("1", "4", "3")), (3, 2, 2, "LEADS", ("1", "5", "3")), (4, 1, 1, "LEADS", ("1", "4")), (5, 1, 1, "LEADS", ("1", "5"))]
    assert [tuple(r) for r in g.compile("MATCH p = shortestPath((x:Stop {sid: 2})-[:LEADS*0..2]->(y:Stop)) RETURN y.sid AS y, length(p) AS n ORDER BY y").collect()] == [(2, 0), (3, 1), (5, 2)]
