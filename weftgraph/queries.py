"""Queries over the driver's tables, one or more for each operator, with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import GraphSession
from weftgraph.sources.catalog import ForeignKeyEdge, JunctionEdge, MultiValue, NodeMapping
from weftgraph.sources.store import PropertyGraphStore

#: Added to nation keys in the property store, so that they don't clash with customer keys.
PLACE = 1_000_000_000


def next_events(events: DataFrame) -> DataFrame:
    """Edges from each event to its user's next one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("event_id").alias("a"), F.lead("event_id").over(order).alias("b")).where("b is not null")


def graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    """The driver's tables as a graph."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = GraphSession(spark)
    orders, lineitem = t("orders"), t("lineitem")
    bought = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select("o_custkey", "l_partkey")
    turns = t("conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    for m in (
        NodeMapping("Region", t("region"), "r_regionkey"),
        NodeMapping("Nation", t("nation"), "n_nationkey"),
        NodeMapping("Customer", t("customer"), "c_custkey", multi_values={"parts": MultiValue(bought, "o_custkey", "l_partkey")}),
        NodeMapping("Supplier", t("supplier"), "s_suppkey"),
        NodeMapping("Part", t("part"), "p_partkey"),
        NodeMapping("Order", orders, "o_orderkey"),
        NodeMapping("Event", t("events"), "event_id", json_col="props"),
        NodeMapping("Document", t("documents"), "doc_id"),
        NodeMapping("Turn", turns, "id"),
    ):
        g.register_node(m)
    following = turns.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), "turn").join(turns.select(F.col("id").alias("b")), "b", "left_semi")
    for e in (
        ForeignKeyEdge("IN_REGION", "Nation", "Region", "n_regionkey"),
        ForeignKeyEdge("FROM_NATION", "Customer", "Nation", "c_nationkey"),
        ForeignKeyEdge("BASED_IN", "Supplier", "Nation", "s_nationkey"),
        ForeignKeyEdge("PLACED_BY", "Order", "Customer", "o_custkey"),
        JunctionEdge("CONTAINS", "Order", "Part", lineitem, "l_orderkey", "l_partkey"),
        JunctionEdge("SUPPLIED_BY", "Part", "Supplier", lineitem, "l_partkey", "l_suppkey"),
        JunctionEdge("NEXT", "Event", "Event", next_events(t("events")), "a", "b"),
        JunctionEdge("NEXT_TURN", "Turn", "Turn", following, "a", "b"),
    ):
        g.register_edge(e)
    return g


def stored(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Customers and nations in the property store: Buyer, Place, LIVES_IN."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    g = GraphSession(spark)
    buyers = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    places = n.select((F.col("n_nationkey") + PLACE).cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    lives = c.select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + PLACE).cast("bigint").alias("b"), F.col("c_acctbal").alias("since"))
    g.catalog.store = PropertyGraphStore.from_frames(spark, [("Buyer", buyers, "id"), ("Place", places, "id")], [("LIVES_IN", lives, "a", "b")])
    return g


class Case(NamedTuple):
    gql: str
    sql: str | None
    params: dict[str, Any] | None = None
    build: Callable[[SparkSession, str], GraphSession] = graph
    writes: tuple[str, ...] = ()


NEXT_SQL = "nx AS (SELECT * FROM (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"


def walk_sql(low: int, high: int, links: str = "nx") -> str:
    """A recursive walk over (a, b) edges: CTE walk(s, e, d, p), node-simple."""
    return f"""walk AS (SELECT event_id AS s, event_id AS e, 0 AS d, [event_id] AS p FROM events
      UNION ALL SELECT s, b, d + 1, list_append(p, b) FROM walk JOIN {links} ON e = a WHERE d < {high} AND NOT list_contains(p, b)),
    hits AS (SELECT * FROM walk WHERE d BETWEEN {low} AND {high})"""


def pagerank_sql(rounds: int) -> str:
    """A common table expression for each round of PageRank over NEXT."""
    start = "deg AS (SELECT a, count(*) AS d FROM nx GROUP BY a), t AS (SELECT count(*)::DOUBLE AS n FROM events), r0 AS MATERIALIZED (SELECT event_id AS id, 1.0::DOUBLE / n AS rank FROM events, t)"
    steps = [
        f"""r{k} AS MATERIALIZED (SELECT e.event_id AS id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank
  FROM events e CROSS JOIN t CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT a FROM deg))
  LEFT JOIN (SELECT b, sum(rank / d) AS got FROM nx JOIN r{k - 1} ON nx.a = id JOIN deg ON deg.a = nx.a GROUP BY b) ON b = e.event_id)"""
        for k in range(1, rounds + 1)
    ]
    return f"WITH {NEXT_SQL}, {start}, {', '.join(steps)} SELECT id, round(rank, 12) AS rank FROM r{rounds}"


CASES: dict[str, Case] = {
    # --- scans and predicates ---
    "node_scan_filter": Case("MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000"),
    "inline_props": Case("MATCH (c:Customer {c_mktsegment:'BUILDING'}) RETURN c.c_name AS n", "SELECT c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "inline_where": Case("MATCH (p:Part WHERE p.p_size > 40) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 40"),
    "or_precedence": Case("MATCH (c:Customer) WHERE c.c_acctbal > 9000 OR c.c_mktsegment = 'BUILDING' AND c.c_acctbal < 0 RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING' AND c_acctbal < 0"),
    "xor_op": Case("MATCH (c:Customer) WHERE c.c_acctbal > 5000 XOR c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE (c_acctbal > 5000) <> (c_mktsegment = 'BUILDING')"),
    "not_op": Case("MATCH (c:Customer) WHERE NOT (c.c_acctbal > 5000 OR c.c_nationkey = 3) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT (c_acctbal > 5000 OR c_nationkey = 3)"),
    "null_check": Case("MATCH (c:Customer) OPTIONAL MATCH (o:Order {o_orderstatus:'P'})-[:PLACED_BY]->(c) WITH c, o WHERE o.o_orderkey IS NULL RETURN c.c_custkey AS k, EXISTS(c.c_name) AS named", "SELECT c_custkey AS k, c_name IS NOT NULL AS named FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "in_list": Case("MATCH (n:Nation) WHERE n.n_nationkey IN [1, 5, 7] OR n.n_name IN ['FRANCE', 'NATION_3'] RETURN n.n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (1, 5, 7) OR n_name IN ('FRANCE', 'NATION_3')"),
    "starts_ends_contains": Case("MATCH (c:Customer) WHERE c.c_name STARTS WITH 'Cust' AND (c.c_name ENDS WITH '7' OR c.c_name CONTAINS '00') RETURN c.c_name AS n", "SELECT c_name AS n FROM customer WHERE starts_with(c_name, 'Cust') AND (ends_with(c_name, '7') OR contains(c_name, '00'))"),
    "regex_match": Case("MATCH (p:Part) WHERE p.p_brand =~ 'Brand#[1-3][24]' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_brand, 'Brand#[1-3][24]')"),
    "arithmetic": Case("MATCH (p:Part) RETURN p.p_partkey AS k, (p.p_size + 1) * 2 AS a, p.p_size - -3 AS b, p.p_retailprice * 2.0 AS c", "SELECT p_partkey AS k, ((p_size + 1) * 2)::BIGINT AS a, (p_size + 3)::BIGINT AS b, p_retailprice * 2.0 AS c FROM part"),
    "int_division": Case("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 3 AS a, p.p_size % 7 AS b, p.p_size / 0 AS c, p.p_retailprice / 2 AS d", "SELECT p_partkey AS k, (p_size // 3)::BIGINT AS a, (p_size % 7)::BIGINT AS b, NULL::BIGINT AS c, p_retailprice / 2 AS d FROM part"),
    "case_simple": Case("MATCH (o:Order) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders"),
    "case_searched": Case("MATCH (o:Order) RETURN CASE WHEN o.o_totalprice > 200000 THEN 'big' WHEN o.o_totalprice > 50000 THEN 'mid' END AS size, count(*) AS n", "SELECT CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS size, count(*) AS n FROM orders GROUP BY 1"),
    "label_test": Case("MATCH (c:Customer) WHERE c:Customer AND NOT (c:Supplier) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer"),
    # --- hops ---
    "fk_hop": Case("MATCH (o:Order)-[:PLACED_BY]->(c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN o.o_orderkey AS k, c.c_name AS n", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "fk_hop_reverse": Case("MATCH (c:Customer {c_mktsegment: 'MACHINERY'})<-[:PLACED_BY]-(o:Order) RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'"),
    "multi_hop": Case("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(c) AS n, round(sum(c.c_acctbal), 2) AS bal", "SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "junction_hop": Case("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 49 RETURN o.o_orderkey AS k, p.p_name AS n, l.l_linenumber AS i", "SELECT l_orderkey AS k, p_name AS n, l_linenumber AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49"),
    "junction_reverse": Case("MATCH (s:Supplier)<-[:SUPPLIED_BY]-(p:Part) RETURN s.s_suppkey AS k, count(DISTINCT p) AS n", "SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "edge_inline_props": Case("MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'} WHERE l.l_quantity > 45]->(p:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"),
    "type_alternation": Case("MATCH (x)-[:FROM_NATION|BASED_IN]->(n:Nation {n_nationkey: 3}) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Customer' AS label, count(*) AS n FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0"),
    "undirected_hop": Case("MATCH (e:Event)-[:NEXT]-(f:Event) RETURN e.event_id AS a, f.event_id AS b", f"WITH {NEXT_SQL} SELECT a, b FROM (SELECT a, b FROM nx UNION ALL SELECT b, a FROM nx) t(a, b)"),
    "shared_variable": Case("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE c.c_acctbal > 9500 RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9500"),
    "closing_join": Case("MATCH (o:Order)-[:CONTAINS]->(p:Part)-[:SUPPLIED_BY]->(s:Supplier)-[:BASED_IN]->(n:Nation), (o)-[:PLACED_BY]->(c:Customer)-[:FROM_NATION]->(n) WHERE c.c_acctbal > 0 RETURN o.o_orderkey AS o, count(*) AS n", "SELECT o_orderkey AS o, count(*) AS n FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_partkey = a.l_partkey JOIN supplier ON s_suppkey = b.l_suppkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey WHERE c_acctbal > 0 GROUP BY 1"),
    "comma_bridge": Case("MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND s.s_acctbal > 8000 RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 8000"),
    "comma_bridge_or": Case("MATCH (n:Nation), (r:Region) WHERE n.n_regionkey = r.r_regionkey OR n.n_nationkey = r.r_regionkey RETURN n.n_nationkey AS n, r.r_regionkey AS r", "SELECT n_nationkey AS n, r_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey"),
    "cross_join": Case("MATCH (n:Nation), (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation, region"),
    "theta_join": Case("MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 6 RETURN a.n_nationkey AS a, b.n_nationkey AS b", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 6"),
    "several_matches": Case("MATCH (c:Customer) WHERE c.c_acctbal > 0 MATCH (o:Order)-[:PLACED_BY]->(c) WHERE o.o_totalprice > 100000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 100000"),
    "optional_match": Case("MATCH (c:Customer) OPTIONAL MATCH (o:Order)-[:PLACED_BY]->(c) RETURN c.c_custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "optional_where": Case("MATCH (c:Customer) OPTIONAL MATCH (o:Order {o_orderstatus:'F'})-[:PLACED_BY]->(c) WHERE o.o_totalprice > 150000 RETURN c.c_custkey AS k, o.o_orderkey AS o", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000"),
    # --- existence ---
    "exists_pattern": Case("MATCH (c:Customer) WHERE EXISTS { (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_totalprice > 250000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)"),
    "not_exists": Case("MATCH (c:Customer) WHERE NOT EXISTS { (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_orderstatus = 'F' } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "exists_nested": Case("MATCH (n:Nation) WHERE EXISTS { (n)<-[:FROM_NATION]-(c:Customer) WHERE c.c_acctbal > 9000 AND NOT EXISTS { (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_totalprice > 400000 } } RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000))"),
    "exists_or": Case("MATCH (c:Customer) WHERE c.c_acctbal > 9900 OR EXISTS { (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_totalprice > 280000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 280000)"),
    "exists_multihop": Case("MATCH (r:Region) WHERE EXISTS { (r)<-[:IN_REGION]-(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal < 0 } RETURN r.r_name AS n", "SELECT r_name AS n FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND s_acctbal < 0)"),
    "exists_free_start": Case("MATCH (n:Nation) WHERE EXISTS { (s:Supplier) WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 } RETURN n.n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)"),
    "exists_two_outer": Case("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) WHERE EXISTS { (s:Supplier)-[:BASED_IN]->(n) WHERE s.s_acctbal > c.c_acctbal } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)"),
    # --- multi-valued and JSON properties ---
    "multi_value_in": Case("MATCH (c:Customer) WHERE 10 IN c.parts OR NOT (c.c_acctbal < 9000) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 10) OR NOT (c_acctbal < 9000)"),
    "multi_value_collect": Case("MATCH (c:Customer) RETURN c.c_custkey AS k, size(c.parts) AS n, head(c.parts) AS first", "SELECT c_custkey AS k, count(l_partkey) AS n, min(l_partkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "json_ext_filter": Case("MATCH (e:Event) WHERE e.k > 50 RETURN e.event_id AS id, e.k + 1 AS k", "SELECT event_id AS id, (props->>'k')::BIGINT + 1.0 AS k FROM events WHERE (props->>'k')::BIGINT > 50"),
    "json_ext_order": Case("MATCH (e:Event) WHERE e.k >= 0 RETURN e.event_id AS id ORDER BY e.k DESC, e.event_id LIMIT 25", "SELECT event_id AS id FROM events WHERE (props->>'k')::BIGINT >= 0 ORDER BY (props->>'k')::BIGINT DESC, event_id LIMIT 25"),
    "nested_property": Case("MATCH (e:Event) WHERE e['k'] = 7 RETURN e.event_id AS id", "SELECT event_id AS id FROM events WHERE (props->>'k')::BIGINT = 7"),
    # --- paths ---
    "varlen_1_3": Case("MATCH (e:Event)-[:NEXT*1..3]->(f:Event) RETURN e.event_id AS a, f.event_id AS b", f"WITH RECURSIVE {NEXT_SQL}, {walk_sql(1, 3)} SELECT s AS a, e AS b FROM hits"),
    "varlen_0": Case("MATCH (e:Event)-[:NEXT*0..2]->(f:Event) RETURN e.event_id AS a, f.event_id AS b", f"WITH RECURSIVE {NEXT_SQL}, {walk_sql(0, 2)} SELECT s AS a, e AS b FROM hits"),
    "varlen_exact": Case("MATCH (e:Event)-[:NEXT*4]->(f:Event) RETURN e.event_id AS a, f.event_id AS b", f"WITH RECURSIVE {NEXT_SQL}, {walk_sql(4, 4)} SELECT s AS a, e AS b FROM hits"),
    "varlen_unbounded": Case("MATCH (a:Turn {turn: 0})-[:NEXT_TURN*]->(b:Turn) RETURN a.conv_id AS c, max(b.turn) AS last, count(*) AS n", "SELECT conv_id AS c, max(turn) AS last, count(*) AS n FROM conversations WHERE turn BETWEEN 1 AND 10 GROUP BY 1"),
    "varlen_reverse": Case("MATCH (f:Event)<-[:NEXT*1..2]-(e:Event) RETURN e.event_id AS a, f.event_id AS b", f"WITH RECURSIVE {NEXT_SQL}, rv AS (SELECT b AS a, a AS b FROM nx), {walk_sql(1, 2, 'rv')} SELECT e AS a, s AS b FROM hits"),
    "varlen_undirected": Case("MATCH (e:Event)-[:NEXT*1..2]-(f:Event) RETURN e.event_id AS a, f.event_id AS b", f"WITH RECURSIVE {NEXT_SQL}, both_ways AS (SELECT a, b FROM nx UNION ALL SELECT b, a FROM nx), {walk_sql(1, 2, 'both_ways')} SELECT s AS a, e AS b FROM hits"),
    "varlen_then_hop": Case("MATCH (a:Turn {turn: 0})-[:NEXT_TURN*2..3]->(b:Turn)-[:NEXT_TURN]->(c:Turn) RETURN a.id AS a, c.turn AS t", "SELECT x.conv_id * 1000 AS a, x.turn AS t FROM conversations x WHERE x.turn IN (3, 4)"),
    "shortest_path": Case("MATCH p = shortestPath((a:Turn {turn: 0})-[:NEXT_TURN*..10]->(b:Turn {turn: 3})) RETURN a.conv_id AS c, length(p) AS n", "SELECT conv_id AS c, 3::BIGINT AS n FROM conversations WHERE turn = 3"),
    "all_shortest_paths": Case("MATCH p = allShortestPaths((a:Event)-[:NEXT*1..3]-(b:Event)) RETURN a.event_id AS a, b.event_id AS b, length(p) AS n", f"WITH RECURSIVE {NEXT_SQL}, both_ways AS (SELECT a, b FROM nx UNION ALL SELECT b, a FROM nx), {walk_sql(1, 3, 'both_ways')} SELECT s AS a, e AS b, min(d)::BIGINT AS n FROM hits GROUP BY 1, 2"),
    "path_value": Case("MATCH p = (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS k, length(p) AS n, p[2].id AS nation, p[3].labels[0] AS edge", "SELECT c_custkey AS k, 2::BIGINT AS n, c_nationkey::VARCHAR AS nation, 'IN_REGION' AS edge FROM customer"),
    "path_nodes": Case("MATCH p = (a:Turn {turn: 0})-[:NEXT_TURN*1..3]->(b:Turn) RETURN a.conv_id AS c, b.turn AS t, size(nodes(p)) AS n, last(nodes(p)).id AS id", "SELECT conv_id AS c, turn AS t, turn + 1 AS n, (conv_id * 1000 + turn)::VARCHAR AS id FROM conversations WHERE turn BETWEEN 1 AND 3"),
    "local_graph": Case("FOR i IN [1, 2, 3] RETURN i AS i, json_array_length(json_get(local_graph(i, 1), 'nodes')) AS nodes, json_array_length(json_get(local_graph(i, 1), 'edges')) AS edges", "SELECT i::BIGINT AS i, 2::BIGINT AS nodes, 1::BIGINT AS edges FROM range(1, 4) t(i)", None, stored),
    # --- aggregates ---
    "group_count": Case("MATCH (o:Order)-[:PLACED_BY]->(c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, count(o) AS m", "SELECT c_mktsegment AS seg, count(*) AS n, count(*) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "count_distinct": Case("MATCH (o:Order)-[:PLACED_BY]->(c:Customer) RETURN o.o_orderstatus AS s, count(DISTINCT c) AS n, count(DISTINCT c.c_nationkey) AS m", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n, count(DISTINCT c_nationkey) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "sum_avg_min_max": Case("MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) AS s, round(avg(p.p_size), 6) AS a, min(p.p_name) AS lo, max(p.p_retailprice) AS hi", "SELECT p_brand AS b, sum(p_size)::BIGINT AS s, round(avg(p_size), 6) AS a, min(p_name) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1"),
    "global_agg": Case("MATCH (p:Part) RETURN count(p) AS n, sum(p.p_size) AS s", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s FROM part"),
    "agg_expr": Case("MATCH (o:Order) RETURN o.o_orderpriority AS p, count(*) * 2 + 1 AS a, CASE WHEN count(*) > 2990 THEN 'many' ELSE 'few' END AS b, toString(count(*)) AS c", "SELECT o_orderpriority AS p, count(*) * 2 + 1 AS a, CASE WHEN count(*) > 2990 THEN 'many' ELSE 'few' END AS b, count(*)::VARCHAR AS c FROM orders GROUP BY 1"),
    "group_by_node": Case("MATCH (o:Order)-[:PLACED_BY]->(c:Customer) WITH c, count(o) AS n, sum(o.o_totalprice) AS t WHERE n > 10 RETURN c.c_name AS name, n, round(t, 2) AS t", "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 10"),
    "collect_list": Case("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.n_nationkey WITH r.r_name AS r, collect(n.n_nationkey) AS l RETURN r, size(l) AS n, reduce(s = 0, x IN l | s + x) AS s", "SELECT r_name AS r, count(*) AS n, sum(n_nationkey)::BIGINT AS s FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "stdev_agg": Case("MATCH (p:Part) RETURN p.p_brand AS b, round(stdev(p.p_size), 6) AS s, round(stdevp(p.p_size), 6) AS p", "SELECT p_brand AS b, round(stddev_samp(p_size), 6) AS s, round(stddev_pop(p_size), 6) AS p FROM part GROUP BY 1"),
    # --- projections, order, paging ---
    "distinct_rows": Case("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "order_limit": Case("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "skip_limit": Case("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_custkey SKIP 20 LIMIT $n", "SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 15 OFFSET 20", {"n": 15}),
    "order_by_alias": Case("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) RETURN n.n_name AS name, count(c) AS many ORDER BY many DESC, name LIMIT 5", "SELECT n_name AS name, count(*) AS many FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "order_unprojected": Case("MATCH (c:Customer) RETURN c.c_name AS n ORDER BY c.c_acctbal, c.c_custkey LIMIT 7", "SELECT c_name AS n FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7"),
    "return_node": Case("MATCH (n:Nation) WITH n {.n_name, key: n.id, twice: n.n_regionkey * 2} AS m RETURN m.n_name AS a, m.key AS b, m.twice AS c", "SELECT n_name AS a, n_nationkey AS b, (n_regionkey * 2)::BIGINT AS c FROM nation"),
    "return_edge": Case("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN type(e) AS t, id(n) AS a, id(r) AS b, labels(r)[0] AS l", "SELECT 'IN_REGION' AS t, n_nationkey AS a, n_regionkey AS b, 'Region' AS l FROM nation"),
    "return_star": Case("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n.n_name AS name, r.r_name AS region RETURN *", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "map_projection": Case("MATCH (p:Part) WITH p {.*} AS m RETURN m.p_name AS a, size(keys(m)) AS n", "SELECT p_name AS a, 6::BIGINT AS n FROM part"),
    "properties_of": Case("MATCH (n:Nation) WITH properties(n) AS m, n RETURN m.n_name AS a, m.n_regionkey AS b, n.n_nationkey AS k", "SELECT n_name AS a, n_regionkey AS b, n_nationkey AS k FROM nation"),
    # --- lists ---
    "for_list": Case("FOR x IN [3, 1, 2] FOR y IN range(1, x) RETURN x, y", "SELECT x::BIGINT AS x, y::BIGINT AS y FROM (VALUES (3), (1), (2)) t(x), LATERAL (SELECT unnest(range(1, x + 1)) AS y)"),
    "for_with_match": Case("FOR k IN ['BUILDING', 'MACHINERY', 'NONE'] MATCH (c:Customer) WHERE c.c_mktsegment = k RETURN k, c.c_name AS n", "SELECT c_mktsegment AS k, c_name AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "list_comprehension": Case("MATCH (p:Part) RETURN p.p_partkey AS k, size([x IN range(1, p.p_size) WHERE x % 2 = 0 | x * x]) AS n, last([x IN range(1, p.p_size) | x * x]) AS l", "SELECT p_partkey AS k, (p_size // 2)::BIGINT AS n, CASE WHEN p_size > 0 THEN (p_size * p_size)::BIGINT END AS l FROM part"),
    "list_predicates": Case("MATCH (p:Part) WHERE any(x IN [p.p_size, 3] WHERE x > 40) AND all(x IN [1, 2] WHERE x < 3) AND none(x IN [1] WHERE x > p.p_size) AND single(x IN [p.p_size, 60] WHERE x > 55) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 40 AND NOT (1 > p_size) AND NOT (p_size > 55)"),
    "reduce_list": Case("MATCH (p:Part) RETURN p.p_partkey AS k, reduce(t = 0, x IN range(1, p.p_size) | t + x) AS s", "SELECT p_partkey AS k, (p_size * (p_size + 1) // 2)::BIGINT AS s FROM part"),
    "subscript": Case("FOR i IN range(-4, 4) RETURN i AS i, [10, 20, 30][i] AS v", "SELECT i, [10, 20, 30][CASE WHEN i < 0 THEN i ELSE i + 1 END] AS v FROM (SELECT unnest(range(-4, 5)) AS i)"),
    "list_funcs": Case("FOR l IN [[1, 2, 3], [4]] RETURN size(l) AS n, head(l) AS h, last(l) AS z, size(tail(l)) AS t, 2 IN l AS has", "SELECT * FROM (VALUES (3::BIGINT, 1::BIGINT, 3::BIGINT, 2::BIGINT, true), (1, 4, 4, 0, false)) t(n, h, z, t, has)"),
    "range_func": Case("RETURN size(range(1, 10, 3)) AS a, size(range(5, 1)) AS b, size(range(5, 1, -2)) AS c, size(range(1, 3, 0)) AS d", "SELECT 4::BIGINT AS a, 0::BIGINT AS b, 3::BIGINT AS c, 0::BIGINT AS d"),
    # --- functions ---
    "string_funcs": Case("MATCH (p:Part) WITH p.p_name AS s, p.p_partkey AS k RETURN k, toUpper(s) AS a, left(s, 3) AS b, right(s, 2) AS c, right(s, 0) AS d, substring(s, 2, 3) AS e, replace(s, 'a', 'A') AS f, reverse(s) AS g, length(s) AS h, trim('  x ') AS i, split(s, ' ')[0] AS j, coalesce(NULL, s) AS l, toString(k) AS m, instr(s, 'a') AS n", "SELECT p_partkey AS k, upper(p_name) AS a, left(p_name, 3) AS b, right(p_name, 2) AS c, p_name AS d, substr(p_name, 2, 3) AS e, replace(p_name, 'a', 'A') AS f, reverse(p_name) AS g, length(p_name) AS h, 'x' AS i, string_split(p_name, ' ')[1] AS j, p_name AS l, p_partkey::VARCHAR AS m, instr(p_name, 'a') AS n FROM part"),
    "math_funcs": Case("MATCH (c:Customer) WITH c.c_acctbal AS x, c.c_custkey AS k RETURN k, abs(x) AS a, sign(x) AS b, round(x) AS c, ceil(x) AS d, floor(x) AS e, round(sqrt(abs(x)), 6) AS f, round(log(abs(x) + 1), 6) AS g, round(log10(abs(x) + 1), 6) AS h, round(e(), 6) AS i", "SELECT c_custkey AS k, abs(c_acctbal) AS a, sign(c_acctbal)::BIGINT AS b, round(c_acctbal) AS c, ceil(c_acctbal)::BIGINT AS d, floor(c_acctbal)::BIGINT AS e, round(sqrt(abs(c_acctbal)), 6) AS f, round(ln(abs(c_acctbal) + 1), 6) AS g, round(log10(abs(c_acctbal) + 1), 6) AS h, 2.718282::DOUBLE AS i FROM customer"),
    "rand_func": Case("MATCH (n:Nation) WITH rand() AS r, n.n_nationkey AS k RETURN k, r >= 0 AND r <= 1 AS ok", "SELECT n_nationkey AS k, true AS ok FROM nation"),
    "conversions": Case("FOR s IN ['12abc', 'abc', ' 7', '-3.5e1x', 'TRUE', 'yes', '0'] RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toInteger(2.9) AS t", "SELECT * FROM (VALUES ('12abc', 12::BIGINT, 12.0::DOUBLE, false, 2::BIGINT), ('abc', 0, 0, false, 2), (' 7', 7, 7, false, 2), ('-3.5e1x', -3, -35, false, 2), ('TRUE', 0, 0, true, 2), ('yes', 0, 0, true, 2), ('0', 0, 0, false, 2)) v(s, i, f, b, t)"),
    "json_funcs": Case("MATCH (e:Event) RETURN e.event_id AS id, toInteger(json_get('{\"a\": {\"b\": 5}}', 'a.b')) AS v, json_keys('{\"x\": 1, \"y\": 2}')[1] AS k", "SELECT event_id AS id, 5::BIGINT AS v, 'y' AS k FROM events"),
    "graph_funcs": Case("MATCH (n:Nation) RETURN id(n) AS id, labels(n)[0] AS l, type(n.n_name) AS a, type(n.n_nationkey) AS b, graph(n) AS g, pagerank(n) AS p, toppagerank(5) AS q", "SELECT n_nationkey AS id, 'Nation' AS l, 'text' AS a, 'integer' AS b, 'default' AS g, 0.0::DOUBLE AS p, '[]' AS q FROM nation"),
    "map_funcs": Case("WITH {a: 1, b: 'x'} AS m RETURN m.a AS a, m.b AS b, keys(m)[1] AS k", "SELECT 1::BIGINT AS a, 'x' AS b, 'b' AS k"),
    # --- parameters ---
    "params": Case("MATCH (c:Customer {c_mktsegment: $seg}) WHERE c.c_nationkey IN $nations AND c.c_acctbal > ${least} RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IN (1, 2, 3) AND c_acctbal > 100.5", {"seg": "MACHINERY", "nations": [1, 2, 3], "least": 100.5}),
    # --- the property store ---
    "stored_scan": Case("MATCH (b:Buyer) WHERE b.balance > 9000 AND b.segment = 'BUILDING' RETURN id(b) AS k, b.name AS n", "SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'", None, stored),
    "stored_hop": Case("MATCH (b:Buyer)-[r:LIVES_IN]->(p:Place {region: 1}) RETURN p.name AS place, count(b) AS n, round(sum(r.since), 2) AS s", "SELECT n_name AS place, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1", None, stored),
    "stored_any_label": Case("MATCH (x) WHERE x:Place OR x.balance > 9990 RETURN count(*) AS n, count(x.region) AS places", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer WHERE c_acctbal > 9990) AS n, (SELECT count(*) FROM nation) AS places", None, stored),
    "create_match": Case("MATCH (v:Visitor)-[w:WANTS]->(p:Place) RETURN v.name AS v, w.days AS d, p.name AS p", "SELECT 'Ann' AS v, 9::BIGINT AS d, n_name AS p FROM nation WHERE n_regionkey = 2", None, stored, ("CREATE (v:Visitor {name: 'Ann', age: 30})", "MATCH (v:Visitor), (p:Place {region: 2}) CREATE (v)-[:WANTS {days: 9}]->(p)")),
    "set_property": Case("MATCH (b:Buyer) WHERE b.rich = true RETURN id(b) AS k, b.balance AS bal, b:Rich AS r", "SELECT c_custkey AS k, c_acctbal + 1 AS bal, true AS r FROM customer WHERE c_acctbal > 9000", None, stored, ("MATCH (b:Buyer) WHERE b.balance > 9000 SET b.balance = b.balance + 1, b += {rich: true}, b:Rich",)),
    "delete_node": Case("MATCH (x) OPTIONAL MATCH (x)-[r:LIVES_IN]->(p) RETURN count(x) AS n, count(r) AS e", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey <> 0) + (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0) AS e", None, stored, ("MATCH (p:Place {region: 0}) DELETE p",)),
    "detach_delete": Case("MATCH (b:Buyer) OPTIONAL MATCH (b)-[r:LIVES_IN]->(p) RETURN count(b) AS n, count(r) AS e", "SELECT count(*) AS n, count(*) AS e FROM customer WHERE c_acctbal >= 0", None, stored, ("MATCH (b:Buyer) WHERE b.balance < 0 DETACH DELETE b",)),
    "delete_edge": Case("MATCH (b:Buyer)-[r:LIVES_IN]->(p) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal <= 5000", None, stored, ("MATCH (b:Buyer)-[r:LIVES_IN]->(p) WHERE r.since > 5000 DELETE r",)),
    "mapped_write": Case("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) WHERE c.c_mktsegment = 'NEW' RETURN c.c_custkey AS k, n.n_name AS n", "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 UNION ALL SELECT -1, n_name FROM nation WHERE n_nationkey = 4", None, graph, ("MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_mktsegment = 'NEW'", "MATCH (n:Nation {n_nationkey: 4}) CREATE (c:Customer {c_custkey: -1, c_mktsegment: 'NEW'})-[:FROM_NATION]->(n)")),
    # --- beyond one query part ---
    "union_distinct": Case("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": Case("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "with_pipeline": Case("MATCH (o:Order)-[:PLACED_BY]->(c:Customer) WITH c, count(o) AS n ORDER BY n DESC, c.c_custkey LIMIT 20 MATCH (c)-[:FROM_NATION]->(m:Nation) RETURN c.c_custkey AS k, n, m.n_name AS nation", "SELECT k, n, n_name AS nation FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) JOIN customer ON c_custkey = k JOIN nation ON c_nationkey = n_nationkey"),
    "pattern_comprehension": Case("MATCH (c:Customer) RETURN c.c_custkey AS k, size([(c)<-[:PLACED_BY]-(o:Order) WHERE o.o_totalprice > 100000 | o.o_orderkey]) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1"),
    "deep_property": Case("WITH {a: {b: {c: 5, d: 'x'}}} AS m RETURN m.a.b.c AS c, m.a.b.d AS d", "SELECT 5::BIGINT AS c, 'x' AS d"),
    "set_edge": Case("MATCH (b:Buyer)-[r:LIVES_IN]->(p:Place) WHERE r.since = 0 AND r.kind = 'rich' RETURN id(b) AS k, p.name AS place, r.kind AS kind", "SELECT c_custkey AS k, n_name AS place, 'rich' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000", None, stored, ("MATCH (b:Buyer)-[r:LIVES_IN]->(p:Place) WHERE b.balance > 9000 SET r.since = 0, r.kind = 'rich'",)),
    "passed_functions": Case("MATCH (p:Part) RETURN p.p_partkey AS k, substr(p.p_name, 2, 3) AS a, pow(p.p_size, 2) AS b, iif(p.p_size > 25, 'big', 'small') AS c, greatest(p.p_size, 10) AS d, concat_ws('-', p.p_brand, 'x') AS e, json_object('s', p.p_size) AS f, typeof(p.p_retailprice) AS g", "SELECT p_partkey AS k, substr(p_name, 2, 3) AS a, pow(p_size, 2)::DOUBLE AS b, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c, greatest(p_size, 10)::BIGINT AS d, p_brand || '-x' AS e, '{\"s\":' || p_size || '}' AS f, 'real' AS g FROM part"),
    "time_functions": Case("FOR t IN ['2024-03-05 06:07:08', '1999-12-31 23:59:59'] RETURN strftime('%Y/%m/%d', t) AS a, julianday(t) AS b, unixepoch(t) AS c, time(t) AS d", "SELECT strftime(t, '%Y/%m/%d') AS a, epoch(t) / 86400.0 + 2440587.5 AS b, epoch(t)::BIGINT AS c, strftime(t, '%H:%M:%S') AS d FROM (VALUES (TIMESTAMP '2024-03-05 06:07:08'), (TIMESTAMP '1999-12-31 23:59:59')) v(t)"),
    "whole_node": Case("", "SELECT n_nationkey AS id, 'Nation' AS label, n_name AS name, n_regionkey AS region FROM nation"),
    "whole_edge": Case("", "SELECT l_orderkey AS a, l_partkey AS b, 'CONTAINS' AS type, l_linenumber AS line, l_quantity AS quantity FROM lineitem WHERE l_quantity > 49"),
    "whole_star": Case("", "SELECT n_name AS nation, 'IN_REGION' AS type, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "explain_text": Case("", "SELECT true AS scanned, true AS pushed"),
    "pagerank_real": Case("", pagerank_sql(20)),
}


def run(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    g = case.build(spark, sf_dir)
    for w in case.writes:
        g.execute(w)
    return g.compile(case.gql, case.params)


def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN of a filtered scan: its filter and its columns reach the Parquet scan."""
    said = graph(spark, sf_dir).execute("EXPLAIN MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k")
    text = said.text  # type: ignore[union-attr]
    return spark.range(1).select(F.lit("parquet" in text).alias("scanned"), F.lit("GreaterThan(c_acctbal,5000.0)" in text).alias("pushed"))


def pagerank_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of events over NEXT, which the language's own functions only stand in for."""
    from weftgraph.operators.ranking import pagerank

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ranks = pagerank(events.select(F.col("event_id").alias("id")), next_events(events).toDF("src", "dst"))
    return ranks.select("id", F.round("rank", 12).alias("rank"))


def whole_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node returned whole is a struct of its id, labels and properties."""
    found = graph(spark, sf_dir).compile("MATCH (n:Nation) RETURN n")
    return found.select("n.id", F.col("n.labels")[0].alias("label"), F.col("n.properties.n_name").alias("name"), F.col("n.properties.n_regionkey").alias("region"))


def whole_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge returned whole is a struct of its type, ends and properties."""
    found = graph(spark, sf_dir).compile("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 49 RETURN l")
    held = {"a": "startNodeId", "b": "endNodeId", "type": "type", "line": "properties.l_linenumber", "quantity": "properties.l_quantity"}
    return found.select(*[F.col(f"l.{v}").alias(k) for k, v in held.items()])


def whole_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RETURN * of nodes and edges gives each variable whole."""
    found = graph(spark, sf_dir).compile("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN *")
    return found.select(F.col("n.properties.n_name").alias("nation"), "e.type", F.col("r.properties.r_name").alias("region"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(case: Case) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(case, spark, sf_dir)

    return {k: of(c) for k, c in CASES.items() if c.gql} | {f.__name__: f for f in (explain_text, pagerank_real, whole_node, whole_edge, whole_star)}


def oracle_sql() -> dict[str, str]:
    return {k: c.sql for k, c in CASES.items() if c.sql}


FLAGSHIP = (
    "MATCH (o:Order)-[:PLACED_BY]->(c:Customer) WHERE c.c_mktsegment = 'BUILDING' "
    "RETURN c.c_name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10"
)
