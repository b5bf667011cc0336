"""The registered queries: name to function of (spark, directory), and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.text import glob, shard_key
from tidegraph.operators import exchange as X
from tidegraph.operators import fold as D
from tidegraph.operators import history as H
from tidegraph.operators import observe as O
from tidegraph.operators import receipts as R
from tidegraph.operators import traverse as T
from tidegraph.operators import visible as V
from tidegraph.operators.query import Query
from tidegraph.plans.sql import GRAPH, GRAPH_PROPS, LOG, STATE, state_at
from tidegraph.sources import event_log, star_graph
from tidegraph.sources.event_log import Log
from tidegraph.sources.shared import written
from tidegraph.sources.star_graph import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The first of the two coordinates that queries compare: a third of the largest Lamport time. The second is the whole log.
EARLY = "lamport * 3 <= (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id % 8))"


def third(g: Log) -> int:
    return (g.patches.agg(F.max("lamport")).first()[0] or 0) // 3



def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def on_graph(name: str, sql: str | None = None, tables: tuple[str, ...] | None = None):
    """Register a function of a static graph."""

    def register(f: Callable[[Graph], DataFrame]):
        query(name, sql)(lambda spark, d: f(star_graph.load(spark, d, tables)))
        return f

    return register


def on_log(name: str, sql: str | None = None):
    """Register a function of the operation log."""

    def register(f: Callable[[Log], DataFrame]):
        query(name, sql)(lambda spark, d: f(event_log.from_events(spark, d)))
        return f

    return register


def value(column: str = "value_num") -> F.Column:
    return F.round(F.col(column), 4).alias("value")


# -- queries over the static graph -----------------------------------------------------------------------------------

on_graph("query_match", f"WITH {GRAPH} SELECT node_id AS id FROM nodes WHERE node_id LIKE 'customer:1%' OR node_id = 'nation:3' ORDER BY 1")(
    lambda g: Query(g).match(["customer:1*", "nation:3"]).run()
)
on_graph(
    "query_where",
    "SELECT 'part:' || p_partkey AS id FROM part WHERE p_size = 10 AND p_retailprice > 950 ORDER BY 1",
)(
    lambda g: Query(g).match("part:*").where({"p_size": 10}).where(F.col("props")["p_retailprice"]["value_num"] > 950).run()
)
on_graph(
    "query_where_column",
    f"WITH {GRAPH} SELECT src AS id FROM edges WHERE label = 'supplied_by' GROUP BY src HAVING count(*) > 25 ORDER BY 1",
)(lambda g: Query(g).match("part:*").where(F.size("edges_out") > 25).run())
on_graph(
    "query_outgoing",
    f"WITH {GRAPH} SELECT DISTINCT dst AS id FROM edges WHERE label = 'placed_by' ORDER BY 1",
)(lambda g: Query(g).match("order:*").outgoing("placed_by").run())
on_graph(
    "query_incoming",
    f"WITH {GRAPH} SELECT DISTINCT src AS id FROM edges WHERE dst IN ('nation:1', 'nation:2') AND label = 'in_nation' ORDER BY 1",
)(lambda g: Query(g).match(["nation:1", "nation:2"]).incoming("in_nation").run())
on_graph(
    "query_multihop",
    f"""WITH RECURSIVE {GRAPH}, walk AS (
      SELECT node_id, 0 AS d FROM nodes WHERE node_id LIKE 'customer:%'
      UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.node_id WHERE w.d < 2),
    first AS (SELECT node_id, min(d) AS d FROM walk GROUP BY node_id)
    SELECT node_id AS id FROM first WHERE d BETWEEN 1 AND 2 ORDER BY 1""",
)(lambda g: Query(g).match("customer:*").outgoing(depth=(1, 2)).run())
on_graph("query_select", f"WITH {GRAPH} SELECT node_id AS id FROM nodes WHERE node_id LIKE 'supplier:%' ORDER BY 1")(
    lambda g: Query(g).match("supplier:*").select(["id"])
)
on_graph(
    "query_select_props",
    f"""WITH {GRAPH_PROPS} SELECT node_id AS id, max(CASE WHEN key = 's_name' THEN str END) AS s_name,
    max(CASE WHEN key = 's_acctbal' THEN num END) AS s_acctbal FROM node_props WHERE node_id LIKE 'supplier:%' GROUP BY 1""",
)(
    lambda g: Query(g)
    .match("supplier:*")
    .select()
    .select("id", F.col("props")["s_name"].alias("s_name"), F.col("props")["s_acctbal"].cast("double").alias("s_acctbal"))
)
on_graph(
    "query_aggregate",
    """SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg,
    min(o_totalprice) AS min, max(o_totalprice) AS max
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""",
)(
    lambda g: Query(g)
    .match("customer:*")
    .where({"c_mktsegment": "BUILDING"})
    .incoming("placed_by")
    .aggregate(count=True, sum="o_totalprice", avg="props.o_totalprice", min="o_totalprice", max="o_totalprice")
    .select("count", F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg"), "min", "max")
)
on_graph("query_aggregate_empty", "SELECT 0::BIGINT AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS max")(
    lambda g: Query(g).match("nothing:*").aggregate(count=True, sum="o_totalprice", max="o_totalprice")
)

# -- direct reads and views ------------------------------------------------------------------------------------------

on_graph("get_nodes", f"WITH {GRAPH} SELECT node_id FROM nodes")(lambda g: g.nodes)
on_graph("get_edges", f"WITH {GRAPH} SELECT src, dst, label FROM edges")(lambda g: g.edges)
on_graph(
    "node_props_map",
    f"""WITH {GRAPH_PROPS} SELECT node_id, string_agg(key || '=' || coalesce(CAST(CAST(num AS DECIMAL(20,2)) AS VARCHAR), str), ';' ORDER BY key) AS props
    FROM node_props GROUP BY node_id""",
)(
    lambda g: O.props_map(g).select(
        "node_id", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props")
    )
)
BOTH = f"""WITH {GRAPH}, ids AS (SELECT node_id FROM nodes WHERE node_id LIKE 'nation:%')
SELECT src AS node_id, 'out' AS direction, dst AS neighbour, label FROM edges JOIN ids ON src = node_id
UNION ALL SELECT dst, 'in', src, label FROM edges JOIN ids ON dst = node_id"""
nations = lambda g: g.nodes.where(F.col("node_id").startswith("nation:"))
on_graph("neighbors_both", BOTH)(lambda g: O.neighbours(g, nations(g)))
on_graph("neighbors_both_dedup", f"SELECT DISTINCT node_id, neighbour, label FROM ({BOTH})")(lambda g: O.neighbours(g, nations(g), dedup=True))
on_graph(
    "neighborhood_page",
    f"""WITH {GRAPH}, n AS (
      SELECT 'out' AS direction, dst AS neighbour, label FROM edges WHERE src = 'nation:5'
      UNION ALL SELECT 'in', src, label FROM edges WHERE dst = 'nation:5')
    SELECT 'nation:5' AS node_id, direction, neighbour, label FROM n
    WHERE (direction, neighbour, label) > ('in', 'customer:2', '') ORDER BY direction, neighbour, label LIMIT 20""",
)(lambda g: O.page(g, "nation:5", 20, ("in", "customer:2", "")))
seen = lambda g: O.observe(g, ["customer:*", "nation:*"], expose=["c_name", "c_acctbal", "n_name"], redact=["c_name"])
on_graph("observer_nodes", f"WITH {GRAPH} SELECT node_id FROM nodes WHERE node_id LIKE 'customer:%' OR node_id LIKE 'nation:%'")(lambda g: seen(g).nodes)
on_graph("observer_edges", f"WITH {GRAPH} SELECT src, dst, label FROM edges WHERE src LIKE 'customer:%' AND dst LIKE 'nation:%'")(lambda g: seen(g).edges)
on_graph(
    "observer_emission",
    f"""WITH {GRAPH} SELECT (SELECT count(*) FROM nodes WHERE node_id LIKE 'customer:%' OR node_id LIKE 'nation:%') AS node_count,
    (SELECT count(*) FROM edges WHERE src LIKE 'customer:%' AND dst LIKE 'nation:%') AS edge_count, 'c_acctbal,n_name' AS prop_keys""",
)(lambda g: O.emission(seen(g)))
on_graph(
    "scope_filter",
    f"WITH {GRAPH} SELECT src, dst, label FROM edges WHERE (src LIKE 'customer:%' OR src LIKE 'nation:%') AND dst LIKE 'nation:%' AND src NOT LIKE 'customer:1%'",
)(lambda g: O.scope(g, ["customer:", "nation:"], ["customer:1"]).edges)
on_graph(
    "translation_cost",
    f"""WITH {GRAPH_PROPS}, a AS (SELECT node_id FROM nodes WHERE node_id LIKE 'customer:%' OR node_id LIKE 'nation:%'),
    n AS (SELECT avg(CASE WHEN node_id LIKE 'nation:%' THEN 0.0 ELSE 1.0 END) AS loss FROM a),
    p AS (SELECT avg(CASE WHEN node_id LIKE 'nation:%' THEN 0.0 ELSE 1.0 END) AS loss FROM node_props WHERE node_id IN (SELECT node_id FROM a))
    SELECT round(n.loss, 6) AS node_loss, 1.0::DOUBLE AS edge_loss, round(p.loss, 6) AS prop_loss,
           round(0.5 * n.loss + 0.3 + 0.2 * p.loss, 6) AS cost FROM n, p""",
)(lambda g: O.translation_cost(O.observe(g, ["customer:*", "nation:*"]), O.observe(g, "nation:*")))
on_graph("observer_props", f"WITH {GRAPH_PROPS} SELECT node_id, key, num AS value FROM node_props WHERE key = 'c_acctbal' UNION ALL SELECT node_id, key, NULL FROM node_props WHERE key = 'n_name'")(
    lambda g: seen(g).node_props.select("node_id", "key", F.col("value_num").alias("value"))
)
# FNV-1a, byte by byte: the products stay below 2**63
on_graph(
    "shard_key",
    f"""WITH {GRAPH}, h AS (SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(node_id, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, y: (xor(x, y) * 16777619) % 4294967296) AS f FROM nodes)
    SELECT lower(lpad(to_hex(f % 256), 2, '0')) AS shard, count(*) AS n FROM h GROUP BY 1""",
)(lambda g: g.nodes.groupBy(shard_key(F.col("node_id")).alias("shard")).agg(F.count("*").alias("n")))

# -- traversals ------------------------------------------------------------------------------------------------------

REACH = f"""WITH RECURSIVE {GRAPH}, walk AS (
  SELECT 'part:1' AS node_id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node_id WHERE w.depth < 6)"""
on_graph("bfs", f"{REACH} SELECT node_id, min(depth)::INTEGER AS depth FROM walk GROUP BY node_id")(lambda g: T.bfs(g.edges, g.nodes, "part:1"))
on_graph(
    "shortest_path",
    f"""WITH RECURSIVE {GRAPH}, walk AS (
      SELECT 'order:1' AS node_id, 'order:1' AS path, 0 AS d
      UNION ALL SELECT e.dst, w.path || '/' || e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.node_id WHERE w.d < 5)
    SELECT true AS found, d::INTEGER AS length, path FROM walk WHERE node_id = 'region:1' ORDER BY d, list_reverse(string_split(path, '/')) LIMIT 1""",
)(lambda g: T.shortest_path(g.edges, g.nodes, "order:1", "region:1"))
on_graph("is_reachable", f"{REACH} SELECT count(*) > 0 AS reachable FROM walk WHERE node_id = 'region:2'")(lambda g: T.is_reachable(g.edges, "part:1", "region:2"))
on_graph(
    "connected_component",
    f"""WITH RECURSIVE {GRAPH}, e2 AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    walk AS (SELECT 'region:0' AS node_id UNION SELECT dst FROM walk JOIN e2 ON src = node_id) SELECT node_id FROM walk""",
)(lambda g: T.component(g.edges, g.nodes, "region:0"))
CLOSURE = f"WITH RECURSIVE {GRAPH}, walk AS (SELECT src, dst FROM edges UNION SELECT w.src, e.dst FROM walk w JOIN edges e ON e.src = w.dst)"
on_graph("transitive_closure", f"{CLOSURE} SELECT src, dst FROM walk WHERE src <> dst")(lambda g: T.closure(g.edges, g.nodes))
on_graph("transitive_reduction", f"WITH {GRAPH} SELECT src, dst, label FROM edges")(lambda g: T.reduction(g.edges.union(shortcuts(g)), g.nodes))


def shortcuts(g: Graph) -> DataFrame:
    """From each supplier to its region and from each order to its customer's nation: what a reduction has to drop."""
    then = lambda first, second: (
        g.edges.where(F.col("label") == first).select("src", F.col("dst").alias("m")).join(g.edges.where(F.col("label") == second).select(F.col("src").alias("m"), "dst"), "m")
    )
    return then("in_nation", "in_region").union(then("placed_by", "in_nation")).select("src", "dst", F.lit("shortcut").alias("label"))


on_graph(
    "common_ancestors",
    f"WITH {GRAPH} SELECT node_id FROM (SELECT 'x' AS node_id WHERE false UNION ALL SELECT a.src FROM edges a JOIN edges b USING (src) WHERE a.dst = 'supplier:1' AND b.dst = 'supplier:2' "
    "UNION SELECT o.src FROM edges o WHERE o.label = 'contains' AND EXISTS (SELECT 1 FROM edges p JOIN edges s ON s.src = p.dst WHERE p.src = o.src AND s.dst = 'supplier:1') "
    "AND EXISTS (SELECT 1 FROM edges p JOIN edges s ON s.src = p.dst WHERE p.src = o.src AND s.dst = 'supplier:2')) GROUP BY node_id ORDER BY 1 LIMIT 100",
)(lambda g: T.common_ancestors(g.edges, g.nodes, ["supplier:1", "supplier:2"]))
on_graph(
    "root_ancestors",
    f"""WITH {GRAPH} SELECT DISTINCT src AS node_id FROM edges WHERE label = 'placed_by' AND dst = 'customer:1'
    UNION SELECT 'customer:1' WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = 'customer:1')""",
)(lambda g: T.root_ancestors(g.edges, g.nodes, "customer:1"))
on_graph(
    "levels",
    f"""WITH RECURSIVE {GRAPH}, walk AS (
      SELECT 'order:1' AS node_id, 0 AS level UNION SELECT e.dst, w.level + 1 FROM walk w JOIN edges e ON e.src = w.node_id WHERE w.level < 6)
    SELECT node_id, max(level)::INTEGER AS level FROM walk GROUP BY node_id""",
)(lambda g: T.levels(g.edges, g.nodes, ["order:1"]))
price = lambda g: g.edge_props.where("key = 'quantity'").select("src", "dst", "label", F.col("value_num").alias("w"))
WALK = f"""WITH RECURSIVE {GRAPH}, q AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
s AS (SELECT src, dst, coalesce(w, 1.0) AS w FROM edges LEFT JOIN q USING (src, dst) WHERE label <> 'placed_by'),
walk AS (SELECT 'order:1' AS node_id, 'order:1' AS path, CAST(0 AS DOUBLE) AS cost, 0 AS d UNION ALL SELECT s.dst, path || '/' || s.dst, cost + s.w, d + 1 FROM walk JOIN s ON s.src = node_id WHERE d < 5)
SELECT cost::DOUBLE AS cost FROM walk WHERE node_id = (SELECT 'region:' || min(r_regionkey) FROM region) ORDER BY cost {{order}} LIMIT 1"""
bought = lambda g: g.edges.where("label <> 'placed_by'")
on_graph("weighted_shortest_path", WALK.format(order="ASC"))(lambda g: T.weighted_shortest_path(bought(g), g.nodes, "order:1", "region:0", weights=price(g)).select("cost"))
on_graph("weighted_longest_path", WALK.format(order="DESC"))(lambda g: T.weighted_longest_path(bought(g), g.nodes, "order:1", "region:0", weights=price(g)).select("cost"))
on_graph(
    "bounded_traversal",
    f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT 'part:1' AS node_id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM walk JOIN edges e ON src = node_id WHERE depth < 2),
    f AS (SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id ORDER BY 2, 1 LIMIT 1000)
    SELECT (depth + 1)::INTEGER AS depth, src, dst, label FROM f JOIN edges ON src = node_id WHERE depth < 2 ORDER BY 1, 2, 3, 4 LIMIT 50""",
)(lambda g: T.bounded(g.edges, g.nodes, "part:1", 2, 1000, 50))
# orders of the whole graph's reachable part, by rules that SQL can state for this graph: its edges never skip back
on_graph("dfs")(lambda g: T.dfs(g.edges, "order:1"))
on_graph("topological_sort")(lambda g: T.topological_sort(g.edges, ["order:1", "order:2"]))
STEPS = f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT 'order:1' AS node_id, 0 AS d UNION SELECT e.dst, d + 1 FROM walk JOIN edges e ON src = node_id WHERE d < 8)
SELECT min(d)::DOUBLE AS cost FROM walk WHERE node_id = (SELECT min(node_id) FROM walk WHERE node_id LIKE 'region:%')"""
on_graph("a_star", STEPS)(lambda g: T.a_star(g.edges, "order:1", nearest_region(g)).select("cost"))
on_graph("bidirectional_a_star", STEPS)(lambda g: T.bidirectional_a_star(g.edges, "order:1", nearest_region(g)).select("cost"))


def nearest_region(g: Graph) -> str:
    """The smallest region that order:1 reaches; one row."""
    return T.bfs(g.edges, g.nodes, "order:1").where("node_id like 'region:%'").agg(F.min("node_id")).first()[0]


FIXTURES = {
    "dfs": ("A>B A>C B>D C>E", "ABDCE"),
    "topological_sort": ("A>B A>C B>D C>D", "ABCD"),
}


def fixture(spark: SparkSession, edges: str) -> DataFrame:
    return spark.createDataFrame([(*e.split(">"), "e") for e in edges.split()], "src string, dst string, label string")


for name, (steps, order) in FIXTURES.items():
    rows = ", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate(order))
    kernel = {"dfs": lambda e: T.dfs(e, "A"), "topological_sort": lambda e: T.topological_sort(e, ["A"]).select("position", "node_id")}[name]
    query(f"{name}_fixture", f"SELECT * FROM (VALUES {rows}) t(position, node_id)")(lambda spark, d, steps=steps, kernel=kernel: kernel(fixture(spark, steps)))

# -- the fold and what is read off it --------------------------------------------------------------------------------

on_log("discover_writers", f"WITH {LOG} SELECT DISTINCT writer FROM b")(lambda g: g.patches.select("writer").distinct().orderBy("writer"))
on_log("discover_ticks", f"WITH {LOG} SELECT lamport, count(*) AS n_patches FROM b GROUP BY lamport")(
    lambda g: g.patches.groupBy("lamport").agg(F.count("*").alias("n_patches"))
)
on_log("patch_chain", f"WITH {LOG} SELECT sha, lamport AS seq FROM b WHERE writer = 'w3' AND lamport BETWEEN 10 AND 60")(
    lambda g: g.patches.where("writer = 'w3' and seq between 10 and 60").select("sha", "seq").orderBy("seq")
)
on_log("fold_nodes", f"WITH {STATE} SELECT node AS node_id FROM live_nodes")(lambda g: V.graph(D.fold(g)).nodes)
on_log("fold_edges", f"WITH {STATE} SELECT src, dst, label FROM live_edges")(lambda g: V.graph(D.fold(g)).edges)
on_log("fold_node_props", f"WITH {STATE} SELECT node AS node_id, key, round(value, 4) AS value FROM live_node_props")(
    lambda g: V.graph(D.fold(g)).node_props.select("node_id", "key", value())
)
on_log("fold_edge_props", f"WITH {STATE} SELECT src, dst, label, key, round(value, 4) AS value FROM live_edge_props")(
    lambda g: V.graph(D.fold(g)).edge_props.select("src", "dst", "label", "key", value())
)
on_log("orset_elements", f"WITH {STATE} SELECT node, count(*) AS n_dots FROM live_dots GROUP BY node")(
    lambda g: D.live_dots((s := D.fold(g)).node_adds, s.node_tombs).groupBy("node").agg(F.count("*").alias("n_dots"))
)
on_log("lww_props", f"WITH {STATE} SELECT src, dst, label, key, round(value, 4) AS value FROM edge_win")(
    lambda g: D.fold(g).edge_props.select("src", "dst", "label", "key", value())
)
on_log("observed_frontier", f"WITH {LOG} SELECT writer, max(lamport) AS counter FROM b GROUP BY writer")(lambda g: D.fold(g).frontier)
PROJECTION = """SELECT 'node' AS kind, node AS name, '' AS value FROM live_nodes
UNION ALL SELECT 'edge', src || '|' || dst || '|' || label, '' FROM live_edges
UNION ALL SELECT 'node_prop', node || '|' || key, 'number=' || CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) FROM live_node_props
UNION ALL SELECT 'edge_prop', src || '|' || dst || '|' || label || '|' || key, 'number=' || CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) FROM live_edge_props"""
on_log("state_projection", f"WITH {STATE} {PROJECTION}")(lambda g: V.projection(V.settled(D.materialize(g))))
on_log("state_hash")(lambda g: V.state_hash(V.settled(D.materialize(g))))
on_log("join_states", f"WITH {STATE} {PROJECTION}")(
    lambda g: V.projection(V.settled(written(D.joined(*(D.folded(D.entries(g.where(f"lamport % 2 = {i}"))) for i in (0, 1))), "cells", by="kind")))
)


def brought_forward(g: Log, t: int) -> DataFrame:
    """The cells of a snapshot at a tick and of the patches after it, joined."""
    return written(D.joined(D.materialize(g.where(F.col("lamport") <= t)), D.folded(D.entries(g.where(F.col("lamport") > t)))), "cells", by="kind")


on_log("materialize_incremental", f"WITH {STATE} {PROJECTION}")(
    lambda g: V.projection(V.settled(brought_forward(g, third(g))))
)
on_log("materialize_ceiling", f"WITH {state_at(EARLY)} SELECT node AS node_id FROM live_nodes")(
    lambda g: V.graph(D.fold(D.at_ceiling(g, third(g)))).nodes
)
on_log("materialize_coordinate", f"WITH {state_at(EARLY + ' AND writer IN (' + repr('w1') + ', ' + repr('w2') + ')')} SELECT node AS node_id FROM live_nodes")(
    lambda g: V.graph(D.fold(D.at_frontier(g, tips(g.where((F.col("lamport") <= third(g)) & F.col("writer").isin("w1", "w2")))))).nodes
)


def tips(g: Log) -> DataFrame:
    """(writer, tip_sha): the last patch of each writer."""
    return g.patches.groupBy("writer").agg(F.max_by("sha", "seq").alias("tip_sha"))


on_log("vv_merge", f"WITH {LOG} SELECT writer, max(lamport) AS counter FROM b WHERE {EARLY} OR writer < 'w4' GROUP BY writer")(
    lambda g: D.fold(g.where(F.col("lamport") <= third(g))).frontier.union(D.fold(g.where("writer < 'w4'")).frontier).groupBy("writer").agg(F.max("counter").alias("counter"))
)
on_log("vv_descends", f"WITH {LOG} SELECT true AS descends")(
    lambda g: D.descends(D.fold(g).frontier, D.fold(g.where(F.col("lamport") <= third(g))).frontier)
)
APPLIED = f"(SELECT writer, max(lamport) AS lim FROM b WHERE {EARLY} GROUP BY writer)"
limit = lambda g: g.patches.where(F.col("lamport") <= third(g)).groupBy("writer").agg(F.max("lamport").alias("counter"))
on_log(
    "vv_contains",
    f"WITH {LOG} SELECT DISTINCT a.writer AS dot_writer, a.lamport AS dot_counter, a.lamport <= coalesce(l.lim, 0) AS contained FROM node_add a LEFT JOIN {APPLIED} l USING (writer)",
)(lambda g: D.contains(limit(g), D.fold(g).node_adds.select("dot_writer", "dot_counter").distinct()))
on_log("vv_increment", f"WITH {LOG} SELECT writer, max(lamport) + CASE WHEN writer = 'w3' THEN 1 ELSE 0 END AS counter FROM b GROUP BY writer UNION ALL SELECT 'zz', 1")(
    lambda g: D.increment(D.increment(D.fold(g).frontier, "w3"), "zz")
)
on_log(
    "gc_compact",
    f"WITH {STATE} SELECT node, writer AS dot_writer, lamport AS dot_counter FROM node_add a WHERE NOT EXISTS (SELECT 1 FROM node_tomb t JOIN {APPLIED} l ON t.dw = l.writer WHERE t.dw = a.writer AND t.dc = a.lamport AND t.dc <= l.lim)",
)(lambda g: D.compact(D.fold(g), limit(g)).node_adds)
on_log(
    "gc_metrics",
    f"""WITH {STATE}, c AS (SELECT (SELECT count(*) FROM node_add) + (SELECT count(*) FROM edge_add) AS entries,
    (SELECT count(*) FROM node_add a JOIN node_tomb t ON t.dw = a.writer AND t.dc = a.lamport) + (SELECT count(*) FROM edge_add a JOIN edge_tomb t ON t.dw = a.writer AND t.dc = a.lamport) AS tombstones)
    SELECT entries, entries - tombstones AS live, tombstones, round(tombstones / entries, 6) AS ratio FROM c""",
)(lambda g: D.metrics(D.fold(g)).withColumn("ratio", F.round("ratio", 6)))
on_log(
    "gc_policy",
    f"""WITH {STATE}, c AS (SELECT (SELECT count(*) FROM node_add) + (SELECT count(*) FROM edge_add) AS entries, (SELECT count(*) FROM b) AS patches, (SELECT max(lamport) FROM b) AS ticks,
    (SELECT count(*) FROM node_add a JOIN node_tomb t ON t.dw = a.writer AND t.dc = a.lamport) + (SELECT count(*) FROM edge_add a JOIN edge_tomb t ON t.dw = a.writer AND t.dc = a.lamport) AS tombstones)
    SELECT tombstones / entries > 0.3 AS over_ratio, entries > 50000 AS over_entries, patches > 1000 AS over_patches, ticks > 10000 AS over_ticks,
    tombstones / entries > 0.3 OR entries > 50000 OR patches > 1000 OR ticks > 10000 AS should_run FROM c""",
)(
    lambda g: D.policy(
        D.metrics(D.fold(g)).join(g.patches.agg(F.count("*").alias("patches"), F.max("lamport").alias("ticks")), F.lit(True))
    ).select("over_ratio", "over_entries", "over_patches", "over_ticks", "should_run")
)

# -- receipts and conflicts ------------------------------------------------------------------------------------------

SETS = """, sets AS (SELECT sha, op_index, writer, lamport, node || '|' || key AS target, value FROM node_set
UNION ALL SELECT sha, op_index, writer, lamport, src || '|' || dst || '|' || label || '|' || key, value FROM edge_set),
judged AS (SELECT *, max({'lamport': lamport, 'writer': writer, 'sha': sha, 'op_index': op_index}) OVER (PARTITION BY target ORDER BY writer, lamport, op_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sets),
r AS (SELECT *, CASE WHEN top IS NULL OR (lamport, writer, sha, op_index) > (top.lamport, top.writer, top.sha, top.op_index) THEN 'applied' ELSE 'superseded' END AS result FROM judged),
fin AS (SELECT * FROM (SELECT target, sha AS wsha, writer AS wwriter, lamport AS wlamport, value AS wvalue, row_number() OVER (PARTITION BY target ORDER BY lamport DESC, writer DESC, sha DESC, op_index DESC) AS n FROM sets) WHERE n = 1)"""
on_log(
    "receipts_props",
    f"WITH {LOG}{SETS} SELECT sha, op_index, target, result, CASE WHEN result = 'superseded' THEN 'LWW: writer ' || top.writer || ' at lamport ' || top.lamport || ' wins' END AS reason FROM r",
)(lambda g: R.prop_receipts(g).select("sha", "op_index", "target", "result", "reason"))
on_log(
    "receipts_adds",
    f"WITH {LOG} SELECT sha, op_index, node AS target, 'applied' AS result FROM node_add UNION ALL SELECT sha, op_index, src || '|' || dst || '|' || label, 'applied' FROM edge_add",
)(lambda g: R.add_receipts(g).select("sha", "op_index", "target", "result"))
on_log(
    "receipts_removes",
    f"""WITH {LOG}, rem AS (SELECT 'n' AS family, sha, op_index, writer, lamport, node AS target, node AS t FROM node_rem UNION ALL SELECT 'e', sha, op_index, writer, lamport, src || '|' || dst || '|bought', src || '|' || dst FROM edge_rem),
    ad AS (SELECT 'n' AS family, writer AS aw, lamport AS al, node AS t FROM node_add UNION ALL SELECT 'e', writer, lamport, src || '|' || dst FROM edge_add),
    d AS (SELECT r.*, aw, al, row_number() OVER (PARTITION BY r.family, aw, al ORDER BY r.writer, r.lamport, r.op_index) AS n, (aw, al) < (r.writer, r.lamport) AS born FROM rem r JOIN ad USING (family, t) WHERE al < r.lamport)
    SELECT sha, op_index, target, CASE WHEN (sha, op_index) IN (SELECT (sha, op_index) FROM d WHERE n = 1 AND born) THEN 'applied' ELSE 'redundant' END AS result FROM rem""",
)(lambda g: R.remove_receipts(g).select("sha", "op_index", "target", "result"))
on_log("conflict_supersession", f"WITH {LOG}{SETS} SELECT target, sha AS loser, wsha AS winner FROM r JOIN fin USING (target) WHERE result = 'superseded'")(R.supersessions)
on_log(
    "conflict_eventual_override",
    f"WITH {LOG}{SETS} SELECT target, sha AS loser, wsha AS winner, 'concurrent' AS relation FROM r JOIN fin USING (target) WHERE result = 'applied' AND sha <> wsha AND writer <> wwriter AND CAST(value AS DECIMAL(20,4)) <> CAST(wvalue AS DECIMAL(20,4))",
)(R.eventual_overrides)


@query(
    "merge3_fields",
    """WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS base FROM customer),
    l AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'LEFT' ELSE c_mktsegment END AS l FROM customer WHERE c_custkey % 7 <> 0),
    r AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 = 0 THEN 'RIGHT' ELSE c_mktsegment END AS r FROM customer WHERE c_custkey % 11 <> 0),
    j AS (SELECT * FROM p FULL JOIN l USING (key) FULL JOIN r USING (key)),
    c AS (SELECT *, l IS DISTINCT FROM base AS ln, r IS DISTINCT FROM base AS rn FROM j)
    SELECT key, base, l, r, CASE WHEN ln AND rn AND l IS DISTINCT FROM r THEN 'obstruction' ELSE 'join' END AS outcome,
    CASE WHEN ln AND rn AND l IS DISTINCT FROM r THEN NULL WHEN ln THEN l ELSE r END AS value FROM c WHERE ln OR rn""",
)
def merge3_fields(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    key, seg, k = F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment"), F.col("c_custkey")
    left = c.where(k % 7 != 0).select(key, F.when(k % 3 == 0, "LEFT").otherwise(seg).alias("value"))
    right = c.where(k % 11 != 0).select(key, F.when(k % 5 == 0, "RIGHT").otherwise(seg).alias("value"))
    return R.merge3(c.select(key, seg.alias("value")), left, right)


@query(
    "merge_classify",
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 5 = 0 AS policy, c_custkey % 3 = 0 AS joins, c_custkey % 2 = 0 AS lowering, c_custkey % 7 = 0 AS obstructed FROM customer)
    SELECT id, CASE WHEN policy THEN 'governance' WHEN joins THEN 'projection' ELSE 'semantic' END AS class,
    CASE WHEN policy THEN 'high' WHEN joins AND lowering THEN 'high' WHEN joins THEN 'medium' WHEN obstructed THEN 'high' ELSE 'medium' END AS confidence FROM c""",
)
def merge_classify(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), (k % 5 == 0).alias("policy"), (k % 3 == 0).alias("joins"), (k % 2 == 0).alias("lowering"), (k % 7 == 0).alias("obstructed"))
    return R.classify(rows).select("id", "class", "confidence")


# -- history ---------------------------------------------------------------------------------------------------------


def coordinates(g: Log) -> tuple[Graph, Graph]:
    """The graphs at both coordinates, from one fold with a ceiling each."""
    cells = D.materialize(g, (third(g), None))
    return V.settled(cells, 0), V.settled(cells, 1)


def two(sql: str) -> str:
    """SQL over the states at both coordinates, as a_ and b_ tables."""
    return f"WITH {state_at(EARLY, 'a_')}, {state_at('true', 'b_')} {sql}"


def delta(table: str, keys: str, valued: bool) -> str:
    before, after = (f"CAST(CAST({s}.value AS DECIMAL(20,4)) AS VARCHAR)" if valued else f"'{s}'" for s in ("x", "y"))
    more = "'number=' || before AS before, 'number=' || after AS after, " if valued else ""
    differ = "before IS DISTINCT FROM after" if valued else "(before IS NULL OR after IS NULL)"
    return f"""SELECT {keys}, {more}CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (
      SELECT {keys}, {before if valued else "CASE WHEN x.p THEN 'x' END"} AS before, {after if valued else "CASE WHEN y.p THEN 'y' END"} AS after
      FROM (SELECT *, true AS p FROM a_{table}) x FULL JOIN (SELECT *, true AS p FROM b_{table}) y USING ({keys})) WHERE {differ}"""


NODES = delta("live_nodes", "node", False)
EDGES = delta("live_edges", "src, dst, label", False)
NODE_PROPS = delta("live_node_props", "node, key", True)
EDGE_PROPS = delta("live_edge_props", "src, dst, label, key", True)
for name, part, sql in (
    ("compare_nodes", "nodes", NODES.replace("SELECT node, ", "SELECT node AS node_id, ", 1)),
    ("compare_edges", "edges", EDGES),
    ("compare_node_props", "node_props", NODE_PROPS.replace("SELECT node, key, ", "SELECT node AS node_id, key, ", 1)),
    ("compare_edge_props", "edge_props", EDGE_PROPS),
):
    on_log(name, two(sql))(lambda g, part=part: H.changes(*coordinates(g), part))
for name, part, sql in (
    ("state_diff_nodes", "nodes", NODES.replace("SELECT node, ", "SELECT node AS node_id, ", 1)),
    ("state_diff_edges", "edges", EDGES),
    ("state_diff_props", "node_props", NODE_PROPS.replace("SELECT node, key, ", "SELECT node AS node_id, key, ", 1)),
):
    on_log(name, two(sql))(lambda g, part=part: H.state_diff(*coordinates(g))[part])
SUMMARY = two(
    f"SELECT part, change, count(*) AS n FROM (SELECT 'nodes' AS part, change FROM ({NODES}) UNION ALL SELECT 'edges', change FROM ({EDGES}) "
    f"UNION ALL SELECT 'node_props', change FROM ({NODE_PROPS}) UNION ALL SELECT 'edge_props', change FROM ({EDGE_PROPS})) GROUP BY part, change"
)
on_log("compare_summary", SUMMARY)(lambda g: H.compare_summary(*coordinates(g)))
on_log("tick_diff", SUMMARY)(lambda g: H.tick_diff(g, third(g), None))
on_log(
    "transfer_plan",
    two(
        f"""SELECT phase::INTEGER AS phase, op, name, value FROM (
        SELECT CASE change WHEN 'added' THEN 1 ELSE 8 END AS phase, CASE change WHEN 'added' THEN 'addNode' ELSE 'removeNode' END AS op, node AS name, NULL AS value FROM ({NODES})
        UNION ALL SELECT CASE change WHEN 'added' THEN 4 ELSE 7 END, CASE change WHEN 'added' THEN 'addEdge' ELSE 'removeEdge' END, src || '|' || dst || '|' || label, NULL FROM ({EDGES})
        UNION ALL SELECT CASE change WHEN 'removed' THEN 3 ELSE 2 END, CASE change WHEN 'removed' THEN 'clearNodeProp' ELSE 'setNodeProp' END, node || '|' || key, after FROM ({NODE_PROPS})
        UNION ALL SELECT CASE change WHEN 'removed' THEN 6 ELSE 5 END, CASE change WHEN 'removed' THEN 'clearEdgeProp' ELSE 'setEdgeProp' END, src || '|' || dst || '|' || label || '|' || key, after FROM ({EDGE_PROPS}))"""
    ),
)(lambda g: H.transfer_plan(*coordinates(g)))
on_log("equivalence_gate", f"WITH {LOG} SELECT true AS equivalent, 0::BIGINT AS n_different, CAST(NULL AS VARCHAR) AS first_different")(
    lambda g: H.equivalent(V.settled(D.materialize(g)), V.settled(written(D.joined(*(D.folded(D.entries(g.where(f"lamport % 3 {x}"))) for x in ("= 0", "> 0"))), "cells", by="kind")))
)
on_log(
    "equivalence_gate_differs",
    f"""WITH {state_at(EARLY)}, p AS ({PROJECTION})
    SELECT false AS equivalent, count(*) AS n_different, min(kind || '|' || name) AS first_different FROM p WHERE kind <> 'node' """,
)(lambda g: H.equivalent((a := V.settled(D.materialize(g.where(F.col("lamport") <= third(g))))), Graph(a.nodes, a.edges.limit(0), a.node_props.limit(0), a.edge_props.limit(0))))
on_log(
    "patch_divergence",
    f"WITH {LOG} SELECT sha, CASE WHEN {EARLY} THEN 'shared' WHEN writer < 'w4' THEN 'left' ELSE 'right' END AS side FROM b",
)(
    lambda g: H.patch_divergence(*(g.where((F.col("lamport") <= third(g)) | F.expr(side)) for side in ("writer < 'w4'", "writer >= 'w4'")))
)
TEMPORAL = f"""WITH {LOG}, sets AS (SELECT lamport, writer, sha, value FROM node_set WHERE node = 'user:7')
SELECT coalesce(bool_and(value > 0), false) AS always, coalesce(bool_or(value > 50), false) AS eventually FROM sets"""
on_log("temporal_always", TEMPORAL.replace(", coalesce(bool_or(value > 50), false) AS eventually", ""))(
    lambda g: H.temporal(g, "user:7", "score", F.col("value_num") > 0).select("always")
)
on_log("temporal_eventually", TEMPORAL.replace("coalesce(bool_and(value > 0), false) AS always, ", ""))(
    lambda g: H.temporal(g, "user:7", "score", F.col("value_num") > 50).select("eventually")
)
FOOT = """, foot AS (SELECT sha, item AS entity, 'write' AS kind FROM b WHERE kind IN ('view', 'click', 'error')
UNION ALL SELECT sha, item, 'read' FROM b WHERE kind IN ('error', 'purchase') UNION ALL SELECT sha, usr, 'read' FROM b WHERE kind = 'purchase'
UNION ALL SELECT sha, usr, 'write' FROM b WHERE kind = 'signup' UNION ALL SELECT sha, usr || '->' || item, 'write' FROM b WHERE kind = 'purchase')"""
on_log("patches_for", f"WITH {LOG}{FOOT} SELECT entity, count(DISTINCT sha) AS n, string_agg(DISTINCT sha, ',' ORDER BY sha) AS shas FROM foot GROUP BY entity")(H.patches_for)
on_log(
    "materialize_slice",
    f"""WITH RECURSIVE {LOG}{FOOT}, cone AS (SELECT sha FROM foot WHERE entity = 'item:1.1' UNION SELECT g.sha FROM cone c JOIN foot f ON f.sha = c.sha AND f.kind = 'read' JOIN foot g ON g.entity = f.entity)
    SELECT sha FROM cone""",
)(lambda g: H.cone(g, "item:1.1"))
on_log("fork_chain", f"WITH {LOG} SELECT sha, writer, lamport, lamport AS seq FROM b WHERE writer = 'w2' AND lamport <= 50")(
    lambda g: H.fork_chain(g, "w2", g.patches.where("writer = 'w2' and seq = 50").first()["sha"])
)
on_log("wormhole", f"WITH {LOG} SELECT 'w1' AS writer, 5::BIGINT AS first, 9::BIGINT AS last, 5::BIGINT AS n")(lambda g: H.wormhole(g, "w1", 5, 9).drop("payload"))

# -- exchange --------------------------------------------------------------------------------------------------------

on_log(
    "sync_delta",
    f"""WITH {LOG}, l AS (SELECT writer, arg_max(sha, lamport) AS l FROM b WHERE lamport <= 100 AND writer <> 'w0' GROUP BY writer),
    r AS (SELECT writer, arg_max(sha, lamport) AS r FROM b WHERE writer <> 'w1' AND (writer <> 'w2' OR lamport <= 100) GROUP BY writer)
    SELECT writer, CASE WHEN r IS NOT NULL THEN l END AS need_from, r AS need_to, CASE WHEN l IS NOT NULL THEN r END AS send_from, l AS send_to FROM l FULL JOIN r USING (writer) WHERE l IS DISTINCT FROM r""",
)(lambda g: X.sync_delta(X.frontier(g.where("lamport <= 100 and writer <> 'w0'")), X.frontier(g.where("writer <> 'w1' and (writer <> 'w2' or lamport <= 100)"))))
on_log("sync_response", f"WITH {LOG} SELECT writer, sha, lamport AS seq, CAST(NULL AS VARCHAR) AS reason FROM b WHERE lamport > 100 AND writer <> 'w0'")(
    lambda g: X.sync_response(g, X.frontier(g.where("lamport <= 100 and writer <> 'w0'")))
)
on_log(
    "strand_materialize",
    f"WITH {state_at('lamport <= 300 OR (writer = ' + repr('w1') + ' AND lamport <= 600) OR (writer = ' + repr('w2') + ' AND lamport <= 500)')} SELECT node AS node_id FROM live_nodes",
)(lambda g: V.graph(X.strand_state(g, g.where("writer = 'w1' and lamport <= 600"), [g.where("writer = 'w2' and lamport <= 500")], 300)).nodes)


@query(
    "trust_eval",
    """SELECT 'supplier:' || s_suppkey AS writer, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AS trusted,
    CASE WHEN s_suppkey % 2 <> 0 THEN 'WRITER_HAS_NO_BINDING' WHEN s_suppkey % 3 = 0 THEN 'BINDING_REVOKED' WHEN s_suppkey % 5 = 0 THEN 'KEY_REVOKED_OR_UNKNOWN' ELSE 'WRITER_BOUND_TO_ACTIVE_KEY' END AS reason FROM supplier""",
)
def trust_eval(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{d}/supplier.parquet").select(k, F.concat(F.lit("supplier:"), k.cast("string")).alias("writer"), F.concat(F.lit("key:"), k.cast("string")).alias("key_id"))
    rec = lambda cond, kind, seq: s.where(cond).select(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), "key_id", "writer")
    records = rec(k > 0, "KEY_ADD", 1).union(rec(k % 2 == 0, "WRITER_BIND_ADD", 2)).union(rec(k % 6 == 0, "WRITER_BIND_REVOKE", 3)).union(rec(k % 5 == 0, "KEY_REVOKE", 4))
    return X.trust_eval(s.select("writer"), X.trust_state(records))


@query("audit_chain", "SELECT conv_id AS chain, count(*) AS n, 'VALID' AS status, CAST(NULL AS BIGINT) AS first_bad, 0::BIGINT AS gaps FROM conversations GROUP BY conv_id")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("chain"), F.col("turn").alias("seq"), "role", "text")
    return X.audit_chain(X.audit_receipts(rows, F.concat_ws("|", "role", "text")))


on_log("watch_filter", two(f"SELECT node AS node_id, change FROM ({NODES}) WHERE node LIKE 'item:1%'"))(lambda g: X.watch(H.changes(*coordinates(g), "nodes"), "item:1*"))


@query("demux", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def demux(spark: SparkSession, d: str) -> DataFrame:
    routes = X.demux(spark.read.parquet(f"{d}/events.parquet").select("event_type"), F.col("event_type"), ["click", "view"])
    return routes["click"].union(routes["view"]).groupBy("event_type").agg(F.count("*").alias("n"))


on_graph("glob_match", f"WITH {GRAPH} SELECT node_id FROM nodes WHERE regexp_full_match(node_id, 'c.*r:.*7')")(lambda g: g.nodes.where(glob("c*r:*7", F.col("node_id"))))
