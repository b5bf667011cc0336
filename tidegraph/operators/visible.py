"""What a reader sees of a state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.fold import EDGE, VALUE, State, alive, state_of
from tidegraph.sources.shared import written
from tidegraph.sources.star_graph import Graph


def graph(state: State, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> Graph:
    """Live nodes; live edges with both ends live; properties of those, edge properties since the edge's last birth.

    hold keeps what several parts go by, the live nodes and edges: as it is, or as a table.
    """
    nodes = hold(alive(state.node_adds, state.node_tombs, ["node"]).withColumnRenamed("node", "node_id"))
    ends = lambda c: nodes.withColumnRenamed("node_id", c)
    edges = hold(alive(state.edge_adds, state.edge_tombs, EDGE).join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select(*EDGE))
    node_props = state.node_props.withColumnRenamed("node", "node_id").join(nodes, "node_id", "left_semi").select("node_id", "key", *VALUE)
    born = edges.join(state.births, EDGE)
    edge_props = state.edge_props.join(born, EDGE).where(F.col("at") >= F.col("birth")).select(*EDGE, "key", *VALUE)
    return Graph(nodes, edges, node_props, edge_props)


def settled(cells: DataFrame, i: int = 0) -> Graph:
    """The visible graph of written cells, its nodes and edges written as well."""
    return graph(state_of(cells, i), written)


def value_text() -> Column:
    """One comparable string per value: its type and its text."""
    return F.concat_ws("=", "value_type", F.coalesce(F.col("value_num").cast("decimal(20,4)").cast("string"), F.col("value_str"), F.lit("")))


def projection(g: Graph) -> DataFrame:
    """(kind, name, value) of everything visible, sorted by kind and name."""
    edge = F.concat_ws("|", *EDGE)
    rows = (
        g.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("name"), F.lit("").alias("value"))
        .union(g.edges.select(F.lit("edge"), edge, F.lit("")))
        .union(g.node_props.select(F.lit("node_prop"), F.concat_ws("|", "node_id", "key"), value_text()))
        .union(g.edge_props.select(F.lit("edge_prop"), F.concat_ws("|", edge, F.col("key")), value_text()))
    )
    return rows.orderBy("kind", "name", "value")


def state_hash(g: Graph) -> DataFrame:
    """One row: a digest of the visible state that doesn't depend on order or partitioning.

    Row digests are summed by 32-bit words, so no task ever holds more than a few numbers, and equal states of any
    size give equal digests.
    """
    row = F.sha2(F.concat_ws("\x00", "kind", "name", "value"), 256)
    rows = projection(g).select(row.alias("d"))
    words = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return rows.agg(F.count("*").alias("n"), *(w.alias(f"w{i}") for i, w in enumerate(words))).select(
        F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(F.coalesce(f"w{i}", F.lit("0")) for i in range(8))), 256).alias("state_hash")
    )
