"""Direct reads and filtered views: neighbours, pages, apertures, scopes and the cost of translating between views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import glob
from tidegraph.operators.fold import EDGE
from tidegraph.sources.star_graph import Graph


def neighbours(g: Graph, ids: DataFrame, direction: str = "both", labels: list[str] | None = None, dedup: bool = False) -> DataFrame:
    """(node_id, direction, neighbour, label); both lists outgoing and incoming ones, merged only with dedup."""
    edges = g.edges if labels is None else g.edges.where(F.col("label").isin(*labels) if labels else F.lit(False))

    def side(own: str, other: str, name: str) -> DataFrame:
        found = edges.select(F.col(own).alias("node_id"), F.lit(name).alias("direction"), F.col(other).alias("neighbour"), "label")
        return found.join(ids, "node_id", "left_semi")

    sides = [side("src", "dst", "out")] * (direction != "in") + [side("dst", "src", "in")] * (direction != "out")
    both = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    return both.select("node_id", "neighbour", "label").distinct() if dedup else both


def page(g: Graph, node_id: str, limit: int = 100, cursor: tuple[str, str, str] | None = None, direction: str = "both", labels: list[str] | None = None) -> DataFrame:
    """One page of a node's neighbours in the order (direction, neighbour, label), after a cursor of that form."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page holds 1 to 1000 rows")
    ids = g.nodes.where(F.col("node_id") == node_id)
    rows = neighbours(g, ids, direction, labels)
    if cursor is not None:
        after = F.struct("direction", "neighbour", "label") > F.struct(*map(F.lit, cursor))
        rows = rows.where(after)
    return rows.orderBy("direction", "neighbour", "label").limit(limit)


def props_map(g: Graph) -> DataFrame:
    """(node_id, props): a map of every visible node's properties, empty where it has none."""
    text = F.coalesce(F.col("value_num").cast("decimal(20,2)").cast("string"), F.col("value_str"))
    packed = g.node_props.groupBy("node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", text.alias("v"))))).alias("props"))
    return g.nodes.join(packed, "node_id", "left")


def observe(g: Graph, match: str | list[str] = "*", expose: list[str] | None = None, redact: list[str] | None = None) -> Graph:
    """An aperture: nodes that match, edges with both ends among them, exposed properties but for redacted ones."""
    seen = F.col("node_id")
    nodes = g.nodes.where(glob(match, seen))
    ends = lambda c: glob(match, F.col(c))  # noqa: E731  a predicate on the ids themselves: no join
    keep = F.lit(True)
    if expose:
        keep = keep & F.col("key").isin(*expose)
    if redact:
        keep = keep & ~F.col("key").isin(*redact)
    inside = ends("src") & ends("dst")
    return Graph(nodes, g.edges.where(inside), g.node_props.where(glob(match, seen) & keep), g.edge_props.where(inside & keep))


def emission(g: Graph) -> DataFrame:
    """One row: nodes, edges and the sorted distinct keys of node properties."""
    kinds = (
        g.nodes.select(F.lit("n").alias("k"), F.lit(None).cast("string").alias("key"))
        .union(g.edges.select(F.lit("e"), F.lit(None).cast("string")))
        .union(g.node_props.select(F.lit("p"), "key").distinct())
    )
    return kinds.agg(
        F.count_if(F.col("k") == "n").alias("node_count"), F.count_if(F.col("k") == "e").alias("edge_count"), F.array_join(F.sort_array(F.collect_set("key")), ",").alias("prop_keys")
    )


def scope(g: Graph, include: list[str] | None = None, exclude: list[str] | None = None) -> Graph:
    """Ids that begin with an included prefix and no excluded one; edges need both ends."""

    def inside(c: str):
        ok = F.lit(not include)
        for p in include or ():
            ok = ok | F.col(c).startswith(p)
        for p in exclude or ():
            ok = ok & ~F.col(c).startswith(p)
        return ok

    both = inside("src") & inside("dst")
    return Graph(g.nodes.where(inside("node_id")), g.edges.where(both), g.node_props.where(inside("node_id")), g.edge_props.where(both))


def translation_cost(a: Graph, b: Graph) -> DataFrame:
    """One row: 0.5 of the nodes, 0.3 of the edges and 0.2 of the properties of view a that view b lacks; 0 if a is empty."""

    def lost(x: DataFrame, y: DataFrame, keys: list[str], name: str) -> DataFrame:
        marked = x.select(*keys).distinct().join(y.select(*keys).distinct().withColumn("_in", F.lit(1)), keys, "left")
        share = F.when(F.count("*") > 0, F.count_if(F.col("_in").isNull()) / F.count("*")).otherwise(F.lit(0.0))
        return marked.agg(share.alias("loss"), F.count("*").alias("n")).select(F.lit(name).alias("part"), "loss", "n")

    rows = (
        lost(a.nodes, b.nodes, ["node_id"], "node")
        .union(lost(a.edges, b.edges, EDGE, "edge"))
        .union(lost(a.node_props, b.node_props, ["node_id", "key"], "prop"))
    )
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("loss")))
    empty = F.max(F.when(F.col("part") == "node", F.col("n"))) == 0
    cost = F.when(empty, F.lit(0.0)).otherwise(F.round(0.5 * pick("node") + 0.3 * pick("edge") + 0.2 * pick("prop"), 6))
    return rows.agg(*(F.round(pick(p), 6).alias(f"{p}_loss") for p in ("node", "edge", "prop")), cost.alias("cost"))


def has_node(g: Graph, node_id: str) -> bool:
    return not g.nodes.where(F.col("node_id") == node_id).isEmpty()


def attachments(g: Graph) -> DataFrame:
    """(node_id, handle, mime, size) of the content that nodes carry."""
    at = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c)))
    rows = g.node_props.where(F.col("key").isin("_content", "_content.mime", "_content.size")).groupBy("node_id")
    found = rows.agg(at("_content", "value_str").alias("handle"), at("_content.mime", "value_str").alias("mime"), at("_content.size", "value_num").cast("long").alias("size"))
    return found.where("handle is not null")


