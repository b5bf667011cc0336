"""A static graph from a star schema's tables: nodes, labelled edges and properties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Visible graph: nodes(node_id), edges(src, dst, label), and properties with typed value columns."""

    nodes: DataFrame
    edges: DataFrame
    node_props: DataFrame
    edge_props: DataFrame

    # What a reader may ask for when it knows what its ids begin with (their kinds, None for any). A graph that keeps
    # its kinds apart answers from those alone.

    def kinds_of(self, pattern: str | list[str]) -> frozenset[str] | None:
        return None

    def nodes_of(self, kinds: frozenset[str] | None) -> DataFrame:
        return self.nodes

    def props_of(self, kinds: frozenset[str] | None, keys: list[str] | None = None) -> DataFrame:
        return self.node_props if keys is None else self.node_props.where(F.col("key").isin(*keys))

    def edges_of(self, kinds: frozenset[str] | None, direction: str, label: str | None) -> tuple[DataFrame, frozenset[str] | None]:
        """The edges that lead out of (or into) nodes of these kinds, and the kinds of their other ends."""
        return (self.edges if label is None else self.edges.where(F.col("label") == label)), None


def union_of(parts: list[DataFrame], none: Callable[[], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else none()


PROPERTY = "key string, value_type string, value_num double, value_str string"


#: Table, prefix of its ids, key column, numeric and string properties.
ENTITIES = (
    ("region", "region", "r_regionkey", (), ("r_name",)),
    ("nation", "nation", "n_nationkey", (), ("n_name",)),
    ("customer", "customer", "c_custkey", ("c_acctbal",), ("c_name", "c_mktsegment")),
    ("supplier", "supplier", "s_suppkey", ("s_acctbal",), ("s_name",)),
    ("part", "part", "p_partkey", ("p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")),
    ("orders", "order", "o_orderkey", ("o_totalprice",), ("o_orderstatus", "o_orderpriority")),
)
#: Table, source prefix and column, target prefix and column, label.
RELATIONS = (
    ("nation", "nation", "n_nationkey", "region", "n_regionkey", "in_region"),
    ("customer", "customer", "c_custkey", "nation", "c_nationkey", "in_nation"),
    ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"),
    ("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by"),
    ("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains"),
    ("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "supplied_by"),
)


def node_id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def properties(df: DataFrame, kind: str, key: str, numbers: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """(node_id, key, value_type, value_num, value_str) of these columns."""
    entry = lambda c, kind, number, text: F.struct(F.lit(c).alias("key"), F.lit(kind).alias("value_type"), number.alias("value_num"), text.alias("value_str"))
    entries = [entry(c, "number", F.col(c).cast("double"), F.lit(None).cast("string")) for c in numbers]
    entries += [entry(c, "string", F.lit(None).cast("double"), F.col(c)) for c in texts]
    return df.select(node_id(kind, key).alias("node_id"), F.inline(F.array(*entries)))


class StarGraph(Graph):
    """A graph whose kinds of nodes are tables, so a reader of some kinds opens and scans their tables alone."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None):
        state = {"spark": spark, "sf_dir": sf_dir, "opened": {}}
        state["parts"] = {kind: (table, *rest) for table, kind, *rest in ENTITIES if tables is None or table in tables}
        state["relations"] = [r for r in RELATIONS if r[1] in state["parts"] and r[3] in state["parts"]]
        self.__dict__.update(state)

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.opened[name]

    def related(self, relation: tuple[str, ...]) -> DataFrame:
        table, a, a_key, b, b_key, label = relation
        rows = self.table(table).select(node_id(a, a_key).alias("src"), node_id(b, b_key).alias("dst"))
        return (rows.distinct() if table == "lineitem" else rows).withColumn("label", F.lit(label))

    def none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.nodes_of(None)

    @cached_property
    def edges(self) -> DataFrame:
        return self.edges_of(None, "out", None)[0]

    @cached_property
    def node_props(self) -> DataFrame:
        return self.props_of(None)

    @cached_property
    def edge_props(self) -> DataFrame:
        if not {"order", "part"} <= set(self.parts):
            return self.none(f"src string, dst string, label string, {PROPERTY}")
        price = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"))
        pairs = F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit("number").alias("value_type"), F.col(k).alias("value_num"), F.lit(None).cast("string").alias("value_str")) for k in ("quantity", "price"))))
        return price.select(node_id("order", "l_orderkey").alias("src"), node_id("part", "l_partkey").alias("dst"), F.lit("contains").alias("label"), pairs)

    def kinds_of(self, pattern: str | list[str]) -> frozenset[str] | None:
        heads = [p.split("*")[0] for p in ([pattern] if isinstance(pattern, str) else pattern)]
        return frozenset(k for k in self.parts if any(h.startswith(k + ":") or (k + ":").startswith(h) for h in heads))

    def nodes_of(self, kinds: frozenset[str] | None) -> DataFrame:
        chosen = [(k, *p) for k, p in self.parts.items() if kinds is None or k in kinds]
        return union_of([self.table(t).select(node_id(k, key).alias("node_id")) for k, t, key, *_ in chosen], lambda: self.none("node_id string"))

    def props_of(self, kinds: frozenset[str] | None, keys: list[str] | None = None) -> DataFrame:
        wanted = lambda c: keys is None or c in keys
        found = []
        for k, (table, key, numbers, texts) in self.parts.items():
            numbers, texts = tuple(filter(wanted, numbers)), tuple(filter(wanted, texts))
            if (kinds is None or k in kinds) and numbers + texts:
                found.append(properties(self.table(table), k, key, numbers, texts))
        return union_of(found, lambda: self.none(f"node_id string, {PROPERTY}"))

    def edges_of(self, kinds: frozenset[str] | None, direction: str, label: str | None) -> tuple[DataFrame, frozenset[str] | None]:
        own, other = (1, 3) if direction == "out" else (3, 1)
        chosen = [r for r in self.relations if (kinds is None or r[own] in kinds) and label in (None, r[5])]
        return union_of([self.related(r) for r in chosen], lambda: self.none("src string, dst string, label string")), frozenset(r[other] for r in chosen)


def load(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> StarGraph:
    """The graph of the given entity tables (all of them by default); each table's scan reads the columns in use alone."""
    return StarGraph(spark, sf_dir, tables)
