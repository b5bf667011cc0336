"""The fluent query: match, filter, hop, then project or aggregate."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import glob
from tidegraph.operators.fold import VALUE
from tidegraph.sources.star_graph import Graph


class QueryError(ValueError):
    """Carries the code of a misuse of the builder."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def snapshots(g: Graph, ids: DataFrame, kinds: frozenset[str] | None = None) -> DataFrame:
    """(node_id, props, edges_out, edges_in) for the given ids, for predicates over a whole node."""
    entry = F.struct("key", F.struct(*VALUE).alias("value"))
    props = g.props_of(kinds).join(ids, "node_id", "left_semi").groupBy("node_id").agg(F.map_from_entries(F.collect_list(entry)).alias("props"))
    side = lambda own, other, name: (
        g.edges_of(kinds, "out" if own == "src" else "in", None)[0]
        .join(ids.withColumnRenamed("node_id", own), own, "left_semi")
        .groupBy(F.col(own).alias("node_id"))
        .agg(F.sort_array(F.collect_list(F.struct("label", F.col(other).alias("to")))).alias(name))
    )
    return ids.join(props, "node_id", "left").join(side("src", "dst", "edges_out"), "node_id", "left").join(side("dst", "src", "edges_in"), "node_id", "left")


def hop(edges: DataFrame, ids: DataFrame, direction: str) -> DataFrame:
    """Distinct neighbours of ids; starts may be among them."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(a).alias("node_id"), F.col(b).alias("_to")).join(ids, "node_id", "left_semi").select(F.col("_to").alias("node_id")).distinct()


def closed(rows: DataFrame) -> DataFrame:
    """The one row of an aggregate, after which no step of a query may follow."""

    def refuse(*_, **__):
        raise QueryError("E_QUERY_AGGREGATE_TERMINAL", "nothing may follow an aggregate")

    rows.match = rows.outgoing = rows.incoming = refuse
    return rows


@dataclass(frozen=True)
class Query:
    """An immutable builder; every step returns a new one, and run() or a select gives a DataFrame.

    kinds is what the ids may begin with, as far as the graph tells kinds apart; only those are read.
    """

    graph: Graph
    ids: DataFrame | None = None
    kinds: frozenset[str] | None = None

    def _open(self) -> DataFrame:
        return self.graph.nodes_of(self.kinds).select("node_id") if self.ids is None else self.ids

    def match(self, pattern: str | list[str] = "*") -> Query:
        kinds = self.graph.kinds_of(pattern)
        if kinds is not None and self.kinds is not None:
            kinds &= self.kinds
        ids = self.graph.nodes_of(kinds).select("node_id") if self.ids is None else self.ids
        return replace(self, ids=ids.where(glob(pattern, F.col("node_id"))), kinds=kinds if kinds is not None else self.kinds)

    def where(self, condition: dict[str, object] | Column) -> Query:
        """A dictionary asks for equal values of the same type under keys that are there; a Column sees the snapshot."""
        ids = self._open()
        if isinstance(condition, Column):
            return replace(self, ids=snapshots(self.graph, ids, self.kinds).where(condition).select("node_id"))
        for key, value in condition.items():
            props = self.graph.props_of(self.kinds, [key])
            ids = ids.join(props.where((F.col("key") == key) & same_value(value)).select("node_id"), "node_id", "left_semi")
        return replace(self, ids=ids)

    def outgoing(self, label: str | None = None, depth: int | tuple[int, int] = 1) -> Query:
        return self._hops("out", label, depth)

    def incoming(self, label: str | None = None, depth: int | tuple[int, int] = 1) -> Query:
        return self._hops("in", label, depth)

    def _hops(self, direction: str, label: str | None, depth: int | tuple[int, int]) -> Query:
        ids, kinds = self._open(), self.kinds
        if depth == 1:
            edges, kinds = self.graph.edges_of(kinds, direction, label)
            return replace(self, ids=hop(edges, ids, direction), kinds=kinds)
        low, high = depth if isinstance(depth, tuple) else (depth, depth)
        if not 0 <= low <= high:
            raise QueryError("E_QUERY_DEPTH", "0 <= min <= max is asked for")
        found, known = ([ids], [kinds]) if low == 0 else ([], [])
        seen = front = ids
        for level in range(1, high + 1):  # levels exclude what is seen, all starts included
            edges, kinds = self.graph.edges_of(kinds, direction, label)
            front = hop(edges, front, direction).join(seen, "node_id", "left_anti")
            seen = seen.union(front)
            if level >= low:
                found.append(front)
                known.append(kinds)
        kinds = None if None in known else frozenset().union(*known)
        return replace(self, ids=reduce(DataFrame.union, found).distinct(), kinds=kinds)

    def select(self, fields: list[str] | None = None) -> DataFrame:
        """Rows (id, props) sorted by id; fields picks among them."""
        for f in fields or ():
            if f not in ("id", "props"):
                raise QueryError("E_QUERY_SELECT_FIELD", f)
        ids = self._open()
        if fields and "props" not in fields:
            return ids.select(F.col("node_id").alias("id")).orderBy("id")
        text = F.coalesce(F.col("value_num").cast("string"), F.col("value_str"))
        props = self.graph.props_of(self.kinds).join(ids, "node_id", "left_semi").groupBy("node_id")
        packed = props.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", text.alias("value"))))).alias("props"))
        rows = ids.join(packed, "node_id", "left").select(F.col("node_id").alias("id"), "props")
        return rows.select(*(fields or ["id", "props"])).orderBy("id" if not fields or "id" in fields else F.lit(1))

    def aggregate(self, count: bool = False, **paths: str) -> DataFrame:
        """One row of count, sum, avg, min and max, each over one numeric property; over nothing each is 0.

        A path may lead into an object, whose property holds JSON: props.address.floor; a number alone counts.
        """
        ids, steps = self._open(), {how: path.removeprefix("props.").split(".") for how, path in paths.items()}
        names = sorted({s[0] for s in steps.values()})
        if names:
            known = self.graph.props_of(self.kinds, names)
            one = lambda name, c: F.max(F.when(F.col("key") == name, c))
            number = F.when((F.col("value_type") == "number") & ~F.isnan("value_num"), F.col("value_num"))
            columns = [one(n, number).alias(f"n{i}") for i, n in enumerate(names)] + [one(n, F.col("value_str")).alias(f"s{i}") for i, n in enumerate(names)]
            ids = ids.join(known.groupBy("node_id").agg(*columns), "node_id", "left")
        out = [F.count("*").alias("count")] if count else []
        for how, path in steps.items():
            i = names.index(path[0])
            inside = F.get_json_object(f"s{i}", "$" + "".join(f"['{p}']" for p in path[1:]))
            picked = F.col(f"n{i}") if len(path) == 1 else F.when(F.trim(inside).rlike(r"^-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?$"), inside.try_cast("double"))
            out.append(F.coalesce(getattr(F, how)(picked), F.lit(0.0)).alias(how))
        return closed(ids.agg(*out))

    def run(self) -> DataFrame:
        return self._open().select(F.col("node_id").alias("id")).orderBy("id")


def same_value(value: object) -> Column:
    if value is None:
        return F.col("value_type") == "null"
    if isinstance(value, bool):
        return (F.col("value_type") == "boolean") & (F.col("value_str") == str(value).lower())
    if isinstance(value, (int, float)):
        return (F.col("value_type") == "number") & (F.col("value_num") == float(value))
    return (F.col("value_type") == "string") & (F.col("value_str") == value)
