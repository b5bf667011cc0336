"""The fold of an operation log to state, as order-free aggregates.

Elements follow add-wins sets: an element lives if one of its addition's dots is in no removal. Properties are
last-writer-wins registers by event id. Frontiers are pointwise maxima. Each is one shuffle on its own key, with
partial aggregation, so the order in which patches arrive never matters and any two states join.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.event_log import Log, event_id, lowered
from tidegraph.sources.shared import written

DOT = ["dot_writer", "dot_counter"]
EDGE = ["src", "dst", "label"]
VALUE = ["value_type", "value_num", "value_str"]


@dataclass(frozen=True)
class State:
    """Additions and tombstones by dot, registers with their event ids, and the observed frontier."""

    node_adds: DataFrame  # node, dot
    node_tombs: DataFrame  # dot
    edge_adds: DataFrame  # src, dst, label, dot
    edge_tombs: DataFrame  # dot
    births: DataFrame  # src, dst, label, birth
    node_props: DataFrame  # node, key, value, at
    edge_props: DataFrame  # src, dst, label, key, value, at
    frontier: DataFrame  # writer, counter

    def write(self, path: str) -> None:
        """A checkpoint: one Parquet table per part."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> State:
        return State(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(State)))


def winner(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The register of each key: the value with the greatest event id, null values included."""
    best = F.max_by(F.struct(*VALUE, "at"), "at").alias("_w")
    return rows.groupBy(*keys).agg(best).select(*keys, "_w.*")


def fold(log: Log) -> State:
    """The state that a log's patches make, in any order."""
    ops = lowered(log.ops)
    of = lambda *kinds: ops.where(F.col("op_type").isin(*kinds))
    removed = lambda kind: of(kind).select("sha", "op_index").join(log.observed, ["sha", "op_index"]).select(*DOT).distinct()
    edges = of("EdgeAdd")
    node_sets = of("NodePropSet").select("node", "key", *VALUE, event_id().alias("at"))
    edge_sets = of("EdgePropSet").select(*EDGE, "key", *VALUE, event_id().alias("at"))
    own = log.patches.select("writer", F.col("lamport").alias("counter"))
    seen = log.context.select(F.col("ctx_writer").alias("writer"), F.col("ctx_counter").alias("counter"))
    return State(
        of("NodeAdd").select("node", *DOT).distinct(),
        removed("NodeRemove"),
        edges.select(*EDGE, *DOT).distinct(),
        removed("EdgeRemove"),
        edges.groupBy(*EDGE).agg(F.max(event_id()).alias("birth")),
        winner(node_sets, ["node", "key"]),
        winner(edge_sets, [*EDGE, "key"]),
        own.union(seen).where("counter > 0").groupBy("writer").agg(F.max("counter").alias("counter")),
    )


# -- the same fold as one table --------------------------------------------------------------------------------------

CELL = "kind string, a string, b string, c string, key string, dot_writer string, dot_counter bigint"
_AT = "at struct<lamport:bigint,writer:string,sha:string,op_index:int>"
VALUE_TYPE = f"struct<{_AT.replace(' ', ':', 1)},value_type:string,value_num:double,value_str:string>"
_NAMES = [c.split()[0] for c in CELL.split(", ")]


def entries(log: Log) -> DataFrame:
    """Every operation, observed dot and clock of a log as cells of one table, each with its patch's lamport time."""
    none = F.lit(None)
    value = F.struct(event_id().alias("at"), *VALUE)

    def cell(kind: str, a=none, b=none, c=none, key=none, dot: bool = False, value=none) -> Column:
        parts = (F.lit(kind) if isinstance(kind, str) else kind, a, b, c, key, F.col("dot_writer") if dot else none, F.col("dot_counter") if dot else none)
        cast = [p.cast(t.split()[1]).alias(t.split()[0]) for p, t in zip(parts, CELL.split(", "), strict=True)]
        return F.struct(*cast, value.cast(VALUE_TYPE).alias("value"))

    node, edge, key, kind = F.col("node"), [F.col(c) for c in EDGE], F.col("key"), F.col("op_type")
    made = (
        F.when(kind == "NodeAdd", F.array(cell("node_add", node, dot=True)))
        .when(kind == "EdgeAdd", F.array(cell("edge_add", *edge, dot=True), cell("birth", *edge, value=value)))
        .when(kind == "NodePropSet", F.array(cell("node_prop", node, key=key, value=value)))
        .when(kind == "EdgePropSet", F.array(cell("edge_prop", *edge, key, value=value)))
    )
    clock = lambda w, n: F.array(cell("clock", F.col(w), value=F.struct(F.struct(F.col(n), none.cast("string"), none.cast("string"), none.cast("int")), *(none.cast(t) for t in ("string", "double", "string")))))
    tomb = F.array(cell(F.when(kind == "NodeRemove", "node_tomb").otherwise("edge_tomb"), dot=True))
    rows = lambda df, cells: df.select("lamport", F.inline(cells))
    return (
        rows(lowered(log.ops), made)
        .union(rows(log.dated("observed").where(kind.isin("NodeRemove", "EdgeRemove")), tomb))
        .union(rows(log.patches, clock("writer", "lamport")))
        .union(rows(log.dated("context"), clock("ctx_writer", "ctx_counter")))
    )


def folded(rows: DataFrame, ceilings: tuple[Column | int | None, ...] = (None,)) -> DataFrame:
    """Cells, one row each, as they stand at each ceiling: held_i and value_i. One shuffle, whatever the number of ceilings."""
    best = lambda c: F.max("value") if c is None else F.max(F.when(F.col("lamport") <= c, F.col("value")))
    held = lambda c: F.lit(True) if c is None else F.bool_or(F.col("lamport") <= c)
    out = [x for i, c in enumerate(ceilings) for x in (held(c).alias(f"held_{i}"), best(c).alias(f"value_{i}"))]
    return rows.groupBy(*_NAMES).agg(*out)


def state_of(cells: DataFrame, i: int = 0) -> State:
    """The state that cells hold at their i-th ceiling."""
    here = cells.where(f"held_{i}")
    of = lambda kind, names, *more: here.where(F.col("kind") == kind).select(*(F.col(c).alias(n) for c, n in zip("abc", names, strict=False)), *more)
    value = [F.col(f"value_{i}.{c}").alias(c) for c in (*VALUE, "at")]
    return State(
        of("node_add", ["node"], *DOT),
        of("node_tomb", [], *DOT),
        of("edge_add", EDGE, *DOT),
        of("edge_tomb", [], *DOT),
        of("birth", EDGE, F.col(f"value_{i}.at").alias("birth")),
        of("node_prop", ["node"], "key", *value),
        of("edge_prop", EDGE, "key", *value),
        of("clock", ["writer"], F.col(f"value_{i}.at.lamport").alias("counter")).where("counter > 0"),
    )


def joined(*cells: DataFrame) -> DataFrame:
    """The cells of the least state that holds all; by the same aggregate as the fold."""
    rows = reduce(DataFrame.unionByName, (c.select(*_NAMES, F.lit(0).cast("long").alias("lamport"), F.col("value_0").alias("value")) for c in cells))
    return folded(rows)


def materialize(log: Log, ceilings: tuple[Column | int | None, ...] = (None,)) -> DataFrame:
    """Cells written to the shared folder by kind: the snapshot that later reads and joins start from."""
    return written(folded(entries(log), ceilings), "cells", by="kind")


def join_states(a: State, b: State) -> State:
    """The least state that holds both: commutative, associative and idempotent."""
    both = lambda name: getattr(a, name).unionByName(getattr(b, name))
    return State(
        both("node_adds").distinct(),
        both("node_tombs").distinct(),
        both("edge_adds").distinct(),
        both("edge_tombs").distinct(),
        both("births").groupBy(*EDGE).agg(F.max("birth").alias("birth")),
        winner(both("node_props"), ["node", "key"]),
        winner(both("edge_props"), [*EDGE, "key"]),
        both("frontier").groupBy("writer").agg(F.max("counter").alias("counter")),
    )


def alive(adds: DataFrame, tombs: DataFrame, element: list[str]) -> DataFrame:
    """Elements with a dot that no removal has observed."""
    return adds.join(tombs, DOT, "left_anti").select(*element).distinct()


def live_dots(adds: DataFrame, tombs: DataFrame) -> DataFrame:
    return adds.join(tombs, DOT, "left_anti")


def incremental(snapshot: State, suffix: Log) -> State:
    """A snapshot brought forward by the patches that came after it."""
    return join_states(snapshot, fold(suffix))


def at_ceiling(log: Log, ceiling: int) -> Log:
    return log.where(F.col("lamport") <= ceiling)


def at_frontier(log: Log, tips: DataFrame, ceiling: int | None = None) -> Log:
    """Each writer's chain up to a tip of (writer, tip_sha); writers without one have no part in it."""
    ends = log.patches.join(tips.select("writer", F.col("tip_sha").alias("sha")), ["writer", "sha"]).select("writer", F.col("seq").alias("_tip"))
    chosen = log.patches.join(ends, "writer").where("seq <= _tip")
    if ceiling is not None:
        chosen = chosen.where(F.col("lamport") <= ceiling)
    return log.only(chosen.select("sha"))


def descends(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether vector a (writer, counter) holds everything that b does."""
    joined = b.withColumnRenamed("counter", "_b").join(a, "writer", "left")
    return joined.agg(F.coalesce(F.bool_and(F.coalesce("counter", F.lit(0)) >= F.col("_b")), F.lit(True)).alias("descends"))


def contains(vector: DataFrame, dots: DataFrame) -> DataFrame:
    """dots (dot_writer, dot_counter) with `contained`: whether the vector (writer, counter) covers them."""
    known = vector.select(F.col("writer").alias("dot_writer"), "counter")
    return dots.select(*DOT).join(known, "dot_writer", "left").select(*DOT, (F.col("dot_counter") <= F.coalesce("counter", F.lit(0))).alias("contained"))


def increment(vector: DataFrame, writer: str) -> DataFrame:
    """The vector with a writer's counter one higher; a writer that it doesn't hold begins at 1."""
    own = vector.sparkSession.range(1).select(F.lit(writer).alias("writer"), F.lit(0).cast("long").alias("counter"))
    top = vector.select("writer", "counter").union(own).groupBy("writer").agg(F.max("counter").alias("counter"))
    return top.withColumn("counter", F.col("counter") + (F.col("writer") == writer).cast("int"))


def applied(state: State) -> DataFrame:
    """(writer, counter): the largest dot of each writer that a state holds, the vector that compaction goes by."""
    dots = state.node_adds.select(*DOT).union(state.edge_adds.select(*DOT)).union(state.node_tombs).union(state.edge_tombs)
    return dots.groupBy(F.col("dot_writer").alias("writer")).agg(F.max("dot_counter").alias("counter"))


def compact(state: State, applied: DataFrame) -> State:
    """Drop the dots that are both removed and covered by the applied vector (writer, counter), and their tombstones."""
    limit = applied.select(F.col("writer").alias("dot_writer"), F.col("counter").alias("_limit"))

    def cut(adds: DataFrame, tombs: DataFrame) -> tuple[DataFrame, DataFrame]:
        dead = tombs.join(limit, "dot_writer").where("dot_counter <= _limit").select(*DOT)
        gone = adds.select(*DOT).join(dead, DOT, "left_semi").distinct()
        return adds.join(gone, DOT, "left_anti"), tombs.join(gone, DOT, "left_anti")

    nodes, edges = cut(state.node_adds, state.node_tombs), cut(state.edge_adds, state.edge_tombs)
    return State(*nodes, *edges, state.births, state.node_props, state.edge_props, state.frontier)


def metrics(state: State) -> DataFrame:
    """One row: entries, live dots, tombstones that hit an entry, and their share."""

    def counts(adds: DataFrame, tombs: DataFrame) -> DataFrame:
        marked = adds.join(tombs.withColumn("_dead", F.lit(1)), DOT, "left")
        return marked.agg(F.count("*").alias("entries"), F.count_if(F.col("_dead").isNull()).alias("live"), F.count("_dead").alias("tombstones"))

    both = counts(state.node_adds, state.node_tombs).union(counts(state.edge_adds, state.edge_tombs))
    total = both.agg(*(F.sum(c).alias(c) for c in ("entries", "live", "tombstones")))
    return total.withColumn("ratio", F.when(F.col("entries") > 0, F.col("tombstones") / F.col("entries")).otherwise(F.lit(0.0)))


#: Thresholds of the collection policy: each triggers when exceeded.
POLICY = {"ratio": 0.3, "entries": 50_000, "patches": 1_000, "ticks": 10_000}


def policy(measured: DataFrame, policy_: dict[str, float] = POLICY) -> DataFrame:
    """One row (ratio, entries, patches, ticks) with a column per trigger and whether any holds."""
    rows = measured.withColumns({f"over_{k}": F.col(k) > v for k, v in policy_.items()})
    return rows.withColumn("should_run", F.greatest(*(F.col(f"over_{k}").cast("int") for k in policy_)) > 0)
