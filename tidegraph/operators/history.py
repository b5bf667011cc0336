"""Operators over history: diffs, comparisons, transfers, temporal predicates, provenance and forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators import visible
from tidegraph.operators.fold import EDGE, VALUE, fold, materialize
from tidegraph.operators.traverse import GraphError
from tidegraph.sources.event_log import Log
from tidegraph.sources.shared import written
from tidegraph.sources.star_graph import Graph

KEYS = {"nodes": ["node_id"], "edges": EDGE, "node_props": ["node_id", "key"], "edge_props": [*EDGE, "key"]}


def sides(a: Graph, b: Graph, part: str) -> DataFrame:
    """Keys of one part with before and after values, whichever side has them."""
    keys = KEYS[part]
    value = visible.value_text() if "props" in part else F.lit("")
    left, right = (getattr(g, part).select(*keys, value.alias(n)) for g, n in ((a, "before"), (b, "after")))
    return left.join(right, keys, "full_outer")


def changes(a: Graph, b: Graph, part: str) -> DataFrame:
    """Keys that were added, removed or changed from a to b."""
    rows = sides(a, b, part).where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    out = rows.withColumn("change", kind)
    return out if "props" in part else out.drop("before", "after")


def state_diff(a: Graph, b: Graph) -> dict[str, DataFrame]:
    """The diff of two states; edge properties are no part of it."""
    return {part: changes(a, b, part) for part in ("nodes", "edges", "node_props")}


def compare_summary(a: Graph, b: Graph) -> DataFrame:
    """(part, change, n) over all four parts."""
    rows = None
    for part in KEYS:
        one = changes(a, b, part).groupBy("change").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "change", "n")
        rows = one if rows is None else rows.union(one)
    return rows


def tick_diff(log: Log, start: int, end: int | None) -> DataFrame:
    """The summary of what changed between two ceilings, the second of them the whole log if it is None; from one fold."""
    if end is not None and start > end:
        raise ValueError("a diff runs forward")
    cells = materialize(log, (start, end))
    return compare_summary(visible.settled(cells, 0), visible.settled(cells, 1))


def patch_divergence(a: Log, b: Log, entity: str | None = None) -> DataFrame:
    """(sha, side) with side shared, left or right; with an entity only the patches that touch it."""
    pick = lambda g: g.patches.select("sha") if entity is None else g.footprint.where(F.col("entity") == entity).select("sha").distinct()
    joined = pick(a).withColumn("l", F.lit(1)).join(pick(b).withColumn("r", F.lit(1)), "sha", "full_outer")
    return joined.select("sha", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("shared").alias("side"))


#: Phases of a transfer, in the order in which its operations apply.
PHASES = ("addNode", "setNodeProp", "clearNodeProp", "addEdge", "setEdgeProp", "clearEdgeProp", "removeEdge", "removeNode")


def transfer_plan(target: Graph, source: Graph) -> DataFrame:
    """(phase, op, name, value): operations that turn target into source, in order; a missing property is set to null."""

    def rows(part: str, names: dict[str, str]) -> DataFrame:
        out = changes(target, source, part)
        op = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("change")]
        value = F.col("after") if "props" in part else F.lit(None).cast("string")
        return out.select(op.alias("op"), F.concat_ws("|", *KEYS[part]).alias("name"), value.alias("value"))

    every = (
        rows("nodes", {"added": "addNode", "removed": "removeNode"})
        .union(rows("edges", {"added": "addEdge", "removed": "removeEdge"}))
        .union(rows("node_props", {"added": "setNodeProp", "changed": "setNodeProp", "removed": "clearNodeProp"}))
        .union(rows("edge_props", {"added": "setEdgeProp", "changed": "setEdgeProp", "removed": "clearEdgeProp"}))
    )
    phase = F.array_position(F.array(*map(F.lit, PHASES)), F.col("op")).cast("int")
    return every.select(phase.alias("phase"), "op", "name", "value").orderBy("phase", "name")


def equivalent(a: Graph, b: Graph) -> DataFrame:
    """One row: whether two readings hold identical facts, how many they don't share, and the first of those."""
    left, right = visible.projection(a), visible.projection(b)
    odd = left.exceptAll(right).union(right.exceptAll(left))
    return odd.agg(
        (F.count("*") == 0).alias("equivalent"), F.count("*").alias("n_different"), F.min(F.concat_ws("|", "kind", "name")).alias("first_different")
    )


# -- temporal predicates ---------------------------------------------------------------------------------------------


def timeline(log: Log, node: str, key: str) -> DataFrame:
    """(lamport, writer, sha, alive, value_type, value_num, value_str): one node after each patch, in causal order.

    Only the node's own operations are gathered: a dot lives from its addition until the first removal that observed
    it, so the count of live dots is a running sum of entries and exits; its property is a running maximum.
    """
    adds = log.ops.where((F.col("op_type") == "NodeAdd") & (F.col("node") == node)).select("sha", "dot_writer", "dot_counter")
    removes = log.ops.where(F.col("op_type") == "NodeRemove").select("sha", "op_index").join(log.observed, ["sha", "op_index"])
    when = log.patches.select("sha", F.struct("lamport", "writer", "sha").alias("at"))
    dots = ["dot_writer", "dot_counter"]
    born = adds.join(when, "sha").groupBy(*dots).agg(F.min("at").alias("born"))
    dead = removes.join(born.select(*dots), dots, "left_semi").join(when, "sha").groupBy(*dots).agg(F.min("at").alias("died"))
    lives = born.join(dead, dots, "left").where("died is null or died > born")
    moves = lives.select(F.col("born").alias("at"), F.lit(1).alias("d")).union(lives.where("died is not null").select("died", F.lit(-1)))
    sums = moves.groupBy("at").agg(F.sum("d").alias("d"))
    sets = log.ops.where((F.col("op_type") == "NodePropSet") & (F.col("node") == node) & (F.col("key") == key))
    sets = sets.groupBy("lamport", "writer", "sha").agg(F.max_by(F.struct(*VALUE), "op_index").alias("v"))
    sets = sets.select(F.struct("lamport", "writer", "sha").alias("at"), "v")
    known = sums.join(sets, "at", "full_outer")
    order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = known.select("at", (F.coalesce(F.sum("d").over(order), F.lit(0)) > 0).alias("alive"), F.last("v", True).over(order).alias("v"))
    return running.select("at.*", "alive", "v.*")


def temporal(log: Log, node: str, key: str, predicate: Column, since: int = 0) -> DataFrame:
    """One row (always, eventually) of a predicate on the value columns, over all patches from a lamport time on.

    Patches that don't touch the node leave it as it is, so it is judged at those that do, and as it stands at the
    first patch of the span.
    """
    line = timeline(log, node, key)
    first = log.patches.where(F.col("lamport") >= since).agg(F.min(F.struct("lamport", "writer", "sha")).alias("f"))
    rows = line.join(F.broadcast(first), F.lit(True))
    at = F.struct("lamport", "writer", "sha")
    before = rows.where(at <= F.col("f")).agg(F.max_by(F.struct("alive", *VALUE), at).alias("s")).where("s is not null").select("s.*")
    points = before.union(rows.where(at > F.col("f")).select("alive", *VALUE)).where("alive")
    held = F.coalesce(predicate, F.lit(False))
    return points.agg(
        F.coalesce(F.bool_and(held), F.lit(False)).alias("always"), F.coalesce(F.bool_or(held), F.lit(False)).alias("eventually")
    )


def bisect(log: Log, writer: str, good: str, bad: str, test) -> tuple[str, int]:
    """(first bad sha, steps): test(state) is true while good; each step folds the history up to a candidate's lamport."""
    chain = log.patches.where(F.col("writer") == writer)
    ends = {r["sha"]: r["seq"] for r in chain.where(F.col("sha").isin(good, bad)).collect()}
    if good not in ends or bad not in ends or ends[good] >= ends[bad]:
        raise GraphError("E_BISECT_RANGE", "good must come before bad in the writer's chain")
    low, high, steps = ends[good], ends[bad], 0
    at = lambda seq: chain.where(F.col("seq") == seq).first()
    while high - low > 1:
        middle = (low + high) // 2
        steps += 1
        if test(fold(log.where(F.col("lamport") <= at(middle)["lamport"]))):
            low = middle
        else:
            high = middle
    return at(high)["sha"], steps


# -- provenance and forks --------------------------------------------------------------------------------------------


def patches_for(log: Log) -> DataFrame:
    """(entity, n, shas): the sorted patches that read or wrote each entity."""
    pairs = log.footprint.select("entity", "sha").distinct()
    return pairs.groupBy("entity").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("sha")), ",").alias("shas"))


def cone(log: Log, entity: str) -> DataFrame:
    """(sha): the patches that an entity came from, by way of what they read."""
    marks = log.footprint
    seen = front = written(marks.where(F.col("entity") == entity).select("sha").distinct())
    while not front.isEmpty():
        asked = marks.where("kind = 'read'").join(front, "sha", "left_semi").select("entity").distinct()
        front = written(marks.join(asked, "entity", "left_semi").select("sha").distinct().join(seen, "sha", "left_anti"))
        seen = written(seen.union(front))
    return seen


def materialize_slice(log: Log, entity: str):
    """The state that an entity's backward cone alone makes."""
    return fold(log.only(cone(log, entity)))


def fork_chain(log: Log, writer: str, at: str) -> DataFrame:
    """The one writer's patches up to a sha of its chain; no other writer's."""
    tip = log.patches.where((F.col("writer") == writer) & (F.col("sha") == at)).first()
    if tip is None:
        raise GraphError("E_FORK_PATCH_NOT_IN_CHAIN", at)
    return log.patches.where((F.col("writer") == writer) & (F.col("seq") <= tip["seq"]))


def relation(log: Log, a: str, b: str) -> str:
    """same, ahead, behind or diverged: where patch a stands to patch b."""
    rows = {r["sha"]: r for r in log.patches.where(F.col("sha").isin(a, b)).collect()}
    if a == b:
        return "same"
    if rows[a]["writer"] != rows[b]["writer"]:
        return "diverged"
    return "ahead" if rows[a]["seq"] > rows[b]["seq"] else "behind"


def wormhole(log: Log, writer: str, first: int, last: int) -> DataFrame:
    """One row for a writer's patches from seq first to last: (writer, first, last, n, payload of operations in order)."""
    span = log.patches.where((F.col("writer") == writer) & F.col("seq").between(first, last)).select("sha")
    ops = log.ops.join(span, "sha", "left_semi").groupBy("writer", "sha", "seq").agg(F.sort_array(F.collect_list(F.struct("op_index", *[c for c in log.ops.columns if c not in ("op_index", "writer", "sha", "seq")]))).alias("ops"))
    packed = ops.groupBy("writer").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq", "sha", "ops"))).alias("payload"))
    return packed


def unfold(holes: DataFrame) -> DataFrame:
    """The operations that wormholes hold."""
    rows = holes.select("writer", F.inline("payload"))
    return rows.select("writer", "seq", "sha", F.inline("ops"))


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two wormholes of one writer, the second following the first, as one; others raise an error."""
    ok = F.col("next.first") == F.col("last") + 1
    nxt = b.select(F.col("writer"), F.struct("first", "last", "n", "payload").alias("next"))
    joined = a.join(nxt, "writer", "left").withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("E_WORMHOLE_NOT_CONSECUTIVE"))))
    return joined.where("_ok").select("writer", "first", F.col("next.last").alias("last"), (F.col("n") + F.col("next.n")).alias("n"), F.concat("payload", "next.payload").alias("payload"))


