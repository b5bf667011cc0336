"""Traversals: one frontier join per level, for any number of origins at once.

A level is one join of the frontier with the edges, less what its origin has seen. Frontiers are written to the shared
folder after each level, which cuts the lineage and gives the count that ends the loop; nothing else reaches the
driver. The closure and the reduction, whose pairs are many more than the edges, walk the graph's files in the shared
folder instead, some origins at a time in each task, and neither shuffle nor write a pair. Algorithms whose result is an order (depth first, Kahn's with a heap, A*) run over the reachable subgraph in one
task and honour the caller's bound on its size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.sources import compact
from tidegraph.sources.shared import written

#: Edges that an ordered algorithm may gather in one task; more is an error, never a cut.
MOST_LOCAL_EDGES = 1_000_000


class GraphError(ValueError):
    """Carries the code of a traversal that can't be answered."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}")
        self.code = code


def stepped(edges: DataFrame, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
    """(a, b) steps in a direction, one for each label; an empty list of labels leaves none."""
    used = edges if labels is None else edges.where(F.col("label").isin(*labels) if labels else F.lit(False))
    out, back = used.select(F.col("src").alias("a"), F.col("dst").alias("b")), used.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def directed(edges: DataFrame, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
    return stepped(edges, direction, labels).distinct()


def reach(steps: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, node_id, depth, parent) from (origin, node_id) starts: least depth, and the smallest parent at it."""
    front = written(starts.select("origin", "node_id").distinct().withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("string")}))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = front.select("origin", F.col("node_id").alias("a")).join(steps, "a").groupBy("origin", F.col("b").alias("node_id"))
        fresh = found.agg(F.min("a").alias("parent")).join(seen.select("origin", "node_id"), ["origin", "node_id"], "left_anti")
        front = written(fresh.select("origin", "node_id", F.lit(depth).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = written(seen.union(front)) if depth % 8 == 0 else seen.union(front)
    return seen


def origins(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.where(F.col("node_id").isin(*ids)).select(F.col("node_id").alias("origin"), "node_id")


def bfs(edges: DataFrame, nodes: DataFrame, start: str, direction: str = "out", labels: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(node_id, depth), level by level, each sorted by id."""
    found = reach(directed(edges, direction, labels), origins(nodes, [start]), max_depth)
    return found.select("node_id", "depth").orderBy("depth", "node_id")


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
    """One row (found, length, path): the path whose every predecessor is the smallest; -1 and empty if there is none."""
    tree = written(reach(directed(edges, direction, labels), origins(nodes, [start])))
    row = tree.where(F.col("node_id") == goal).select("depth", "parent").first()
    path: list[str] = []
    if row:
        path, at = [goal], row
        while at["parent"] is not None:
            path.append(at["parent"])
            at = tree.where((F.col("node_id") == path[-1])).select("depth", "parent").first()
    return edges.sparkSession.createDataFrame([(bool(row), len(path) - 1 if row else -1, "/".join(path[::-1]))], "found boolean, length int, path string")


def is_reachable(edges: DataFrame, start: str, goal: str, direction: str = "out", labels: list[str] | None = None) -> DataFrame:
    """One row; a node reaches itself whether or not it exists."""
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([(True,)], "reachable boolean")
    starts = spark.createDataFrame([(start, start)], "origin string, node_id string")
    found = reach(directed(edges, direction, labels), starts)
    return found.agg(F.coalesce(F.bool_or(F.col("node_id") == goal), F.lit(False)).alias("reachable"))


def component(edges: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    return bfs(edges, nodes, start, "both").select("node_id").orderBy("node_id")


def closure(edges: DataFrame, nodes: DataFrame, direction: str = "out", labels: list[str] | None = None, max_edges: int | None = None) -> DataFrame:
    """(src, dst): every pair with a path between them, but no node with itself; more than max_edges raise E_MAX_EDGES_EXCEEDED."""
    pairs = compact.pairs(compact.compacted(stepped(edges, direction, labels), nodes.select("node_id")))
    if max_edges is not None:
        pairs = written(pairs)
        if pairs.limit(max_edges + 1).count() > max_edges:
            raise GraphError("E_MAX_EDGES_EXCEEDED", str(max_edges))
    return pairs


def common_ancestors(edges: DataFrame, nodes: DataFrame, ids: list[str], max_results: int = 100) -> DataFrame:
    """Nodes from which every one of ids is reached, ids included; sorted, at most max_results."""
    found = reach(directed(edges, "in"), origins(nodes, ids))
    counted = found.groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(ids)))
    return counted.select("node_id").orderBy("node_id").limit(max_results)


def root_ancestors(edges: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    found = reach(directed(edges, "in"), origins(nodes, [start]))
    return found.select("node_id").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti").orderBy("node_id")


def relax(steps: DataFrame, starts: DataFrame, best: str, rounds: int | None = None) -> DataFrame:
    """(node_id, cost, parent) by rounds of relaxation of weighted steps (a, b, w); best is min or max.

    Equal costs keep the smaller parent. With max a cycle never settles, and more rounds than nodes raise an error.
    """
    pick, better = (F.min, "<") if best == "min" else (F.max, ">")
    known = written(starts.select("node_id", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("parent")))
    front, limit, done = known, None, 0
    while True:
        offers = front.select(F.col("node_id").alias("a"), "cost").join(steps, "a").select(F.col("b").alias("node_id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("parent"))
        order = F.struct(F.col("cost") if best == "min" else -F.col("cost"), "parent")
        offers = offers.groupBy("node_id").agg(F.min_by(F.struct("cost", "parent"), order).alias("o")).select("node_id", F.col("o.cost").alias("new"), F.col("o.parent").alias("by"))
        merged = known.join(offers, "node_id", "full_outer")
        won = F.col("cost").isNull() | F.expr(f"new {better} cost") | (F.expr("new = cost") & (F.col("by") < F.col("parent")))
        won = F.col("new").isNotNull() & F.coalesce(won, F.lit(False))
        moved = F.col("cost").isNull() | ~F.col("cost").eqNullSafe(F.col("new"))
        state = written(merged.select("node_id", F.when(won, F.col("new")).otherwise(F.col("cost")).alias("cost"), F.when(won, F.col("by")).otherwise(F.col("parent")).alias("parent"), (won & moved).alias("moved")))
        known, front = state.drop("moved"), state.where("moved").drop("moved")
        done += 1
        if front.isEmpty() or done == rounds:
            return known
        if best == "max":
            limit = limit or known.count() + steps.select("a").union(steps.select("b")).distinct().count()
            if done > limit:
                raise GraphError("ERR_GRAPH_HAS_CYCLES", "the longest path never ends")


def weighted(edges: DataFrame, weights: DataFrame | None = None, node_weights: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """(a, b, w) steps: weights (src, dst, label, w) per edge, or node_weights (node_id, w) as the cost of entering; 1 else."""
    if weights is not None and node_weights is not None:
        raise GraphError("E_WEIGHT_FN_CONFLICT", "weigh edges or nodes, not both")
    used = edges.join(weights, ["src", "dst", "label"], "left") if weights is not None else edges.withColumn("w", F.lit(None).cast("double"))
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    steps = used.select(F.col(a).alias("a"), F.col(b).alias("b"), "w")
    if node_weights is not None:
        steps = steps.drop("w").join(node_weights.select(F.col("node_id").alias("b"), "w"), "b", "left")
    return steps.groupBy("a", "b").agg(F.min(F.coalesce("w", F.lit(1.0))).alias("w"))


def path_to(known: DataFrame, start: str, goal: str) -> tuple[float, list[str]]:
    """(cost, path) from the result of relax; raises NO_PATH."""
    row = known.where(F.col("node_id") == goal).first()
    if row is None:
        raise GraphError("NO_PATH", f"{start} to {goal}")
    path, at = [goal], row
    while at["parent"] is not None and path[-1] != start:
        path.append(at["parent"])
        at = known.where(F.col("node_id") == path[-1]).first()
    return row["cost"], path[::-1]


def weighted_shortest_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, **weights) -> DataFrame:
    known = written(relax(weighted(edges, **weights), nodes.where(F.col("node_id") == start), "min"))
    cost, path = path_to(known, start, goal)
    return edges.sparkSession.createDataFrame([(cost, "/".join(path))], "cost double, path string")


def weighted_longest_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, **weights) -> DataFrame:
    known = written(relax(weighted(edges, **weights), nodes.where(F.col("node_id") == start), "max"))
    cost, path = path_to(known, start, goal)
    return edges.sparkSession.createDataFrame([(cost, "/".join(path))], "cost double, path string")


def levels(edges: DataFrame, nodes: DataFrame, starts: list[str]) -> DataFrame:
    """(node_id, level): the longest path from any start."""
    found = relax(weighted(edges), nodes.where(F.col("node_id").isin(*starts)), "max")
    return found.select("node_id", F.col("cost").cast("int").alias("level")).orderBy("level", "node_id")


def reduction(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those that a longer path replaces; all labels of a pair go together; a cycle raises ERR_GRAPH_HAS_CYCLES."""
    graph = compact.compacted(stepped(edges), edges.select(F.col("src").alias("node_id")))
    replaced = written(compact.pairs(graph, replaced=True))
    if not replaced.where("src = dst").isEmpty():
        raise GraphError("ERR_GRAPH_HAS_CYCLES", "only a graph without cycles has one reduction")
    return edges.join(replaced, ["src", "dst"], "left_anti").select("src", "dst", "label").orderBy("src", "dst", "label")


def bounded(edges: DataFrame, nodes: DataFrame, start: str, max_depth: int, max_nodes: int, max_edges: int, goal: str | None = None) -> DataFrame:
    """(depth, src, dst, label) of the edges that a bounded breadth-first search meets, in its order."""
    tree = bfs(edges, nodes, start, max_depth=max_depth).limit(max_nodes)
    met = edges.join(tree.select(F.col("node_id").alias("src"), "depth").where(F.col("depth") < max_depth), "src")
    rows = met.select((F.col("depth") + 1).alias("depth"), "src", "dst", "label")
    return rows.orderBy("depth", "src", "dst", "label").limit(max_edges)


# -- ordered algorithms over a bounded subgraph ----------------------------------------------------------------------


def reached(edges: DataFrame, starts: list[str], direction: str = "out") -> DataFrame:
    """The edges that a search from starts can take."""
    rows = edges.sparkSession.createDataFrame([("all", n) for n in starts], "origin string, node_id string")
    end = "src" if direction == "out" else "dst"
    found = reach(directed(edges, direction), rows).select(F.col("node_id").alias(end))
    return edges.join(found, end, "left_semi").select(*edges.columns)


def local(edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = MOST_LOCAL_EDGES) -> DataFrame:
    """Run an ordered kernel over a subgraph's edges in one task; more than `most` edges raise E_MAX_EDGES_EXCEEDED.

    A row of nulls goes with them, so that the kernel runs where a start has no edges.
    """
    edges = written(edges.select("src", "dst"))
    if edges.limit(most + 1).count() > most:
        raise GraphError("E_MAX_EDGES_EXCEEDED", str(most))
    none = edges.sparkSession.range(1).select(F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"))
    return edges.union(none).withColumn("_all", F.lit("all")).groupBy("_all").applyInPandas(lambda pdf: kernel(pdf.dropna(subset=["src", "dst"])), schema)


def adjacency(pdf: pd.DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(zip(pdf["src"], pdf["dst"], strict=True))):
        out.setdefault(a, []).append(b)
    return out


def dfs(edges: DataFrame, start: str) -> DataFrame:
    """(position, node_id): preorder, smallest neighbour first, each node when it is first taken."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        near, seen, order, stack = adjacency(pdf), set(), [], [start]
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                order.append(node)
                stack += reversed([x for x in near.get(node, []) if x not in seen])
        return pd.DataFrame({"position": range(len(order)), "node_id": order})

    return local(reached(edges, [start]), kernel, "position long, node_id string")


def topological_sort(edges: DataFrame, starts: list[str], throw_on_cycle: bool = False) -> DataFrame:
    """(position, node_id, has_cycle): Kahn's order over what starts reach, the smallest ready node first.

    Nodes that a cycle holds back have no position.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        near, seen, todo = adjacency(pdf), set(starts), list(starts)
        while todo:
            for x in near.get(todo.pop(), []):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        degree = dict.fromkeys(seen, 0)
        for a in seen:
            for b in near.get(a, []):
                degree[b] += 1
        ready, order = [n for n in seen if not degree[n]], []
        heapq.heapify(ready)
        while ready:
            node = heapq.heappop(ready)
            order.append(node)
            for b in near.get(node, []):
                degree[b] -= 1
                if not degree[b]:
                    heapq.heappush(ready, b)
        cycle = len(order) < len(seen)
        if cycle and throw_on_cycle:
            raise GraphError("ERR_GRAPH_HAS_CYCLES", ", ".join(sorted(n for n in seen if degree[n])))
        left = sorted(n for n in seen if degree[n])
        place = pd.array([*range(len(order)), *[None] * len(left)], "Int64")
        return pd.DataFrame({"position": place, "node_id": order + left, "has_cycle": [cycle] * len(seen)})

    return local(reached(edges, starts), kernel, "position long, node_id string, has_cycle boolean")


def a_star(edges: DataFrame, start: str, goal: str, weights: dict[tuple[str, str], float] | None = None, heuristic: Callable[[str], float] = lambda n: 0.0) -> DataFrame:
    """One row (cost, path, explored); equal priorities take the smaller id; without a path the job fails with NO_PATH."""
    cost_of = weights or {}

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        near, best, parent, closed = adjacency(pdf), {start: 0.0}, {}, set()
        heap, explored = [(heuristic(start), start)], 0
        while heap:
            _, node = heapq.heappop(heap)
            if node in closed:
                continue
            closed.add(node)
            explored += 1
            if node == goal:
                path = [node]
                while path[-1] in parent:
                    path.append(parent[path[-1]])
                return pd.DataFrame({"cost": [best[goal]], "path": ["/".join(path[::-1])], "explored": [explored]})
            for b in near.get(node, []):
                new = best[node] + cost_of.get((node, b), 1.0)
                if b not in best or new < best[b] or (new == best[b] and node < parent.get(b, node)):
                    best[b], parent[b] = new, node
                    heapq.heappush(heap, (new + heuristic(b), b))
        raise GraphError("NO_PATH", f"{start} to {goal}")

    return local(reached(edges, [start]), kernel, "cost double, path string, explored long")


def bidirectional_a_star(edges: DataFrame, start: str, goal: str, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """One row (cost, path): two searches meet; a tie between meeting points takes the smaller id; else as a_star."""
    cost_of = weights or {}

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for flip, root in ((False, start), (True, goal)):
            pairs = pdf.rename(columns={"src": "dst", "dst": "src"}) if flip else pdf
            sides.append((adjacency(pairs), {root: 0.0}, {}, [(0.0, root)], set(), flip))
        met, least = None, float("inf")
        while sides[0][3] and sides[1][3] and min(s[3][0][0] for s in sides) < least:
            near, best, parent, heap, closed, flip = min(sides, key=lambda s: s[3][0][0])
            cost, node = heapq.heappop(heap)
            if node in closed:
                continue
            closed.add(node)
            for b in near.get(node, []):
                new = cost + cost_of.get((b, node) if flip else (node, b), 1.0)
                if b not in best or new < best[b]:
                    best[b], parent[b] = new, node
                    heapq.heappush(heap, (new, b))
            for m in [node, *near.get(node, [])]:
                if m in sides[0][1] and m in sides[1][1]:
                    total = sides[0][1][m] + sides[1][1][m]
                    if total < least or (total == least and m < met):
                        met, least = m, total
        if met is None:
            raise GraphError("NO_PATH", f"{start} to {goal}")
        halves = []
        for s in sides:
            part = [met]
            while part[-1] in s[2]:
                part.append(s[2][part[-1]])
            halves.append(part)
        return pd.DataFrame({"cost": [least], "path": ["/".join(halves[0][::-1] + halves[1][1:])]})

    return local(reached(reached(edges, [start]), [goal], "in"), kernel, "cost double, path string")
