"""Traversals, queries and views over small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import observe, traverse
from tidegraph.operators.query import Query, QueryError
from tidegraph.sources.star_graph import Graph

PROPS = "node_id string, key string, value_type string, value_num double, value_str string"
EDGE_PROPS = "src string, dst string, label string, key string, value_type string, value_num double, value_str string"


def graph(spark, nodes, edges, props=()):
    """edges are 'A>B' or 'A>B/label'; props are (node, key, value)."""
    rows = [(*e.partition("/")[0].split(">"), e.partition("/")[2] or "e") for e in edges]
    typed = [(n, k, "null" if v is None else "string" if isinstance(v, str) else "number", float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None) for n, k, v in props]
    return Graph(
        spark.createDataFrame([(n,) for n in nodes], "node_id string"),
        spark.createDataFrame(rows, "src string, dst string, label string"),
        spark.createDataFrame(typed, PROPS),
        spark.createDataFrame([], EDGE_PROPS),
    )


def ids(df):
    return [r[0] for r in df.collect()]


def test_levels_are_sorted_and_nodes_seen_once(spark):
    g = graph(spark, "ABCDZ", ["A>B", "A>C", "B>Z", "C>D"])
    assert ids(traverse.bfs(g.edges, g.nodes, "A")) == list("ABCDZ")
    many = graph(spark, "ABCDE", ["A>B", "A>C", "A>E", "B>D", "C>D", "E>D"])
    assert ids(traverse.bfs(many.edges, many.nodes, "A")) == list("ABCED")
    order = graph(spark, ["S", "A", "a", "ä"], ["S>A", "S>a", "S>ä"])
    assert ids(traverse.bfs(order.edges, order.nodes, "S")) == ["S", "A", "a", "ä"]


def test_depth_first_takes_the_smallest_neighbour_first(spark):
    g = graph(spark, "ABCDE", ["A>B", "A>C", "B>D", "C>E"])
    assert [r["node_id"] for r in traverse.dfs(g.edges, "A").orderBy("position").collect()] == list("ABDCE")


def test_diamond(spark):
    g = graph(spark, "ABCD", ["A>B", "A>C", "B>D", "C>D"])
    assert traverse.shortest_path(g.edges, g.nodes, "A", "D").first() == (True, 2, "A/B/D")
    assert traverse.shortest_path(g.edges, g.nodes, "D", "A").first() == (False, -1, "")
    assert [r["node_id"] for r in traverse.topological_sort(g.edges, ["A"]).orderBy("position").collect()] == list("ABCD")
    assert {tuple(r) for r in traverse.closure(g.edges, g.nodes).collect()} == {("A", "B"), ("A", "C"), ("A", "D"), ("B", "D"), ("C", "D")}


def test_equal_costs_keep_the_smaller_predecessor(spark):
    g = graph(spark, "SBCG", ["S>C", "C>G", "S>B", "B>G"])
    w = spark.createDataFrame([("S", "C", "e", 1.0), ("C", "G", "e", 4.0), ("S", "B", "e", 3.0), ("B", "G", "e", 2.0)], "src string, dst string, label string, w double")
    assert traverse.weighted_shortest_path(g.edges, g.nodes, "S", "G", weights=w).first() == (5.0, "S/B/G")
    star = traverse.a_star(g.edges, "S", "G", {("S", "C"): 1.0, ("C", "G"): 4.0, ("S", "B"): 3.0, ("B", "G"): 2.0}).first()
    assert (star["cost"], star["path"]) == (5.0, "S/B/G")
    both = traverse.bidirectional_a_star(g.edges, "S", "G", {("S", "C"): 1.0, ("C", "G"): 4.0, ("S", "B"): 3.0, ("B", "G"): 2.0}).first()
    assert both["cost"] == 5.0
    with pytest.raises(traverse.GraphError):
        traverse.weighted(g.edges, w, w)


def test_node_weights_levels_and_longest_path(spark):
    g = graph(spark, ["START", "A", "B", "C", "END"], ["START>A", "START>B", "A>C", "B>C", "C>END"])
    w = spark.createDataFrame([("START", 0.0), ("A", 3.0), ("B", 5.0), ("C", 2.0), ("END", 0.0)], "node_id string, w double")
    assert traverse.weighted_shortest_path(g.edges, g.nodes, "START", "END", node_weights=w).first() == (5.0, "START/A/C/END")
    assert traverse.weighted_longest_path(g.edges, g.nodes, "START", "END", node_weights=w).first() == (7.0, "START/B/C/END")
    lv = graph(spark, "ABCDE", ["A>B", "A>C", "B>D", "D>E", "C>E"])
    assert [tuple(r) for r in traverse.levels(lv.edges, lv.nodes, ["A"]).collect()] == [("A", 0), ("B", 1), ("C", 1), ("D", 2), ("E", 3)]


def test_cycles(spark):
    g = graph(spark, "ABC", ["A>B", "B>C", "C>A"])
    assert [tuple(r) for r in traverse.topological_sort(g.edges, ["A"]).collect()] == [(None, n, True) for n in "ABC"]
    with pytest.raises(Exception, match="ERR_GRAPH_HAS_CYCLES"):
        traverse.levels(g.edges, g.nodes, ["A"]).collect()
    assert ("A", "A") not in {tuple(r) for r in traverse.closure(g.edges, g.nodes).collect()}


def test_reduction_ancestors_and_reach(spark):
    g = graph(spark, "ABC", ["A>B", "A>C", "B>C"])
    assert [(r["src"], r["dst"]) for r in traverse.reduction(g.edges, g.nodes).collect()] == [("A", "B"), ("B", "C")]
    roots = graph(spark, ["R1", "R2", "A", "B", "C", "D"], ["R1>A", "A>D", "R2>B", "R2>C", "B>D", "C>D"])
    assert ids(traverse.root_ancestors(roots.edges, roots.nodes, "D")) == ["R1", "R2"]
    assert ids(traverse.common_ancestors(roots.edges, roots.nodes, ["B", "C"])) == ["R2"]
    assert ids(traverse.common_ancestors(roots.edges, roots.nodes, ["B"])) == ["B", "R2"]
    assert traverse.is_reachable(g.edges, "nowhere", "nowhere").first()[0]
    assert not traverse.is_reachable(g.edges, "C", "A").first()[0]


def test_both_directions_and_labels(spark):
    g = graph(spark, "ABC", ["A>B/x", "B>A/x", "B>A/y", "A>C/x"])
    a = g.nodes.where("node_id = 'A'")
    assert {(r["neighbour"], r["label"]) for r in observe.neighbours(g, a, dedup=True).collect()} == {("B", "x"), ("B", "y"), ("C", "x")}
    assert observe.neighbours(g, a).count() == 4
    assert observe.neighbours(g, a, labels=[]).count() == 0


def test_hops(spark):
    loop = graph(spark, "AB", ["A>A", "A>B", "B>A"])
    q = Query(loop).match("A")
    assert ids(q.outgoing().run()) == ["A", "B"]
    assert ids(q.outgoing(depth=(1, 2)).run()) == ["B"]
    assert ids(q.outgoing(depth=0).run()) == ["A"]


def test_where_and_aggregate(spark):
    g = graph(spark, ["a", "b", "c"], [], [("a", "k", 5), ("b", "k", "5"), ("c", "n", None)])
    assert ids(Query(g).where({"k": 5}).run()) == ["a"]
    assert ids(Query(g).where({"k": None}).run()) == []
    assert ids(Query(g).where({"n": None}).run()) == ["c"]
    assert ids(Query(g).where(F.size("edges_out") > 0).run()) == []
    assert Query(g).aggregate(count=True, sum="k", min="props.k", avg="none").first() == (3, 5.0, 5.0, 0.0)
    with pytest.raises(QueryError, match="E_QUERY_AGGREGATE_TERMINAL"):
        Query(g).aggregate(count=True).outgoing()
    deep = graph(spark, ["a", "b", "c"], [], [("a", "at", '{"floor": {"n": 2.5}}'), ("b", "at", '{"floor": {"n": "7"}}'), ("c", "at", 4)])
    assert Query(deep).aggregate(count=True, sum="props.at.floor.n", max="at").first() == (3, 9.5, 4.0)
    with pytest.raises(QueryError, match="E_QUERY_SELECT_FIELD"):
        Query(g).select(["other"])
    with pytest.raises(QueryError, match="E_QUERY_DEPTH"):
        Query(g).outgoing(depth=(3, 2))


def test_glob_keeps_to_one_line(spark):
    g = graph(spark, ["ab", "a\nb", "a.b", "axb"], [])
    assert ids(Query(g).match("a*b").run()) == ["a.b", "ab", "axb"]
    assert ids(Query(g).match("a.b").run()) == ["a.b"]
    assert len(ids(Query(g).match("*").run())) == 4


def test_views(spark):
    g = graph(spark, ["x:1", "x:2", "y:1"], ["x:1>x:2", "x:1>y:1"], [("x:1", "p", 1), ("x:1", "q", 2)])
    view = observe.observe(g, "x:*", expose=["p", "q"], redact=["q"])
    assert observe.emission(view).first() == (2, 1, "p")
    assert ids(observe.scope(g, ["x:"], ["x:2"]).nodes) == ["x:1"]
    assert observe.translation_cost(g, view).first()["cost"] > 0
    assert observe.translation_cost(observe.observe(g, "none"), g).first()["cost"] == 0
    page = observe.page(g, "x:1", 1)
    assert [tuple(r) for r in page.collect()] == [("x:1", "out", "x:2", "e")]
    assert [tuple(r) for r in observe.page(g, "x:1", 5, ("out", "x:2", "e")).collect()] == [("x:1", "out", "y:1", "e")]


def test_the_bound_counts_reachable_edges_alone(spark, monkeypatch):
    g = graph(spark, "ABCDEXYZ", ["A>B", "B>C", "D>C", "E>C", "X>Y", "Y>Z", "Z>X", "B>E"])
    monkeypatch.setattr(traverse.local, "__defaults__", (4,))
    assert [r["node_id"] for r in traverse.dfs(g.edges, "A").orderBy("position").collect()] == list("ABCE")
    assert [r["node_id"] for r in traverse.topological_sort(g.edges, ["A"]).orderBy("position").collect()] == list("ABEC")
    assert tuple(traverse.a_star(g.edges, "A", "C").first()) == (2.0, "A/B/C", 3)
    assert tuple(traverse.bidirectional_a_star(g.edges, "A", "C").first()) == (2.0, "A/B/C")
    # a start without edges is still a result
    assert [tuple(r) for r in traverse.dfs(g.edges, "C").collect()] == [(0, "C")]
    monkeypatch.setattr(traverse.local, "__defaults__", (3,))
    with pytest.raises(traverse.GraphError):
        traverse.dfs(g.edges, "A")


def test_errors_of_traversals(spark):
    loop = graph(spark, "AB", ["A>B", "B>A"])
    with pytest.raises(traverse.GraphError, match="ERR_GRAPH_HAS_CYCLES"):
        traverse.reduction(loop.edges, loop.nodes)
    line = graph(spark, "ABC", ["A>B", "B>C"])
    with pytest.raises(traverse.GraphError, match="E_MAX_EDGES_EXCEEDED"):
        traverse.closure(line.edges, line.nodes, max_edges=2)
    assert traverse.closure(line.edges, line.nodes, max_edges=3).count() == 3
    with pytest.raises(Exception, match="NO_PATH"):
        traverse.a_star(line.edges, "C", "A").collect()


def test_closure_and_reduction_against_brute_force(spark):
    import numpy as np

    from tidegraph.sources import compact

    rng = np.random.default_rng(5)
    for acyclic in (True, False):
        ends = {(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2)) if a < b or not acyclic}
        g = graph(spark, [f"n{i}" for i in range(30)] + ["alone"], [f"n{a}>n{b}/{label}" for a, b in ends for label in "xy"])
        reach = {i: {b for a, b in ends if a == i} for i in range(40)}
        for _ in range(40):
            reach = {i: found.union(*(reach[j] for j in found)) for i, found in reach.items()}
        found = [tuple(r) for r in traverse.closure(g.edges, g.nodes).collect()]
        assert sorted(found) == sorted((f"n{a}", f"n{b}") for a in range(30) for b in reach[a] if a != b)
        back = {tuple(r) for r in traverse.closure(g.edges, g.nodes, "in", ["x"]).collect()}
        assert back == {(f"n{b}", f"n{a}") for a in range(40) for b in reach[a] if a != b and b < 30}
        if acyclic:
            left = sorted((f"n{a}", f"n{b}", label) for a, b in ends if not any(b in reach[m] for x, m in ends if x == a) for label in "xy")
            assert [tuple(r) for r in traverse.reduction(g.edges, g.nodes).collect()] == left
    none = graph(spark, ["A"], ["A>B"])
    assert traverse.closure(none.edges, none.nodes, labels=[]).count() == 0
    assert traverse.closure(none.edges.where("false"), none.nodes.where("false")).count() == 0
    assert traverse.reduction(none.edges.where("false"), none.nodes).count() == 0
    # origins that don't fit together are walked by halves, and one alone without a bound
    ends, targets = np.array([0, 3, 5, 6, 6]), np.array([1, 2, 3, 2, 3, 3])
    assert compact.walked(np.arange(3), 4, ends, targets, 4, False) is None
    assert compact.walked(np.array([0]), 4, ends, targets, None, False)[1].tolist() == [1, 2, 3]


def test_closure_neither_shuffles_nor_writes_pairs(spark, monkeypatch):
    """Pairs by the square of the nodes: a chain of 300 has 44 850."""
    from tidegraph.operators import traverse as module

    g = graph(spark, [f"{i:03}" for i in range(300)], [f"{i:03}>{i + 1:03}" for i in range(299)] + ["000>299"])
    monkeypatch.setattr(module, "reach", lambda *_: pytest.fail("pairs go level by level through the shared folder"))
    found = traverse.closure(g.edges, g.nodes)
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 300 * 299 // 2
    assert traverse.reduction(g.edges, g.nodes).count() == 299


def test_reduction_writes_what_it_drops_alone(spark, monkeypatch):
    """Of a chain of 100 with a step from its start to every node, 98 steps are dropped; its closure has 4950 pairs."""
    g = graph(spark, [], [f"{i:03}>{i + 1:03}" for i in range(99)] + [f"000>{i:03}" for i in range(2, 100)])
    rows = []

    def counting(df, *more):
        rows.append(df.count())
        return df

    monkeypatch.setattr(traverse, "written", counting)
    assert traverse.reduction(g.edges, g.nodes).count() == 99
    assert sum(rows) == 98
