"""Patches that sessions build fold to what they say."""

import pytest

from tests.test_history import seen
from tidegraph.operators import fold, visible
from tidegraph.operators.observe import attachments
from tidegraph.sources import writer


def test_sessions(spark):
    log = writer.session(spark, None, "a").add_node("x").add_node("y").add_edge("x", "y", "e").set_edge_property("x", "y", "e", "w", 2).set_property("x", "k", "v").commit()
    state = fold.fold(log)
    nodes, edges, props, edge_props = seen(visible.graph(state))
    assert (nodes, edges, len(props), edge_props) == ({"x", "y"}, {("x", "y", "e")}, 1, {("x", "y", "e", "w", 2.0)})
    with pytest.raises(writer.PatchError, match="E_PATCH_DELETE_WITH_DATA"):
        writer.session(spark, log, "b", state).remove_node("x")
    more = writer.session(spark, log, "b", state)
    assert more.lamport == 2
    both = log.union(more.remove_node("x", "cascade").attach_content("y", "h", "text/plain", 3).commit())
    after = visible.graph(fold.fold(both))
    assert seen(after)[:2] == ({"y"}, set())
    assert attachments(after).first() == ("y", "h", "text/plain", 3)


def test_refusals(spark):
    one = writer.session(spark, None, "a")
    with pytest.raises(writer.PatchError, match="E_PATCH_EMPTY"):
        one.build()
    with pytest.raises(writer.PatchError, match="E_PATCH_EDGE_PROP_UNKNOWN_EDGE"):
        one.set_edge_property("x", "y", "e", "k", 1)
    with pytest.raises(writer.PatchError, match="E_PATCH_BAD_ID"):
        one.add_node("")
    log = one.add_node("n").commit()
    with pytest.raises(writer.PatchError, match="E_PATCH_CONFLICT"):
        writer.session(spark, log, "a", expected_tip="other")


def test_dots_run_on_and_compact(spark):
    log = writer.session(spark, None, "a").add_node("x").add_node("y").commit()
    state = fold.fold(log)
    log = log.union(writer.session(spark, log, "a", state).add_node("z").remove_node("x").commit())
    state = fold.fold(log)
    assert sorted(r["dot_counter"] for r in state.node_adds.collect()) == [1, 2, 3]
    assert [tuple(r) for r in fold.applied(state).collect()] == [("a", 3)]
    small = fold.compact(state, fold.applied(state))
    assert sorted(r["node"] for r in small.node_adds.collect()) == ["y", "z"] and small.node_tombs.isEmpty()
    none = fold.compact(state, fold.applied(state).where("counter < 0"))
    assert none.node_adds.count() == 3 and none.node_tombs.count() == 1
