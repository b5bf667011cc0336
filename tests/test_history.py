"""The fold against a sequential replay, its laws, and what is read off a history."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions.text import decode_dot, encode_dot, shard_key
from tidegraph.operators import exchange, fold, history, receipts, visible
from tidegraph.sources import event_log
from tidegraph.sources.event_log import Log


def make(spark, seed, n=120):
    """A random log, and the state that a sequential replay gives."""
    rng = random.Random(seed)
    patches, ops, observed, context = [], [], [], []
    adds: dict[str, list] = {"n": [], "e": []}
    ticks = dict.fromkeys("pqr", 0)
    for i in range(n):
        w = rng.choice("pqr")
        ticks[w] += 1
        t, sha = ticks[w], f"{i:08x}{rng.randrange(1 << 32):08x}"
        node, other, label = f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", rng.choice("xy")
        row = dict.fromkeys(["node", "src", "dst", "label", "key", "value_type", "value_num", "value_str", "dot_writer", "dot_counter", "oid"])
        kind = rng.choices(["NodeAdd", "EdgeAdd", "NodePropSet", "EdgePropSet", "NodeRemove", "EdgeRemove"], [30, 25, 15, 10, 12, 8])[0]
        if kind == "NodeAdd":
            row |= {"node": node, "dot_writer": w, "dot_counter": t}
            adds["n"].append((node, w, t))
        elif kind == "EdgeAdd":
            row |= {"src": node, "dst": other, "label": label, "dot_writer": w, "dot_counter": t}
            adds["e"].append(((node, other, label), w, t))
        elif kind == "NodePropSet":
            row |= {"node": node, "key": "k", "value_type": "number", "value_num": float(i)}
        elif kind == "EdgePropSet":
            row |= {"src": node, "dst": other, "label": label, "key": "k", "value_type": "number", "value_num": float(i)}
        else:
            family = "n" if kind == "NodeRemove" else "e"
            seen = [a for a in adds[family] if rng.random() < 0.3]
            observed += [(sha, 0, a[1], a[2]) for a in seen]
        patches.append((sha, w, t, t))
        ops.append((sha, w, t, t, 0, kind, *row.values()))
        if t > 1:
            context.append((sha, w, t - 1))
    frames = (
        spark.createDataFrame(patches, event_log.PATCHES),
        spark.createDataFrame(ops, event_log.OPS),
        spark.createDataFrame(observed, event_log.OBSERVED),
        spark.createDataFrame(context, "sha string, ctx_writer string, ctx_counter bigint"),
        spark.createDataFrame([], "sha string, entity string, kind string"),
    )
    return Log(*frames), (ops, observed)


def replay(ops, observed):
    """Visible state by plain loops."""
    dots = {"n": {}, "e": {}}
    dead = {"n": set(), "e": set()}
    props, births = {}, {}
    by_sha: dict = {}
    for sha, _, w, c in observed:
        by_sha.setdefault(sha, []).append((w, c))
    for sha, w, t, _, index, kind, node, src, dst, label, key, _, num, _, dw, dc, _ in ops:
        at = (t, w, sha, index)
        if kind == "NodeAdd":
            dots["n"].setdefault(node, set()).add((dw, dc))
        elif kind == "EdgeAdd":
            dots["e"].setdefault((src, dst, label), set()).add((dw, dc))
            births[src, dst, label] = max(births.get((src, dst, label), at), at)
        elif kind.endswith("PropSet"):
            name = (node, key) if kind == "NodePropSet" else (src, dst, label, key)
            props[name] = max(props.get(name, (at, num)), (at, num))
        else:
            dead["n" if kind == "NodeRemove" else "e"] |= set(by_sha.get(sha, ()))
    nodes = {n for n, d in dots["n"].items() if d - dead["n"]}
    edges = {e for e, d in dots["e"].items() if d - dead["e"] and e[0] in nodes and e[1] in nodes}
    node_props = {(*k, v) for k, (_, v) in props.items() if len(k) == 2 and k[0] in nodes}
    edge_props = {(*k, v) for k, (at, v) in props.items() if len(k) == 4 and k[:3] in edges and at >= births[k[:3]]}
    return nodes, edges, node_props, edge_props


def seen(g):
    return (
        {r[0] for r in g.nodes.collect()},
        {tuple(r) for r in g.edges.collect()},
        {(r["node_id"], r["key"], r["value_num"]) for r in g.node_props.collect()},
        {(r["src"], r["dst"], r["label"], r["key"], r["value_num"]) for r in g.edge_props.collect()},
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_is_a_replay_and_a_join(spark, seed):
    log, raw = make(spark, seed)
    want = replay(*raw)
    assert seen(visible.graph(fold.fold(log))) == want
    a, b = log.where("lamport % 2 = 0"), log.where("lamport % 2 = 1")
    assert seen(visible.graph(fold.join_states(fold.fold(a), fold.fold(b)))) == want
    assert seen(visible.graph(fold.join_states(fold.fold(log), fold.fold(a)))) == want


def test_state_hash_and_checkpoint(spark, tmp_path):
    log, _ = make(spark, 5)
    state = fold.fold(log)
    state.write(str(tmp_path / "s"))
    back = fold.State.read(spark, str(tmp_path / "s"))
    assert visible.state_hash(visible.graph(state)).first() == visible.state_hash(visible.graph(back)).first()
    assert history.equivalent(visible.graph(state), visible.graph(back)).first()["equivalent"]


def test_collection_keeps_what_is_visible(spark):
    log, raw = make(spark, 7)
    state = fold.fold(log)
    small = fold.compact(state, state.frontier)
    assert seen(visible.graph(small)) == replay(*raw)
    assert fold.metrics(small).first()["tombstones"] == 0 <= fold.metrics(state).first()["tombstones"]


def test_transfer_turns_one_state_into_the_other(spark):
    log, _ = make(spark, 9)
    a, b = (visible.graph(fold.fold(log.where(F.col("lamport") <= t))) for t in (15, 40))
    plan = history.transfer_plan(a, b).collect()
    nodes = seen(a)[0] | {r["name"] for r in plan if r["op"] == "addNode"}
    assert nodes - {r["name"] for r in plan if r["op"] == "removeNode"} == seen(b)[0]
    assert [r["phase"] for r in plan] == sorted(r["phase"] for r in plan)


def test_causal_replay_supersedes_nothing(spark):
    log, _ = make(spark, 11)
    assert receipts.prop_receipts(log, "causal").where("result <> 'applied'").isEmpty()
    assert receipts.receipts(log).count() == log.ops.count()


def test_temporal(spark):
    rows = [("a1", "w", 1, 1, 0, "NodeAdd", "n", *[None] * 7, "w", 1, None), ("a2", "w", 2, 2, 0, "NodePropSet", "n", None, None, None, "k", "number", 5.0, None, None, None, None),
            ("a3", "w", 3, 3, 0, "NodePropSet", "n", None, None, None, "k", "number", -1.0, None, None, None, None)]
    patches = [(r[0], r[1], r[2], r[3]) for r in rows]
    log = Log(spark.createDataFrame(patches, event_log.PATCHES), spark.createDataFrame(rows, event_log.OPS), spark.createDataFrame([], event_log.OBSERVED), spark.createDataFrame([], "sha string, ctx_writer string, ctx_counter bigint"), spark.createDataFrame([], "sha string, entity string, kind string"))
    up = F.col("value_num") > 0
    assert history.temporal(log, "n", "k", up).first() == (False, True)
    assert history.temporal(log, "n", "k", up, since=3).first() == (False, False)
    assert history.temporal(log, "none", "k", up).first() == (False, False)
    assert history.bisect(log, "w", "a1", "a3", lambda s: s.node_props.where("value_num < 0").isEmpty()) == ("a3", 1)
    with pytest.raises(ValueError, match="E_BISECT_RANGE"):
        history.bisect(log, "w", "a1", "a1", bool)


def test_sync_and_trust_and_audit(spark):
    tips = lambda rows: spark.createDataFrame(rows, "writer string, tip_sha string")
    delta = {r["writer"]: tuple(r)[1:] for r in exchange.sync_delta(tips([("a", "1"), ("b", "2")]), tips([("b", "3"), ("c", "4")])).collect()}
    assert delta == {"a": (None, None, None, "1"), "b": ("2", "3", "3", "2"), "c": (None, "4", None, None)}
    intents = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b"]), ("3", ["b"])], "intent_id string, footprint array<string>")
    assert [tuple(r) for r in exchange.intent_tick(intents).orderBy("intent_id").collect()] == [("1", True), ("2", False), ("3", True)]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "chain long, seq long, text string")
    made = exchange.audit_receipts(rows, F.col("text"))
    assert exchange.audit_chain(made).first()["status"] == "VALID"
    broken = made.withColumn("digest", F.when(F.col("seq") == 2, "0").otherwise(F.col("digest")))
    assert (exchange.audit_chain(broken).first()["status"], exchange.audit_chain(broken).first()["first_bad"]) == ("BROKEN_CHAIN", 3)


def test_text_functions(spark):
    row = spark.createDataFrame([("user:alice", "__proto__", "AB" * 20, "a:b:7")], "a string, b string, c string, d string")
    out = row.select(shard_key(F.col("a")), shard_key(F.col("b")), shard_key(F.col("c")), decode_dot(F.col("d")), encode_dot(F.lit("w"), F.lit(3))).first()
    assert (out[0], out[1], out[2], tuple(out[3]), out[4]) == ("10", "bd", "ab", ("a:b", 7), "w:3")


def test_merge3(spark):
    rows = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    out = {r["key"]: (r["outcome"], r["value"]) for r in receipts.merge3(rows({"a": "1", "b": "1", "c": "1"}), rows({"a": "2", "b": "1", "c": "2"}), rows({"a": "3", "b": "1"})).collect()}
    assert out == {"a": ("obstruction", None), "c": ("obstruction", None)}


def test_unknown_ops_fail_and_bad_ones_are_found(spark):
    log, _ = make(spark, 13, 20)
    bad = log.ops.withColumn("op_type", F.lit("Other"))
    with pytest.raises(Exception, match="E_PATCH_UNKNOWN_OP"):
        event_log.lowered(bad).collect()
    assert event_log.invalid(bad).count() == bad.count()
    assert event_log.invalid(log.ops).isEmpty()
