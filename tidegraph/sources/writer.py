"""The client side: sessions that build patches, and writers that append them to a log."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.fold import EDGE, State, live_dots
from tidegraph.sources.event_log import OBSERVED, OPS, PATCHES, Log

FOOTPRINT = "sha string, entity string, kind string"
CONTEXT = "sha string, ctx_writer string, ctx_counter bigint"
_COLUMNS = [c.split()[0] for c in OPS.split(", ")]


class PatchError(ValueError):
    """Carries the code of a patch that can't be built or committed."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}")
        self.code = code


def checked(*names: str) -> None:
    for n in names:
        if not n or "\x00" in n or n.startswith("\x01"):
            raise PatchError("E_PATCH_BAD_ID", repr(n))


def typed(value: object) -> dict[str, object]:
    """The value columns of a property."""
    if value is None:
        return {"value_type": "null"}
    if isinstance(value, bool):
        return {"value_type": "boolean", "value_str": str(value).lower()}
    if isinstance(value, (int, float)):
        return {"value_type": "number", "value_num": float(value)}
    if isinstance(value, str):
        return {"value_type": "string", "value_str": value}
    return {"value_type": "json", "value_str": json.dumps(value, sort_keys=True, separators=(",", ":"))}


@dataclass
class PatchSession:
    """Collects the operations of one patch on top of a state; commit turns them into rows of a log."""

    spark: SparkSession
    writer: str
    lamport: int
    state: State | None = None
    parent: str = ""
    context: dict[str, int] = field(default_factory=dict)
    #: the writer's dots so far
    counter: int = 0
    rows: list[dict] = field(default_factory=list)
    seen_dots: list[tuple[int, str, int]] = field(default_factory=list)
    reads: set[str] = field(default_factory=set)
    writes: set[str] = field(default_factory=set)

    def _op(self, kind: str, dot: bool = False, **values) -> PatchSession:
        if dot:
            self.counter += 1  # one dot per addition: the writer's counter runs on from patch to patch
            values |= {"dot_writer": self.writer, "dot_counter": self.counter}
        self.rows.append({"op_type": kind, **values})
        return self

    def _observe(self, adds: DataFrame, tombs: DataFrame, condition) -> int:
        found = live_dots(adds, tombs).where(condition).select("dot_writer", "dot_counter").collect()  # one element's dots
        self.seen_dots += [(len(self.rows), r["dot_writer"], r["dot_counter"]) for r in found]
        return len(found)

    def add_node(self, node: str) -> PatchSession:
        checked(node)
        self.writes.add(node)
        return self._op("NodeAdd", True, node=node)

    def add_edge(self, src: str, dst: str, label: str) -> PatchSession:
        checked(src, dst, label)
        self.reads |= {src, dst}
        self.writes.add(f"{src}->{dst}")
        return self._op("EdgeAdd", True, src=src, dst=dst, label=label)

    def remove_node(self, node: str, attached: str = "reject") -> PatchSession:
        """attached: cascade removes the node's edges too, reject refuses while it has any, warn leaves them hidden."""
        if self.state is None:
            raise PatchError("E_PATCH_NO_STATE", "a removal has to see what it removes")
        edges = live_dots(self.state.edge_adds, self.state.edge_tombs).where((F.col("src") == node) | (F.col("dst") == node))
        held = edges.select(*EDGE).distinct().collect() if attached != "warn" else []
        if held and attached == "reject":
            raise PatchError("E_PATCH_DELETE_WITH_DATA", node)
        for e in held:
            self.remove_edge(*e)
        self._observe(self.state.node_adds, self.state.node_tombs, F.col("node") == node)
        self.reads.add(node)
        self.writes.add(node)
        return self._op("NodeRemove", node=node)

    def remove_edge(self, src: str, dst: str, label: str) -> PatchSession:
        if self.state is None:
            raise PatchError("E_PATCH_NO_STATE", "a removal has to see what it removes")
        self._observe(self.state.edge_adds, self.state.edge_tombs, (F.col("src") == src) & (F.col("dst") == dst) & (F.col("label") == label))
        self.reads.add(f"{src}->{dst}")
        self.writes.add(f"{src}->{dst}")
        return self._op("EdgeRemove", src=src, dst=dst, label=label)

    def set_property(self, node: str, key: str, value: object) -> PatchSession:
        """A node that isn't there may have properties; they show once it is."""
        checked(node, key)
        if key in ("__proto__", "constructor", "prototype"):
            raise PatchError("E_PATCH_BAD_KEY", key)
        self.writes.add(node)
        return self._op("NodePropSet", node=node, key=key, **typed(value))

    def set_edge_property(self, src: str, dst: str, label: str, key: str, value: object) -> PatchSession:
        here = any(r["op_type"] == "EdgeAdd" and (r["src"], r["dst"], r["label"]) == (src, dst, label) for r in self.rows)
        if not here:
            at = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("label") == label)
            if self.state is None or live_dots(self.state.edge_adds, self.state.edge_tombs).where(at).isEmpty():
                raise PatchError("E_PATCH_EDGE_PROP_UNKNOWN_EDGE", f"{src}->{dst}:{label}")
        self.writes.add(f"{src}->{dst}")
        return self._op("EdgePropSet", src=src, dst=dst, label=label, key=key, **typed(value))

    def attach_content(self, node: str, handle: str, mime: str | None = None, size: int | None = None) -> PatchSession:
        return self.set_property(node, "_content", handle).set_property(node, "_content.mime", mime).set_property(node, "_content.size", size)

    def clear_content(self, node: str) -> PatchSession:
        return self.attach_content(node, None)

    def build(self) -> tuple[str, list[tuple]]:
        """The patch's content address and its operation rows."""
        if not self.rows:
            raise PatchError("E_PATCH_EMPTY")
        body = json.dumps([self.writer, self.lamport, self.parent, self.rows, self.seen_dots], sort_keys=True)
        sha = hashlib.sha256(body.encode()).hexdigest()[:40]
        fixed = {"sha": sha, "writer": self.writer, "lamport": self.lamport, "seq": self.lamport}
        return sha, [tuple((fixed | {"op_index": i} | r).get(c) for c in _COLUMNS) for i, r in enumerate(self.rows)]

    def commit(self) -> Log:
        """The patch as a log of one patch, to be appended to the tables or joined by Log.union."""
        sha, ops = self.build()
        make = self.spark.createDataFrame
        foot = [(sha, e, "read") for e in sorted(self.reads)] + [(sha, e, "write") for e in sorted(self.writes)]
        return Log(
            make([(sha, self.writer, self.lamport, self.lamport)], PATCHES),
            make(ops, OPS),
            make([(sha, i, w, c) for i, w, c in self.seen_dots], OBSERVED),
            make([(sha, w, c) for w, c in self.context.items()], CONTEXT),
            make(foot, FOOTPRINT),
        )


def session(spark: SparkSession, log: Log | None, writer: str, state: State | None = None, expected_tip: str | None = None) -> PatchSession:
    """A session for a writer's next patch: one tick past all that it has written or seen.

    expected_tip guards against a second session of the same writer: if the chain has moved on, the commit is refused.
    """
    if log is None:
        return PatchSession(spark, writer, 1)
    own = log.patches.where(F.col("writer") == writer).agg(F.max(F.struct("seq", "sha")).alias("tip")).first()["tip"]
    if expected_tip is not None and (own is None or own["sha"] != expected_tip):
        raise PatchError("E_PATCH_CONFLICT", f"the tip of {writer} has moved")
    clock = {r["writer"]: r["counter"] for r in (state.frontier.collect() if state else [])}  # one row per writer
    tick = max([own["seq"] if own else 0, *clock.values()]) + 1
    last = log.ops.where(F.col("dot_writer") == writer).agg(F.max("dot_counter")).first()[0] or 0
    return PatchSession(spark, writer, tick, state, own["sha"] if own else "", clock, last)
