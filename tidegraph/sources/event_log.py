"""An operation log: patches, their operations, and the dots that removals observed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OP_TYPES = ("NodeAdd", "NodeRemove", "EdgeAdd", "EdgeRemove", "NodePropSet", "EdgePropSet", "PropSet", "BlobValue")
OPS = (
    "sha string, writer string, lamport bigint, seq bigint, op_index int, op_type string, node string, src string, dst string, label string, "
    "key string, value_type string, value_num double, value_str string, dot_writer string, dot_counter bigint, oid string"
)
OBSERVED = "sha string, op_index int, dot_writer string, dot_counter bigint"
PATCHES = "sha string, writer string, lamport bigint, seq bigint"


@dataclass(frozen=True)
class Log:
    """patches(sha, writer, lamport, seq), ops (one wide row each), observed dots, context and footprint per patch."""

    patches: DataFrame
    ops: DataFrame
    observed: DataFrame
    context: DataFrame  # sha, ctx_writer, ctx_counter
    footprint: DataFrame  # sha, entity, kind: read or write
    #: observed, context and footprint with their patches' columns, and observed with op_type, where a source has them
    wide: dict[str, DataFrame] | None = None

    def only(self, keep: DataFrame) -> Log:
        """The log restricted to the patches whose sha is in a one-column table."""
        cut = lambda df: df.join(keep, "sha", "left_semi")
        return Log(cut(self.patches), cut(self.ops), cut(self.observed), cut(self.context), cut(self.footprint))

    def where(self, condition: Column | str) -> Log:
        """The log restricted by a condition on the patches' columns."""
        if not self.wide:
            return self.only(self.patches.where(condition).select("sha"))
        wide = {n: df.where(condition) for n, df in self.wide.items()}
        return Log(self.patches.where(condition), self.ops.where(condition), *(wide[n].select(getattr(self, n).columns) for n in wide), wide)

    def dated(self, name: str) -> DataFrame:
        """observed, context or footprint with lamport, and observed with op_type."""
        if self.wide:
            return self.wide[name]
        rows = getattr(self, name)
        if name == "observed":
            return rows.join(self.ops.select("sha", "op_index", "op_type", "lamport"), ["sha", "op_index"])
        return rows.join(self.patches.select("sha", "lamport"), "sha")

    def union(self, other: Log) -> Log:
        """Both logs; patches that are in both count once."""
        fresh = other.only(other.patches.join(self.patches.select("sha"), "sha", "left_anti").select("sha"))
        return Log(*(getattr(self, n).unionByName(getattr(fresh, n)) for n in ("patches", "ops", "observed", "context", "footprint")))


def event_id() -> Column:
    """The total order of operations: structs compare field by field."""
    return F.struct("lamport", "writer", "sha", "op_index")


def lowered(ops: DataFrame) -> DataFrame:
    """Raw property sets become node or edge property sets; an operation of an unknown type fails the job."""
    edge = F.col("node").startswith("\x01")
    parts = F.split(F.expr("substring(node, 2)"), "\x00")
    raw = F.col("op_type") == "PropSet"
    kind = F.when(raw & edge, "EdgePropSet").when(raw, "NodePropSet").otherwise(F.col("op_type"))
    known = F.when(F.col("op_type").isin(*OP_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("E_PATCH_UNKNOWN_OP: "), F.coalesce("op_type", F.lit("null")))))
    return ops.withColumns(
        {
            "op_type": known,
            **{c: F.when(raw & edge, F.get(parts, F.lit(i))).otherwise(F.col(c)) for i, c in enumerate(("src", "dst", "label"))},
            "node": F.when(~(raw & edge) | F.col("node").isNull(), F.col("node")),
        }
    )


def invalid(ops: DataFrame) -> DataFrame:
    """Operations that break a constraint, with the reason: the quarantine of a load."""
    node_ops = F.col("op_type").isin("NodeAdd", "NodePropSet", "BlobValue")
    edge_ops = F.col("op_type").isin("EdgeAdd", "EdgePropSet")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(~F.col("op_type").isin(*OP_TYPES) | F.col("op_type").isNull(), "unknown op")
        .when(node_ops & blank("node"), "empty node id")
        .when(edge_ops & (blank("src") | blank("dst") | blank("label")), "empty edge part")
        .when(F.col("op_type").isin("NodeAdd", "EdgeAdd") & (blank("dot_writer") | ~(F.coalesce(F.col("dot_counter"), F.lit(0)) > 0)), "bad dot")
        .when(F.col("op_type").endswith("PropSet") & blank("key"), "empty key")
        .when(F.col("key").isin("__proto__", "constructor", "prototype"), "reserved key")
        .when(~(F.col("lamport") > 0), "bad lamport")
    )
    return ops.withColumn("reason", reason).where("reason is not null")


def from_events(spark: SparkSession, sf_dir: str) -> Log:
    """A multi-writer history made of the events table: one patch per event, eight writers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    order = Window.partitionBy(F.col("user_id") % 8).orderBy("event_id")
    tenth = F.floor(F.col("user_id") / 10).cast("string")
    base = e.select(
        F.md5(F.col("event_id").cast("string")).alias("sha"),
        F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("writer"),
        F.row_number().over(order).cast("long").alias("lamport"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("item:"), F.col("k"), F.lit("."), tenth).alias("item"),
        "value",
        F.col("event_id") % 3 == 0,
    ).toDF("sha", "writer", "lamport", "kind", "user", "item", "value", "third")
    text = lambda x=None: F.lit(x).cast("string")

    def op(index, kind, node=None, edge=False, key=None, dot=False):
        return F.struct(
            F.lit(index).alias("op_index"),
            F.lit(kind).alias("op_type"),
            (F.col(node) if node else text()).alias("node"),
            (F.col("user") if edge else text()).alias("src"),
            (F.col("item") if edge else text()).alias("dst"),
            text("bought" if edge else None).alias("label"),
            text(key).alias("key"),
            text("number" if key else None).alias("value_type"),
            (F.col("value") if key else F.lit(None).cast("double")).alias("value_num"),
            text().alias("value_str"),
            (F.col("writer") if dot else text()).alias("dot_writer"),
            (F.col("lamport") if dot else F.lit(None).cast("long")).alias("dot_counter"),
            text().alias("oid"),
        )

    made = (
        F.when(F.col("kind") == "view", F.array(op(0, "NodeAdd", "item", dot=True), op(1, "NodePropSet", "item", key="seen")))
        .when(F.col("kind") == "click", F.array(op(0, "NodeAdd", "item", dot=True)))
        .when(F.col("kind") == "purchase", F.array(op(0, "EdgeAdd", edge=True, dot=True), op(1, "EdgePropSet", edge=True, key="amount")))
        .when(F.col("kind") == "signup", F.array(op(0, "NodeAdd", "user", dot=True), op(1, "NodePropSet", "user", key="score")))
        .when(F.col("third"), F.array(op(0, "NodeRemove", "item"), op(1, "EdgeRemove", edge=True)))
        .otherwise(F.array(op(0, "NodeRemove", "item")))
    )
    ops = base.select("sha", "writer", "lamport", F.col("lamport").alias("seq"), F.inline(made))
    # a removal observes the additions of its element with a smaller lamport
    target = F.coalesce("node", F.concat_ws("\x00", "src", "dst", "label"))
    dated = ["sha", "writer", "lamport", "seq"]
    adds = ops.where(F.col("op_type").isin("NodeAdd", "EdgeAdd")).select(target.alias("t"), F.col("lamport").alias("al"), "dot_writer", "dot_counter")
    removes = ops.where(F.col("op_type").isin("NodeRemove", "EdgeRemove")).select(*dated, "op_index", "op_type", target.alias("t"))
    observed = removes.join(adds, "t").where("al < lamport").select(*dated, "op_index", "op_type", "dot_writer", "dot_counter")
    base = base.withColumn("seq", F.col("lamport"))
    context = base.where("lamport > 1").select(*dated, F.col("writer").alias("ctx_writer"), (F.col("lamport") - 1).alias("ctx_counter"))
    edge_name = F.concat(F.col("user"), F.lit("->"), F.col("item"))
    touch = lambda c, kind: F.struct(c.alias("entity"), F.lit(kind).alias("kind"))
    marks = (
        F.when(F.col("kind").isin("view", "click"), F.array(touch(F.col("item"), "write")))
        .when(F.col("kind") == "purchase", F.array(touch(edge_name, "write"), touch(F.col("user"), "read"), touch(F.col("item"), "read")))
        .when(F.col("kind") == "signup", F.array(touch(F.col("user"), "write")))
        .otherwise(F.array(touch(F.col("item"), "read"), touch(F.col("item"), "write")))
    )
    wide = {"observed": observed, "context": context, "footprint": base.select(*dated, F.inline(marks))}
    narrow = (observed.select("sha", "op_index", "dot_writer", "dot_counter"), context.select("sha", "ctx_writer", "ctx_counter"), wide["footprint"].select("sha", "entity", "kind"))
    return Log(base.select(*dated), ops, *narrow, wide)
