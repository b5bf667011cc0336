"""Incremental folds over streams of patches, and the subscriptions that hang on them.

The fold doesn't depend on order, so late patches need no watermark. Each micro-batch is folded by itself into cells
and written once, as a table of its own; the state is the join of a base with the tables after it, and every BASE_EVERY
batches a new base is written. The work of a batch thus grows with the batch and not with the state, but for the base,
and for the diff where somebody listens. A batch that is replayed after a failure writes its table anew with the same
content; the table `current` names the last batch that is whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.operators import history, visible
from tidegraph.operators.fold import CELL, VALUE_TYPE, State, entries, folded, joined, state_of
from tidegraph.sources.event_log import OPS, Log
from tidegraph.sources.shared import written
from tidegraph.sources.star_graph import Graph

#: One row of a patch stream: an operation with the dots that it observed, and the patch's context.
STREAM = OPS + ", observed array<struct<dot_writer:string,dot_counter:bigint>>, context map<string,bigint>"


def log_of(rows: DataFrame) -> Log:
    """The log that a batch of stream rows holds; operations delivered twice count once."""
    once = rows.dropDuplicates(["sha", "op_index"])
    patches = once.select("sha", "writer", "lamport", "seq").distinct()
    names = [c.split()[0] for c in OPS.split(", ")]
    observed = once.select("sha", "op_index", F.inline("observed"))
    context = once.select("sha", F.explode("context").alias("ctx_writer", "ctx_counter")).distinct()
    footprint = once.select("sha", F.coalesce("node", F.concat_ws("->", "src", "dst")).alias("entity"), F.lit("write").alias("kind")).where("entity is not null")
    return Log(patches, once.select(*names), observed, context, footprint)


#: Batches from one base of the state to the next.
BASE_EVERY = 16


def cells_at(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The state's cells after a batch, -1 for none: the base before it, joined with the batches since."""
    base = max(number, 0) // BASE_EVERY * BASE_EVERY
    tables = [f"{path}/base-{base}"] if base else []
    tables += [f"{path}/batch-{n}" for n in range(base, number + 1)]
    if not tables:
        return spark.createDataFrame([], f"{CELL}, held_0 boolean, value_0 {VALUE_TYPE}")
    found = [spark.read.schema(f"{CELL}, held_0 boolean, value_0 {VALUE_TYPE}").parquet(t) for t in tables]
    return found[0] if len(found) == 1 else joined(*found)


def current(spark: SparkSession, path: str) -> int:
    """The last batch that is whole; -1 before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return -1
    return spark.read.parquet(f"{path}/current").first()["number"]


def state_at(spark: SparkSession, path: str, number: int | None = None) -> State:
    """The state after a batch, the last whole one by default."""
    return state_of(cells_at(spark, path, current(spark, path) if number is None else number))


def differences(spark: SparkSession, before: DataFrame, after: DataFrame) -> dict[str, DataFrame] | None:
    """The diff of two states' cells, written once; None if there is none."""
    parts = history.state_diff(visible.settled(before), visible.settled(after))
    names = ("node_id", "src", "dst", "label", "key", "before", "after", "change")
    rows = [d.select(F.lit(part).alias("part"), *(F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in names)) for part, d in parts.items()]
    found = written(reduce(DataFrame.unionByName, rows), "diff")
    if found.isEmpty():
        return None
    return {part: found.where(F.col("part") == part).select(*d.columns) for part, d in parts.items()}


def subscribe(
    rows: DataFrame, path: str, checkpoint: str, on_change: Callable[[dict[str, DataFrame], int], None] | None = None, replay: bool = False, **trigger
) -> StreamingQuery:
    """Fold a stream of operations into the state under path; on_change gets the diff of each batch that has one.

    With replay it first gets what is there already, as the diff from an empty state, under the last whole batch's number.
    """
    spark = rows.sparkSession

    def tell(start: int, number: int) -> None:
        diff = differences(spark, cells_at(spark, path, start), cells_at(spark, path, number))
        if diff:
            on_change(diff, number)

    def each(batch: DataFrame, number: int) -> None:
        folded(entries(log_of(batch))).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if number and number % BASE_EVERY == 0:
            cells_at(spark, path, number - 1).write.mode("overwrite").parquet(f"{path}/base-{number}")
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}/current")
        if on_change:
            tell(number - 1, number)

    if replay and on_change and current(spark, path) >= 0:
        tell(-1, current(spark, path))
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(g: Graph, diff: dict[str, DataFrame], pattern: str) -> dict[str, DataFrame]:
    """The parts of a diff that a watcher of a glob hears of."""
    from tidegraph.operators.exchange import watch as heard

    return {part: heard(rows, pattern) for part, rows in diff.items()}


def mux(*streams: DataFrame) -> DataFrame:
    """Several streams as one, in the order of arrival."""
    return reduce(DataFrame.unionByName, streams)


def fan_out(rows: DataFrame, routes: dict[str, tuple[Column, Callable[[DataFrame], None]]], checkpoint: str) -> StreamingQuery:
    """Each batch to every sink whose condition its rows meet; the batch is held once for all of them."""

    def each(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        for condition, sink in routes.values():
            sink(held.where(condition))
        held.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
