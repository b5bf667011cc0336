"""Outcomes of operations, conflicts between writers, and three-way merges.

What an operation did depends on the order of replay: live replay goes writer by writer, causal replay by lamport
time. Both are window functions over the log, partitioned by what an operation touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.fold import EDGE, VALUE
from tidegraph.sources.event_log import Log, event_id, lowered


def order_of(replay: str) -> Column:
    return F.struct("writer", "seq", "op_index") if replay == "live" else F.struct("lamport", "writer", "sha", "op_index")


def target() -> Column:
    edge = F.concat_ws("|", *EDGE)
    prop = F.concat_ws("|", F.coalesce("node", edge), "key")
    return F.when(F.col("op_type").endswith("PropSet"), prop).when(F.col("op_type").startswith("Edge"), edge).otherwise(F.coalesce("node", F.lit("*")))


def prop_receipts(log: Log, replay: str = "live") -> DataFrame:
    """(sha, op_index, target, result, reason) of property sets: applied, superseded or redundant."""
    sets = lowered(log.ops).where(F.col("op_type").isin("NodePropSet", "EdgePropSet"))
    before = Window.partitionBy("target").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = sets.select("sha", "op_index", "writer", "lamport", *VALUE, target().alias("target"), order_of(replay).alias("ord"), event_id().alias("at"))
    rows = rows.withColumn("top", F.max("at").over(before))
    result = F.when(F.col("top").isNull() | (F.col("at") > F.col("top")), "applied").when(F.col("at") < F.col("top"), "superseded").otherwise("redundant")
    reason = F.when(F.col("at") < F.col("top"), F.concat(F.lit("LWW: writer "), F.col("top.writer"), F.lit(" at lamport "), F.col("top.lamport").cast("string"), F.lit(" wins")))
    return rows.select("sha", "op_index", "target", result.alias("result"), reason.alias("reason"), "writer", "lamport", *VALUE, "ord", "at")


def add_receipts(log: Log, replay: str = "live") -> DataFrame:
    """Additions: redundant if the same element and dot was added before."""
    adds = lowered(log.ops).where(F.col("op_type").isin("NodeAdd", "EdgeAdd"))
    rows = adds.select("sha", "op_index", target().alias("target"), "dot_writer", "dot_counter", order_of(replay).alias("ord"))
    first = F.row_number().over(Window.partitionBy("target", "dot_writer", "dot_counter").orderBy("ord")) == 1
    return rows.select("sha", "op_index", "target", F.when(first, "applied").otherwise("redundant").alias("result"), F.lit(None).cast("string").alias("reason"))


def remove_receipts(log: Log, replay: str = "live") -> DataFrame:
    """Removals: applied if some observed dot was added before and not yet removed."""
    ops = lowered(log.ops)
    family = F.when(F.col("op_type").startswith("Node"), "n").otherwise("e").alias("family")
    adds = ops.where(F.col("op_type").isin("NodeAdd", "EdgeAdd")).select(family, "dot_writer", "dot_counter", order_of(replay).alias("born"))
    born = adds.groupBy("family", "dot_writer", "dot_counter").agg(F.min("born").alias("born"))
    removes = ops.where(F.col("op_type").isin("NodeRemove", "EdgeRemove")).select("sha", "op_index", family, target().alias("target"), order_of(replay).alias("ord"))
    dots = removes.join(log.observed, ["sha", "op_index"], "left").join(born, ["family", "dot_writer", "dot_counter"], "left")
    earlier = F.min("ord").over(Window.partitionBy("family", "dot_writer", "dot_counter"))
    hit = (F.col("born") < F.col("ord")) & (earlier == F.col("ord"))
    # a removal that came before the addition has removed the dot already
    judged = dots.withColumn("hit", F.coalesce(F.when(F.col("dot_counter").isNotNull(), hit), F.lit(False)))
    done = judged.groupBy("sha", "op_index", "target").agg(F.bool_or("hit").alias("hit"))
    return done.select("sha", "op_index", "target", F.when(F.col("hit"), "applied").otherwise("redundant").alias("result"), F.lit(None).cast("string").alias("reason"))


def receipts(log: Log, replay: str = "live") -> DataFrame:
    """(sha, op_index, target, result, reason) of every operation."""
    names = ["sha", "op_index", "target", "result", "reason"]
    blobs = log.ops.where("op_type = 'BlobValue'").select("sha", "op_index", F.coalesce("node", F.lit("*")).alias("target"), F.lit("applied").alias("result"), F.lit(None).cast("string").alias("reason"))
    return prop_receipts(log, replay).select(*names).union(add_receipts(log, replay).select(*names)).union(remove_receipts(log, replay)).union(blobs)


def supersessions(log: Log) -> DataFrame:
    """(target, loser, winner): property sets that live replay superseded, with what holds at the end."""
    rows = prop_receipts(log)
    last = rows.groupBy("target").agg(F.max_by("sha", "at").alias("winner"))
    return rows.where("result = 'superseded'").select("target", F.col("sha").alias("loser")).join(last, "target")


def eventual_overrides(log: Log) -> DataFrame:
    """(target, loser, winner, relation): applied sets whose value another writer's final one replaced.

    ordered: the winner's context covers the loser's lamport, or the other way about; else concurrent.
    """
    digest = F.sha2(F.concat_ws("|", "value_type", F.coalesce(F.col("value_num").cast("decimal(20,4)").cast("string"), F.col("value_str"))), 256)
    rows = prop_receipts(log).where("result = 'applied'").withColumn("digest", digest)
    last = rows.groupBy("target").agg(F.max_by(F.struct("sha", "writer", "digest", "lamport"), "at").alias("w"))
    odd = rows.join(last, "target").where((F.col("sha") != F.col("w.sha")) & (F.col("writer") != F.col("w.writer")) & (F.col("digest") != F.col("w.digest")))
    seen = log.context.select(F.col("sha").alias("_s"), F.col("ctx_writer").alias("_w"), F.col("ctx_counter").alias("_c"))
    by_winner = odd.join(seen, (F.col("w.sha") == F.col("_s")) & (F.col("writer") == F.col("_w")) & (F.col("_c") >= F.col("lamport")), "left").drop("_s", "_c").withColumn("_a", F.col("_w").isNotNull()).drop("_w")
    by_loser = by_winner.join(seen, (F.col("sha") == F.col("_s")) & (F.col("w.writer") == F.col("_w")) & (F.col("_c") >= F.col("w.lamport")), "left")
    ordered = F.col("_a") | F.col("_w").isNotNull()
    return by_loser.select("target", F.col("sha").alias("loser"), F.col("w.sha").alias("winner"), F.when(ordered, "ordered").otherwise("concurrent").alias("relation"))


def redundancies(log: Log) -> DataFrame:
    """(target, sha): operations that a receipt calls redundant and whose effect an earlier one had."""
    return receipts(log).where("result = 'redundant' and target <> '*'").select("target", "sha")


def merge3(precursor: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, base, l, r, outcome, value) of three records (key, value): changed keys alone; null deletes.

    Both sides changing a key to unequal values is an obstruction; anything else joins.
    """
    both = precursor.select("key", F.col("value").alias("base")).join(left.select("key", F.col("value").alias("l")), "key", "full_outer")
    rows = both.join(right.select("key", F.col("value").alias("r")), "key", "full_outer")
    l_new, r_new = ~F.col("l").eqNullSafe(F.col("base")), ~F.col("r").eqNullSafe(F.col("base"))
    clash = l_new & r_new & ~F.col("l").eqNullSafe(F.col("r"))
    value = F.when(clash, F.lit(None)).when(l_new, F.col("l")).otherwise(F.col("r"))
    return rows.where(l_new | r_new).select("key", "base", "l", "r", F.when(clash, "obstruction").otherwise("join").alias("outcome"), value.alias("value"))


def classify(cases: DataFrame) -> DataFrame:
    """(…, class, confidence) of merges with boolean columns policy, joins, lowering and obstructed."""
    kind = F.when(F.col("policy"), "governance").when(F.col("joins"), "projection").otherwise("semantic")
    sure = F.col("policy") | (F.col("joins") & F.col("lowering")) | (~F.col("joins") & F.col("obstructed"))
    return cases.withColumns({"class": kind, "confidence": F.when(sure, "high").otherwise("medium")})
