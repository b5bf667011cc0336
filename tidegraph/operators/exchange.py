"""Exchange between replicas: frontier deltas, strands, trust, audit chains and effects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import glob
from tidegraph.operators.fold import State, fold
from tidegraph.sources.event_log import Log


def sync_delta(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(writer, need_from, need_to, send_from, send_to) of frontiers (writer, tip_sha) that differ.

    A writer that one side lacks goes one way, from nothing to its tip; tips that differ go both ways.
    """
    rows = local.select("writer", F.col("tip_sha").alias("l")).join(remote.select("writer", F.col("tip_sha").alias("r")), "writer", "full_outer")
    rows = rows.where(~F.col("l").eqNullSafe(F.col("r")))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return rows.select("writer", F.when(both, F.col("l")).alias("need_from"), F.col("r").alias("need_to"), F.when(both, F.col("r")).alias("send_from"), F.col("l").alias("send_to"))


def frontier(log: Log) -> DataFrame:
    return log.patches.groupBy("writer").agg(F.max_by("sha", "seq").alias("tip_sha"))


def sync_needed(local: DataFrame, remote: DataFrame) -> bool:
    return not sync_delta(local, remote).isEmpty()


def sync_response(log: Log, asked: DataFrame) -> DataFrame:
    """(writer, sha, seq, reason): the patches after each asked tip of (writer, tip_sha), null for all of a chain.

    A writer whose tip isn't in the chain here is skipped, with one row that says E_SYNC_DIVERGENCE.
    """
    at = log.patches.select("writer", F.col("sha").alias("tip_sha"), F.col("seq").alias("_at"))
    from_ = asked.join(at, ["writer", "tip_sha"], "left")
    good = from_.where("tip_sha is null or _at is not null").select("writer", F.coalesce("_at", F.lit(0)).alias("_at"))
    sent = log.patches.join(good, "writer").where("seq > _at").select("writer", "sha", "seq", F.lit(None).cast("string").alias("reason"))
    skipped = from_.where("tip_sha is not null and _at is null").select("writer", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("bigint").alias("seq"), F.lit("E_SYNC_DIVERGENCE").alias("reason"))
    return sent.union(skipped)


def strand(log: Log, overlay: Log, braided: list[Log], base_ceiling: int, ceiling: int | None = None) -> Log:
    """A strand's history: the base up to its pinned ceiling, braided overlays and its own, each patch once."""
    every = log.where(F.col("lamport") <= base_ceiling)
    for more in (*braided, overlay):
        every = every.union(more)
    return every if ceiling is None else every.where(F.col("lamport") <= ceiling)


def strand_state(*args, **kwargs) -> State:
    return fold(strand(*args, **kwargs))


def intent_tick(intents: DataFrame) -> DataFrame:
    """(intent_id, admitted) of (intent_id, footprint array): in order of id, those disjoint from all admitted so far.

    The rule is sequential by definition, so one strand's queue of a tick runs in one task.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for row in pdf.sort_values("intent_id").itertuples():
            mine = set(row.footprint)
            out.append(not mine & taken)
            if out[-1]:
                taken |= mine
        return pd.DataFrame({"intent_id": sorted(pdf["intent_id"]), "admitted": out})

    return intents.withColumn("_all", F.lit("all")).groupBy("_all").applyInPandas(kernel, "intent_id string, admitted boolean")


def guards(g, asked: DataFrame) -> DataFrame:
    """First failing guard of each intent: (intent_id, position, node_id, key, expected) against visible properties."""
    values = g.node_props.select("node_id", "key", F.coalesce("value_str", F.col("value_num").cast("string")).alias("actual"))
    rows = asked.join(values, ["node_id", "key"], "left").where(~F.col("actual").eqNullSafe(F.col("expected")))
    return rows.groupBy("intent_id").agg(F.min_by(F.struct("position", "node_id", "key", "expected", "actual"), "position").alias("f")).select("intent_id", "f.*")


def trust_state(records: DataFrame) -> DataFrame:
    """(kind, subject, key_id, active) after KEY_ADD, KEY_REVOKE, WRITER_BIND_ADD and WRITER_BIND_REVOKE records.

    Records are (seq, type, key_id, writer). Revocation is final: what was revoked stays so, whatever comes later.
    """
    key = F.col("type").startswith("KEY")
    rows = records.select(F.when(key, "key").otherwise("binding").alias("kind"), F.when(key, F.col("key_id")).otherwise(F.col("writer")).alias("subject"), "key_id", F.col("type").endswith("REVOKE").alias("revoked"), F.col("type").endswith("ADD").alias("added"))
    return rows.groupBy("kind", "subject", "key_id").agg((F.bool_or("added") & ~F.bool_or("revoked")).alias("active"))


def trust_eval(writers: DataFrame, state: DataFrame) -> DataFrame:
    """(writer, trusted, reason): a writer is trusted if bound to an active key."""
    keys = state.where("kind = 'key'").select("key_id", F.col("active").alias("key_active"))
    bound = state.where("kind = 'binding'").select(F.col("subject").alias("writer"), "key_id", F.col("active").alias("bound")).join(keys, "key_id", "left")
    ok = F.col("bound") & F.coalesce("key_active", F.lit(False))
    rows = bound.groupBy("writer").agg(F.bool_or(ok).alias("ok"), F.bool_or("bound").alias("any"))
    reason = F.when(F.col("ok"), "WRITER_BOUND_TO_ACTIVE_KEY").when(F.col("any"), "KEY_REVOKED_OR_UNKNOWN").when(F.col("any").isNotNull(), "BINDING_REVOKED").otherwise("WRITER_HAS_NO_BINDING")
    return writers.join(rows, "writer", "left").select("writer", F.coalesce("ok", F.lit(False)).alias("trusted"), reason.alias("reason"))


def trust_gate(evaluated: DataFrame, mode: str = "enforce") -> bool:
    """Whether a response passes: in mode enforce one untrusted writer rejects all of it."""
    return mode != "enforce" or evaluated.where("not trusted").isEmpty()


#: What the first receipt of a chain names as its predecessor.
GENESIS = "0" * 64


def audit_chain(receipts: DataFrame) -> DataFrame:
    """(chain, n, status, first_bad, gaps) of receipts (chain, seq, digest, prev): every prev must be its predecessor's digest."""
    order = Window.partitionBy("chain").orderBy("seq")
    rows = receipts.withColumns({"_want": F.coalesce(F.lag("digest").over(order), F.lit(GENESIS)), "_gap": F.col("seq") - F.lag("seq").over(order) > 1})
    bad = F.coalesce(F.col("prev") != F.col("_want"), F.lit(True))
    out = rows.groupBy("chain").agg(F.count("*").alias("n"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"), F.count_if("_gap").alias("gaps"))
    return out.select("chain", "n", F.when(F.col("first_bad").isNull(), "VALID").otherwise("BROKEN_CHAIN").alias("status"), "first_bad", "gaps")


def audit_receipts(rows: DataFrame, payload: Column) -> DataFrame:
    """(chain, seq, digest, prev) over (chain, seq) rows: the digest of each payload, and its predecessor's."""
    digest = F.sha2(F.concat_ws("|", F.col("chain").cast("string"), F.col("seq").cast("string"), payload), 256)
    order = Window.partitionBy("chain").orderBy("seq")
    made = rows.select("chain", "seq", digest.alias("digest"))
    return made.withColumn("prev", F.coalesce(F.lag("digest").over(order), F.lit(GENESIS)))


def watch(changes: DataFrame, pattern: str | list[str]) -> DataFrame:
    """Changes that a watcher of a glob hears of: a node's by its id, an edge's if either end matches."""
    if "src" in changes.columns:
        return changes.where(glob(pattern, F.col("src")) | glob(pattern, F.col("dst")))
    return changes.where(glob(pattern, F.col("node_id")))


def demux(rows: DataFrame, classify: Column, keys: list[str]) -> dict[str, DataFrame]:
    """One DataFrame per key; rows of other classes are dropped."""
    return {k: rows.where(classify == k) for k in keys}


def deliver(effects: DataFrame, mode: str = "live", suppress_external: bool = False) -> DataFrame:
    """Effects with the outcome of each: delivered, suppressed or skipped."""
    external = F.col("external") & F.lit(suppress_external)
    outcome = F.when(F.lit(mode == "inspect"), "skipped").when(F.lit(mode == "replay") | external, "suppressed").otherwise("delivered")
    return effects.withColumn("outcome", outcome)
