"""A stream of operations folds to the same state as the batch."""

from pyspark.sql import functions as F

from tests.test_history import make, seen
from tidegraph.operators import fold, visible
from tidegraph.streaming import live


def stream_rows(log):
    dots = log.observed.groupBy("sha", "op_index").agg(F.collect_list(F.struct("dot_writer", "dot_counter")).alias("observed"))
    context = log.context.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("ctx_writer", "ctx_counter"))).alias("context"))
    return log.ops.join(dots, ["sha", "op_index"], "left").join(context, "sha", "left")


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BASE_EVERY", 2)
    log, _ = make(spark, 1, 60)
    stream_rows(log).repartition(3).write.parquet(str(tmp_path / "in"))
    state, heard = str(tmp_path / "state"), []
    assert live.current(spark, state) == -1
    stream = spark.readStream.schema(live.STREAM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.subscribe(stream, state, str(tmp_path / "check"), lambda diff, n: heard.append((n, {k: d.count() for k, d in diff.items()})))
    assert query.awaitTermination(600), "the stream has not ended"
    assert query.exception() is None and heard
    assert live.current(spark, state) == 2 and (tmp_path / "state" / "base-2").exists()
    want = visible.graph(fold.fold(log))
    assert seen(visible.graph(live.state_at(spark, state))) == seen(want)
    # a later subscriber that asks for replay hears of all that is there, once, and of nothing new
    again = []
    query = live.subscribe(stream, state, str(tmp_path / "check"), lambda diff, n: again.append((n, {k: d.count() for k, d in diff.items()})), replay=True)
    assert query.awaitTermination(600) and query.exception() is None
    assert again == [(2, {"nodes": want.nodes.count(), "edges": want.edges.count(), "node_props": want.node_props.count()})]
