"""A graph's steps as flat files in the shared folder, which tasks map into memory and walk by number.

A node's number is its place in the order of its id's hash (a clash of hashes is found and another seed taken). The
files are the hashes, the ids, which nodes are starts, and for every node the numbers that its steps lead to. They are
written by range of hashes, one range a task, and then put behind each other. A file takes 4 or 8 bytes a step, so
pairs of nodes are never shuffled or written: tasks find them anew for their own origins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.shared import shared_dir

#: Origins that are walked together, and (origin, node) pairs that may be held for them; one origin may need more.
MOST_ORIGINS, MOST_PAIRS = 1 << 14, 1 << 22


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    found, path = fs.FileSystem.from_uri(uri)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(found, fs.LocalFileSystem) else found), path


def put(uri: str, parts: Iterator[bytes | memoryview | pa.Buffer | np.ndarray]) -> None:
    """Write a file whole or not at all, so that a task may run twice."""
    files, path = place(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for part in parts:
            out.write(part.tobytes() if isinstance(part, np.ndarray) else part)
    files.move(draft, path)


def get(uri: str) -> pa.Buffer:
    files, path = place(uri)
    if not files.get_file_info(path).size:  # nothing to map
        return pa.py_buffer(b"")
    with files.open_input_file(path) as f:
        return f.read_buffer(f.size())


class Compact:
    """The files of a graph of n nodes and m steps, opened where they are used."""

    def __init__(self, folder: str, n: int, m: int = 0):
        self.folder, self.n, self.m = folder, n, m
        self.width = np.int32 if n < 1 << 31 else np.int64

    def array(self, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(get(f"{self.folder}/{name}"), kind)

    def ids(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(self.n, get(f"{self.folder}/offsets"), get(f"{self.folder}/ids"))


@lru_cache(2)
def opened(folder: str, n: int, m: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """ends (n + 1), targets, ids and starts of a graph's files; a worker opens them once."""
    c = Compact(folder, n, m)
    return c.array("ends", np.int64), c.array("targets", c.width), c.ids(), np.flatnonzero(c.array("starts", np.uint8))


def compacted(steps: DataFrame, starts: DataFrame) -> Compact:
    """The files of (a, b) steps, repeats allowed, with the node_id of starts as origins."""
    spark = steps.sparkSession
    folder = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    steps = steps.where("a is not null and b is not null")

    def hashed(column: Column, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), column)

    def ranges(rows: DataFrame, write, key: str) -> list[tuple[int, int, int]]:
        """What write gives of each range of hashes: its number and two counts."""
        found = rows.withColumn("part", F.shiftrightunsigned(key, 64 - bits)).groupBy("part").applyInArrow(write, "part bigint, n bigint, clashes bigint")
        return sorted(tuple(r) for r in found.collect())

    def together(parts: list[int], copy) -> None:
        """Run a copy in one task, then delete the ranges' files."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                copy()
                yield batch

        spark.range(0, 1, 1, 1).mapInArrow(run, "id bigint").collect()
        for p in parts:
            for kind in ("hashes", "lengths", "ids", "starts", "degrees", "targets"):
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}-{kind}"), True)

    def names(table: pa.Table) -> pa.Table:
        h = table["h"].combine_chunks().to_numpy().view(np.uint64)
        order = np.argsort(h)
        ids = pa.concat_arrays([table["id"].combine_chunks().cast(pa.large_string()).take(pa.array(order))])
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        p = table["part"][0].as_py()
        put(f"{folder}/{p}-hashes", [h[order]])
        put(f"{folder}/{p}-lengths", [np.diff(at)])
        put(f"{folder}/{p}-ids", [(ids.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])]])
        put(f"{folder}/{p}-starts", [np.asarray(table["start"].combine_chunks().cast(pa.uint8()))[order]])
        clashes = int(np.sum(np.asarray(table["clash"].combine_chunks().cast(pa.uint8()))))
        return pa.table({"part": [p], "n": [len(h)], "clashes": [clashes]})

    used = steps.select(F.col("a").alias("id"), F.lit(False).alias("start")).union(steps.select("b", F.lit(False))).union(starts.select("node_id", F.lit(True)).where("node_id is not null"))
    seed = 0
    while True:
        named = used.groupBy(hashed(F.col("id"), seed).alias("h")).agg(F.min("id").alias("id"), F.max("id").alias("other"), F.max("start").alias("start"))
        found = ranges(named.select("h", "id", "start", (F.col("id") != F.col("other")).alias("clash")), names, "h")
        if not any(clashes for _, _, clashes in found):
            break
        seed += 1
    parts, n = [p for p, _, _ in found], sum(c for _, c, _ in found)
    graph = Compact(folder, n)

    def join_names() -> None:
        for kind in ("hashes", "ids", "starts"):
            put(f"{folder}/{kind}", (get(f"{folder}/{p}-{kind}") for p in parts))
        lengths = np.concatenate([np.zeros(1, np.int64), *(np.frombuffer(get(f"{folder}/{p}-lengths"), np.int64) for p in parts)])
        put(f"{folder}/offsets", [np.cumsum(lengths)])

    together(parts, join_names)
    sizes = {p: c for p, c, _ in found}
    first = dict(zip(parts, np.cumsum([0, *sizes.values()]).tolist(), strict=False))

    def lists(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        hashes = graph.array("hashes", np.uint64)
        a, b = (table[c].combine_chunks().to_numpy().view(np.uint64) for c in ("a", "b"))
        a = np.searchsorted(hashes[first[p] : first[p] + sizes[p]], a)
        order = np.argsort(b)
        number = np.empty(len(b), np.int64)
        number[order] = np.searchsorted(hashes, b[order])
        order = np.lexsort((number, a))
        a, number = a[order], number[order]
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(number) != 0)
        a, number = a[new], number[new]
        put(f"{folder}/{p}-degrees", [np.bincount(a, minlength=sizes[p]).astype(np.int64)])
        put(f"{folder}/{p}-targets", [number.astype(graph.width)])
        return pa.table({"part": [p], "n": [len(a)], "clashes": [0]})

    counted = {p: c for p, c, _ in ranges(steps.select(hashed(F.col("a"), seed).alias("a"), hashed(F.col("b"), seed).alias("b")), lists, "a")}

    def join_lists() -> None:
        degrees = (np.frombuffer(get(f"{folder}/{p}-degrees"), np.int64) if p in counted else np.zeros(sizes[p], np.int64) for p in parts)
        put(f"{folder}/ends", [np.cumsum(np.concatenate([np.zeros(1, np.int64), *degrees]))])
        put(f"{folder}/targets", (get(f"{folder}/{p}-targets") for p in parts if p in counted))

    together(parts, join_lists)
    graph.m = sum(counted.values())
    return graph


def expanded(keys: np.ndarray, n: int, ends: np.ndarray, targets: np.ndarray, most: int | None) -> np.ndarray | None:
    """The distinct sorted origin * n + node one step on from such keys; None if there are more than most before that."""
    origin, node = np.divmod(keys, n)
    low = ends[node]
    degree = ends[node + 1] - low
    total = int(degree.sum())
    if most is not None and total > most:
        return None
    upto = np.cumsum(degree)
    found = targets[np.repeat(low - upto + degree, degree) + np.arange(total)] + np.repeat(origin * n, degree)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if total else found


def missing(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Those of sorted keys that are not in sorted seen."""
    if not len(seen):
        return keys
    at = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
    return keys[seen[at] != keys]


def walked(origins: np.ndarray, n: int, ends: np.ndarray, targets: np.ndarray, most: int | None, skip: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(children, reached) as keys: reached by one or more steps from the origins, or with skip from their children."""
    children = front = expanded(np.arange(len(origins)) * n + origins, n, ends, targets, most)
    if front is not None and skip:
        front = expanded(front, n, ends, targets, most)
    seen = front
    while front is not None and len(front):
        front = expanded(front, n, ends, targets, most)
        if front is None:
            break
        front = missing(front, seen)
        seen = np.concatenate([seen, front])
        seen.sort(kind="stable")  # two sorted runs
        if most is not None and len(seen) > most:
            return None
    return None if front is None else (children, seen)


def pairs(graph: Compact, replaced: bool = False) -> DataFrame:
    """(src, dst): every pair of a start and another node with a path between them.

    With replaced, the steps alone that a longer path replaces, and (src, src) of nodes that lead back to themselves.
    """
    folder, n, m = graph.folder, graph.n, graph.m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, targets, ids, starts = opened(folder, n, m)
            for part, of in zip(batch.column("part").to_pylist(), batch.column("of").to_pylist(), strict=True):
                mine = starts[len(starts) * part // of : len(starts) * (part + 1) // of]
                mine = mine[ends[mine + 1] > ends[mine]]
                at, size = 0, MOST_ORIGINS
                while at < len(mine):
                    origins = mine[at : at + size]
                    found = walked(origins, n, ends, targets, MOST_PAIRS if len(origins) > 1 else None, replaced)
                    if found is None:
                        size = len(origins) // 2
                        continue
                    at += len(origins)
                    size = min(size * 2, MOST_ORIGINS)
                    children, seen = found
                    if replaced:
                        own = np.arange(len(origins)) * n + origins
                        seen = np.concatenate([np.intersect1d(children, seen, assume_unique=True), np.intersect1d(own, seen, assume_unique=True), np.intersect1d(own, children, assume_unique=True)])
                    for a in range(0, len(seen), 1 << 18):
                        origin, node = np.divmod(seen[a : a + (1 << 18)], n)
                        src = origins[origin]
                        if not replaced:
                            src, node = src[src != node], node[src != node]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)).cast(pa.string()) for x in (src, node)], ["src", "dst"])

    spark = SparkSession.active()
    of = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, of, 1, of).select(F.col("id").cast("int").alias("part"), F.lit(of).alias("of"))
    return rows.mapInArrow(run, "src string, dst string")
