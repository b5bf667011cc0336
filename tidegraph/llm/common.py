"""What several text operators share: shared storage, Arrow batches, word bytes and rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at once. Documents differ in length by orders of magnitude, so bytes are the bound.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of df, with these bounds on its Arrow batches, the same for all operators."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("E_NO_SHARED_FOLDER: set spark.checkpoint.dir to a folder that driver and executors share")
        found = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back; the files go with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spare(names: list[str], *wanted: str) -> list[str]:
    """Column names that none of names equals, whatever its case: the wanted ones with as many underscores as it takes."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts empty, so that other columns can't clash with derived ones."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_keys() -> tuple[Column, Column]:
    """Two numbers, of 64 and of 32 bits, that tell rows of (doc_id, text) apart; rows that repeat both are one document."""
    return F.xxhash64("doc_id", "text"), F.hash("doc_id", "text")


def in_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch."""
    session(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or those of its inverse."""
    have = _POWERS[inverse]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), INVERSE if inverse else BASE, np.uint64)
        step[0] = 1
        have = _POWERS[inverse] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any run of 64-bit values in constant time, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(n + 1, True)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def of_bytes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_VALUES[data])


_DARK = np.ones(256, np.int8)
_DARK[[0x20, 9, 10, 11, 12, 13]] = 0


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word, bytes without white space, of the rows that bounds cuts data into."""
    dark = np.zeros(len(data) + 2, np.int8)  # dark[i + 1] is that of byte i
    np.take(_DARK, data, out=dark[1:-1])
    at = np.flatnonzero(dark[1:] != dark[:-1])  # starts and ends by turns
    cut = bounds[1:-1]
    cut = cut[(dark[cut] & dark[cut + 1]) > 0]  # a word that ends where the next row's first begins
    if len(cut):
        cut = cut[np.concatenate([[True], cut[1:] != cut[:-1]])]
        at = np.insert(at, np.repeat(np.searchsorted(at, cut), 2), np.repeat(cut, 2))
    start, end = at[::2], at[1::2]
    return start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in every window of that width, the rightmost among equals."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    low, span = values, 1
    while span < width:  # by doubling: two overlapping windows make one
        step = min(span, width - span)
        left, right = slice(0, len(low) - step), slice(step, len(low))
        right_wins = low[right] <= low[left]
        at = np.where(right_wins, at[right], at[left])
        low = np.where(right_wins, low[right], low[left])
        span += step
    return at[:n]
