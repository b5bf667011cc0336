"""Suffix-array dedup of bytes by merging Burrows-Wheeler transforms.

Which suffixes can share LENGTH bytes is settled first, so that unique text never reaches a transform: every window of
LENGTH bytes has one anchor, the smallest hash of its grams, and the windows of an anchor form a record of contiguous
text. Equal windows have equal anchors. Anchors that occur once are unique text; where all records of an anchor are
the same text, all of it is repeated. The records of the other anchors go to transforms, dealt out by anchor, equal
records as one. An anchor with more than about MOST_RECORDS different records (judged by the smallest and the largest
of their hashes) would fill a task: its windows are counted one by one, by anchor and hash, in a shuffle of their own.

In a transform a record's bytes are read in blocks of BLOCK bytes at each phase, one symbol a block. Blocks that occur
once end all suffixes that hold them. Records form shards; each shard's suffixes are ordered once and give its
transform, the symbol before each suffix in that order. Shards are then merged without sorting suffixes again: the
interleave (which shard the next suffix comes from) is refined by one symbol an iteration, by a stable distribution of
the transforms' symbols, as in the merge of Holt and McMillan. The iteration that parts a suffix from both neighbours
gives its common prefix in symbols, and it leaves the interleave, since whatever stands before it is parted as well;
after LENGTH / BLOCK iterations the suffixes that are still there share LENGTH bytes with a neighbour: the repeats.

Texts are shuffled once, by row; the exchange serves both the search and the removal. A record that occurs often is
one row per batch in the shuffle by anchor.

Defined cases: a null or empty text has no bytes; matches never cross rows; every row is a document, so rows that
repeat are each other's repeats; a text of less than LENGTH bytes is kept; an empty table gives an empty table; columns
named as the results are replaced, all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_arrow, mix, of_bytes, raw, row_keys, session, written

LENGTH, GRAM, BLOCK = 200, 32, 25
#: Bytes of one shard, and of the records that are merged together (more only where one anchor has more).
SHARD_BYTES, MERGE_BYTES = 1 << 15, 1 << 21
#: Different records, about, of one anchor that go to one task; the windows of anchors with more are counted by hash.
MOST_RECORDS = 1 << 12
#: How the records of an anchor are judged.
SAME, MERGED, COUNTED = 0, 1, 2
_ROW = np.uint64(0x9E3779B97F4A7C15)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest upper half in every window of that width, the rightmost among equals, so that equal windows agree."""
    low = values & np.uint64(0xFFFFFFFF00000000)
    assert len(low) <= 1 << 32, "positions take the lower half"
    low |= np.arange(len(low) - 1, -1, -1, dtype=np.uint64)
    span = 1
    while span < width:  # by doubling: two overlapping windows make one
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    low &= np.uint64(0xFFFFFFFF)
    return len(values) - 1 - low.view(np.int64)


class Records:
    """Anchors of a batch of texts: their hashes, rows, first and last windows, and the hashes of their records."""

    def __init__(self, column: pa.Array, length: int, gram: int):
        self.data, self.bounds = raw(column)
        self.length = length
        none = np.zeros(0, np.int64)
        self.row = self.first = self.last = none
        self.hash = self.record = np.zeros(0, np.uint64)
        if len(self.data) < length:
            return
        rolling = of_bytes(self.data)
        grams = rolling.sums[gram:] - rolling.sums[:-gram]
        grams *= rolling.inverse[: len(grams)]
        anchor = least(grams, length - gram + 1)
        # windows inside their rows, and of them those whose anchor is not the one before's
        sizes = np.diff(self.bounds)
        inside = np.maximum(sizes - length + 1, 0)
        new = np.ones(len(self.data), bool)
        new[1 : len(anchor)] = anchor[1:] != anchor[:-1]
        new[self.bounds[:-1][inside > 0]] = True
        new &= np.repeat(np.tile([True, False], len(sizes)), np.stack([inside, sizes - inside], 1).ravel())
        self.first = np.flatnonzero(new)
        if not len(self.first):
            return
        self.row = np.searchsorted(self.bounds, self.first, "right") - 1
        self.last = self.bounds[self.row + 1] - length
        same = np.flatnonzero(self.row[1:] == self.row[:-1])
        self.last[same] = self.first[same + 1] - 1
        anchor = anchor[self.first]
        self.hash = mix(grams[anchor] + np.uint64(gram))
        self.record = mix(rolling.of(self.first, self.last + length) + (anchor - self.first).astype(np.uint64))

    def named(self) -> np.ndarray:
        return mix(self.hash + (self.row + 1).astype(np.uint64) * _ROW)


def seeds(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, record, key, more): the anchors of (text, key, more) rows."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = Records(batch.column("text"), length, gram)
        keys = [batch.column(c).take(pa.array(r.row)) for c in ("key", "more")]
        return pa.RecordBatch.from_arrays([pa.array(r.hash.view(np.int64)), pa.array(r.record.view(np.int64)), *keys], ["h", "record", "key", "more"])

    return in_arrow(docs, each, "h bigint, record bigint, key bigint, more int")


# -- transforms ------------------------------------------------------------------------------------------------------


def distribute(symbols: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers, by two radix passes of 16 bits."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and symbols.max() > 0xFFFF:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def chains(blocks: np.ndarray, depth: int, block: int) -> np.ndarray:
    """Which places begin or lie on, at their phase, a chain of `depth` such blocks."""
    whole = blocks.copy()
    for d in range(1, depth):
        whole[: -d * block] &= blocks[d * block :]
        whole[-d * block :] = False
    found = whole.copy()
    for d in range(1, depth):
        found[d * block :] |= whole[: -d * block]
    return found


def repeated_starts(bodies: list[bytes], length: int, block: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(first, flags): flags says for every byte of the concatenated bodies, body i from first[i], whether the `length`
    bytes from there occur at another place too; each body holds its own empty suffix at its end."""
    depth = length // block
    sizes = np.array([len(b) + 1 for b in bodies])
    ends = np.cumsum(sizes)
    first = ends - sizes
    data = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
    n = len(data)
    flags = np.zeros(n, bool)
    inside = np.zeros(n, bool)
    inside[: n - block] = np.repeat(ends, sizes)[: n - block] > np.arange(block, n)
    if n <= length:
        return first, flags
    # blocks that may occur twice, by a table of counts, then those that do; the symbol of a block is the rank of its hash
    rolling = of_bytes(data)
    hashes = np.zeros(n, np.uint64)
    np.subtract(rolling.sums[block:n], rolling.sums[: n - block], out=hashes[: n - block])
    hashes[: n - block] *= rolling.inverse[: n - block]
    del rolling
    hashes[: n - block] = mix(hashes[: n - block] + np.uint64(block))
    slot = (hashes >> np.uint64(42)).astype(np.int32)
    inside &= np.bincount(slot[inside], minlength=1 << 22)[slot] > 1
    at = np.flatnonzero(chains(inside, depth, block))
    _, ranks, counts = np.unique(hashes[at], return_inverse=True, return_counts=True)
    del hashes, slot
    inside[:] = False
    inside[at] = counts[ranks] > 1
    live = chains(inside, depth, block)
    symbol = np.zeros(n, np.int32)  # a task's records are far below 2 GB, and so are all numbers here
    symbol[at] = ranks + 1
    symbol[~live] = 0
    at = np.flatnonzero(live)
    if not len(at):
        return first, flags
    before = np.zeros(n + block, np.int32)  # the symbol before each place, 0 at the start of a phase
    before[block:] = symbol

    # each shard's suffixes in order, and from it the shard's transform
    shard = (first // shard_bytes)[np.searchsorted(first, at, "right") - 1]
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0])), [len(at)]])
    ahead = np.concatenate([symbol, np.zeros(length, np.int32)])
    suffixes = np.empty(len(at), np.int32)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        order = at[a:b]
        low = order[0]
        own = ahead[low : order[-1] + length]
        own = np.searchsorted(np.unique(own), own)  # the shard's own symbols, 0 for none: narrow numbers sort fast
        for d in range(depth - 1, -1, -1):
            order = order[distribute(own[order - low + d * block])]
        suffixes[a:b] = order
    transform = before[suffixes]
    place = np.empty(n, np.int32)
    place[suffixes] = np.arange(len(at))

    # interleave refinement: source is the shard of each suffix that is still together with a neighbour
    shards = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)).astype(np.uint16)
    letters = symbol[suffixes]
    order = distribute(letters)
    parted = np.concatenate([[True], np.diff(letters[order]) != 0])
    found = order
    for step in range(depth):
        if step:
            taken = np.empty(len(source), np.int64)
            taken[np.argsort(source, kind="stable")] = np.flatnonzero(left)  # the next suffix of each shard, in the shard's order
            letters = transform[taken]
            has = np.flatnonzero(letters)
            order = has[distribute(letters[has])]
            parted = np.ones(len(order), bool)
            parted[1:] = (np.diff(letters[order]) != 0) | (np.diff(group[order]) != 0)
            found = place[suffixes[taken[order]] - block]
        together = ~(parted & np.concatenate([parted[1:], [True]]))
        group = np.cumsum(parted)[together]
        found = found[together]
        source = shards[found]
        left = np.zeros(len(at), bool)
        left[found] = True
        if not len(found):
            break
    flags[suffixes[found]] = True
    return first, flags


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def merged(records: DataFrame, length: int, block: int) -> DataFrame:
    """(h, record, a, b): runs of repeated windows, from and to, of every distinct record of (deal, h, record, n, body) rows.

    A row without a body stands for one window, record its hash, which is repeated if it is there twice.
    """
    spark = session(records)
    schema = "h bigint, record bigint, a int, b int"
    names_ = ["h", "record", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int]] = []
        bodies: list[bytes] = []
        often: list[bool] = []
        held = 0
        window, times = None, 0
        windows: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            first, flags = repeated_starts(bodies, length, block)
            for i, many in enumerate(often):
                if many:
                    flags[first[i] : first[i] + len(bodies[i]) - length + 1] = True
            a, b = runs(flags)
            owner = np.searchsorted(first, a, "right") - 1
            h, record = (np.array([x[k] for x in names], np.int64)[owner] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(record), pa.array((a - first[owner]).astype(np.int32)), pa.array((b - first[owner]).astype(np.int32))], names_)

        def counted() -> pa.RecordBatch:
            h, record = np.array(windows, np.int64).reshape(-1, 2).T
            none = pa.array(np.zeros(len(h), np.int32))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(record), none, none], names_)

        for batch in batches:
            for h, record, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    times = times + n if window == (h, record) else n
                    if times > 1 and times - n <= 1:
                        windows.append((h, record))
                    window = (h, record)
                    continue
                if names and names[-1] == (h, record):
                    often[-1] = True
                    continue
                if held >= MERGE_BYTES and names[-1][0] != h:
                    yield flush()
                    names, bodies, often, held = [], [], [], 0
                names.append((h, record))
                bodies.append(body)
                often.append(n > 1)
                held += len(body)
            if windows:
                yield counted()
                windows = []
        if names:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.repartition(parts, "deal").sortWithinPartitions("deal", "h", "record").select("h", "record", "n", "body")
    return dealt.mapInArrow(run, schema)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, most_records: int = MOST_RECORDS) -> DataFrame:
    """(key, more, spans) of rows with text, key and more: array<struct<first, last>> of repeated windows' first bytes."""
    assert length % block == 0
    found = seeds(docs.select("text", "key", "more"), length, gram)
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.min("record").alias("r0"), F.max("record").alias("r1"))
    # d hashes leave about 2 / (d + 1) of all numbers outside their smallest and their largest
    outside = (F.col("r0") - F.lit(-(1 << 63)).cast("double")) + (F.lit(float(1 << 63)) - F.col("r1"))
    kind = F.when(F.col("r0") == F.col("r1"), SAME).when(outside * most_records < float(1 << 65), COUNTED).otherwise(MERGED)
    shared = written(shared.where("n > 1").select("h", kind.alias("kind")), "anchors")
    wanted = found.select("h", "key", "more").join(shared, "h").groupBy("key", "more").agg(F.collect_set(F.struct("h", "kind")).alias("anchors"))
    joined = docs.join(wanted, ["key", "more"])  # all columns, so that its exchange is that of the removal

    def chosen(batch: pa.RecordBatch) -> tuple[Records, list[np.ndarray]]:
        r = Records(batch.column("text"), length, gram)
        lists = batch.column("anchors")
        owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        flat = lists.flatten()
        name = mix(np.asarray(flat.field("h"), np.int64).view(np.uint64) + (owner + 1).astype(np.uint64) * _ROW)
        kinds = np.asarray(flat.field("kind"))
        mine = r.named()
        return r, [np.isin(mine, name[kinds == k]) for k in (SAME, MERGED, COUNTED)]

    def windows(r: Records, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(record, first byte, hash) of each window of these records."""
        n = (r.last - r.first + 1)[part]
        owner = np.repeat(np.flatnonzero(part), n)
        at = r.first[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return owner, at, of_bytes(r.data).of(at, at + length) if len(at) else np.zeros(0, np.uint64)

    def occurrences(batch: pa.RecordBatch) -> pa.RecordBatch:
        r, (same, part, single) = chosen(batch)
        owner, at, hashes = windows(r, single)
        use = np.flatnonzero(same | part)
        record = np.concatenate([use, owner])
        first = np.concatenate([r.first[use], at]) - r.bounds[r.row[record]]
        last = np.concatenate([r.last[use], at]) - r.bounds[r.row[record]]
        name = np.concatenate([r.record[use], hashes])
        keys = [batch.column(c).take(pa.array(r.row[record])) for c in ("key", "more")]
        columns = [first.astype(np.int32), last.astype(np.int32), r.hash[record].view(np.int64), name.view(np.int64), np.concatenate([same[use], np.zeros(len(at), bool)])]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], ["key", "more", "first", "last", "h", "record", "same"])

    def bodies(batch: pa.RecordBatch) -> pa.RecordBatch:
        r, (_, part, single) = chosen(batch)
        owner, at, hashes = windows(r, single)
        use = np.flatnonzero(part)
        h = np.concatenate([r.hash[use], r.hash[owner]]).view(np.int64)
        record = np.concatenate([r.record[use], hashes]).view(np.int64)
        alone = np.arange(len(h)) >= len(use)
        pairs, index, n = np.unique(np.stack([alone.astype(np.int64), h, record], 1), axis=0, return_index=True, return_counts=True)
        data, index = r.data.tobytes(), index[pairs[:, 0] == 0]
        texts_ = [data[a:b] for a, b in zip(r.first[use[index]].tolist(), (r.last[use[index]] + length).tolist(), strict=True)]
        deal = np.where(pairs[:, 0] == 0, pairs[:, 1], pairs[:, 1] ^ pairs[:, 2])
        columns = [pa.array(deal), pa.array(pairs[:, 1]), pa.array(pairs[:, 2]), pa.array(n), pa.array(texts_ + [None] * (len(n) - len(texts_)), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["deal", "h", "record", "n", "body"])

    spots = in_arrow(joined, occurrences, "key bigint, more int, first int, last int, h bigint, record bigint, same boolean")
    intervals = merged(in_arrow(joined, bodies, "deal bigint, h bigint, record bigint, n bigint, body binary"), length, block)
    judged = spots.join(intervals, ["h", "record"], "left").where("same or a is not null")
    start, stop = (F.when(F.col("same"), F.col(c)).otherwise(F.col("first") + F.col(x)) for c, x in (("first", "a"), ("last", "b")))
    return judged.groupBy("key", "more").agg(F.collect_set(F.struct(start.alias("first"), stop.alias("last"))).alias("spans"))


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, cleaned: bool = False, most_records: int = MOST_RECORDS) -> DataFrame:
    """docs with kept_bytes, n_bytes, n_removed and n_spans; columns of these names are replaced.

    With cleaned, docs alone: its text is what is kept (bytes of split characters go too), and n_chars, if there, is renewed.
    """
    added = ["kept_bytes", "n_bytes", "n_removed", "n_spans"]
    names = [c for c in docs.columns if cleaned or c.lower() not in added]
    inner = [f"c{i}" for i in range(len(names))]  # the caller's columns go by numbers, so that none can clash
    at = {n.lower(): i for i, n in enumerate(names)}
    text = inner[at["text"]]
    rows = docs.select(*(F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)))
    named = rows.withColumns({"text": F.coalesce(F.col(text), F.lit("")), "doc_id": F.col(inner[at["doc_id"]])})
    keyed = named.withColumns(dict(zip(("key", "more"), row_keys(), strict=True))).drop("doc_id")
    keyed = keyed.select(*(c for c in inner if c != text), "text", F.col(text).isNull().alias("none"), "key", "more")
    order = [c if c != text else "text" for c in inner]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, kept_texts = [], []
        none = batch.column("none").to_pylist()
        lists = batch.column("spans").fill_null([])
        ends = np.asarray(lists.offsets, np.int64)
        firsts, lasts = (np.asarray(lists.values.field(c), np.int64) for c in ("first", "last"))
        for k, said in enumerate(batch.column("text").to_pylist()):
            low, high = ends[k], ends[k + 1]
            spans = high > low
            data = said.encode("utf-8", "surrogatepass")
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, firsts[low:high], 1)
            np.add.at(cover, lasts[low:high] + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
            out.append((kept, len(data), len(data) - len(kept), len(runs(gone)[0])))
            kept_texts.append(None if none[k] else kept.decode("utf-8", "ignore") if spans else said)
        columns = [batch.column(c) if c != "text" else pa.array(kept_texts if cleaned else [t if not x else None for t, x in zip(batch.column(c).to_pylist(), none, strict=True)], pa.string()) for c in order]
        if cleaned:
            return pa.RecordBatch.from_arrays(columns, inner)
        more = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *more], [*inner, *added])

    joined = keyed.join(repeated(keyed, length, gram, block, most_records), ["key", "more"], "left").select(*order, "none", "spans")
    shape = rows if cleaned else rows.withColumns({"kept_bytes": F.lit(b""), **{c: F.lit(0).cast("long") for c in added[1:]}})
    done = in_arrow(joined, each, shape.schema)
    back = done.select(*(F.col(i).alias(n) for i, n in zip(inner, names, strict=True)), *(() if cleaned else added))
    if not cleaned or "n_chars" not in at:
        return back
    kind, n_chars = docs.schema[names[at["n_chars"]]].dataType, names[at["n_chars"]]
    return back.withColumn(n_chars, F.when(F.col("text").isNull(), F.col(n_chars)).otherwise(F.length("text").cast(kind)))
