"""SimHash near-duplicates by anchor-point covering.

Two fingerprints link at four or fewer differing bits. The 64 bits are cut into three blocks with d1, d2 and d3 of
them. Then d1 + d2 <= 2, or d3 <= 1 and one of the first two blocks, i, has di + d3 <= 2. Each block has a covering
code: every value lies within its covering radius R of a code word, its anchor. For each pair of blocks a fingerprint
stands once at its own pair of anchors, and is replicated to every pair of anchors within R + e and R + e' for the
(e, e') that these bounds leave. By the triangle inequality one of the three places then holds both ends of a link,
and only fingerprints at one place are compared. A fingerprint has about 210 places, whatever the number of texts.

Equal fingerprints are one before any of this, so copies cost nothing. The places are dealt out by a shuffle and
sorted; a place's links are reduced to a spanning forest there and then, so a group of m near copies gives m - 1 links
and not all pairs. Components come from alternating large-star and small-star rounds over written tables.

Blocks of 23 bits use the perfect binary Golay code (radius 3, one anchor within it); the block of 18 bits uses a
Hamming code of length 15 and three plain bits (radius 1). Tables are built from generator polynomials by enumeration.

Defined cases: a null text has no words and fingerprint zero, like any text without words, and links as any other;
fewer than four words are one shingle; a bit that is set in exactly half of the shingles is 0; repeated rows and equal
texts share a fingerprint; a null doc_id never names a component unless all its members are null; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_arrow, session, spare, strings, texts, written

SHINGLE, SEED, THRESHOLD = 4, 42, 4


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and white space 09-0D and 20 alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer; and what `also` derives from doc_id and text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in strings(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    rows = texts(docs).select("*", *also)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return in_arrow(rows, each, ", ".join([fields[0], "fp bigint", *fields[1:]]))


# -- covering codes --------------------------------------------------------------------------------------------------


class Code:
    """A linear block code; knows for each coset the error patterns up to its covering radius and `extra` beyond.

    The basis words have the leading bits bits-1, bits-2, ..., so dividing by them leaves the number of the coset.
    """

    def __init__(self, bits: int, basis: list[int], extra: int):
        self.bits, self.basis = bits, sorted(basis, reverse=True)
        assert [w.bit_length() for w in self.basis] == list(range(bits, bits - len(basis), -1))
        cosets = 1 << (bits - len(basis))
        self.leader = np.full(cosets, -1, np.int64)
        shells, weight, self.radius = [], 0, None
        while self.radius is None or weight <= self.radius + extra:
            errors = np.array([sum(1 << i for i in c) for c in combinations(range(bits), weight)], np.int64)
            coset = self.coset(errors)
            new, at = np.unique(coset, return_index=True)
            self.leader[new] = np.where(self.leader[new] < 0, errors[at], self.leader[new])
            shells.append((errors, coset))
            if self.radius is None and (self.leader >= 0).all():
                self.radius = weight
            weight += 1
        near = [np.concatenate(x) for x in zip(*shells[: self.radius + 1], strict=True)]
        self.patterns = []
        for errors, coset in [near, *shells[self.radius + 1 :]]:
            by = np.argsort(coset, kind="stable")
            self.patterns.append((errors[by], np.searchsorted(coset[by], np.arange(cosets + 1))))

    def coset(self, value: np.ndarray) -> np.ndarray:
        for i, word in enumerate(self.basis):
            value = np.where(value >> (self.bits - 1 - i) & 1, value ^ word, value)
        return value

    def home(self, value: np.ndarray) -> np.ndarray:
        """The anchor of each value, within the covering radius."""
        return value ^ self.leader[self.coset(value)]

    def around(self, value: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for each anchor in the e-th shell beyond the covering radius (0: within it)."""
        patterns, cuts = self.patterns[e]
        coset = self.coset(value)
        n = cuts[coset + 1] - cuts[coset]
        row = np.repeat(np.arange(len(value)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cuts[coset], n)
        return row, value[row] ^ patterns[at]


@lru_cache(1)
def codes() -> tuple[tuple[Code, int], ...]:
    """(code, lowest bit) of the three blocks."""
    golay = Code(23, [0b101011100011 << i for i in range(12)], 2)  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    hamming = Code(18, [1 << 15, 1 << 16, 1 << 17, *(0b10011 << i for i in range(11))], 1)  # x^4 + x + 1, and three bits
    return ((golay, 0), (golay, 23), (hamming, 46))


def placed(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, fingerprint, own): each fingerprint at its own places and at all that it has to visit."""
    bits = fps.view(np.uint64)
    blocks = [((bits >> np.uint64(low)) & np.uint64((1 << code.bits) - 1)).astype(np.int64) for code, low in codes()]
    places, rows, own = [], [], []
    everyone = np.arange(len(fps))
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (one, _), (two, _) = codes()[i], codes()[j]
        name = np.int64(pair << 46)
        places.append(name | one.home(blocks[i]) << 23 | two.home(blocks[j]))
        rows.append(everyone)
        own.append(np.ones(len(fps), bool))
        for e1, e2 in ((0, 0), (0, 1), (1, 0), (1, 1), (2, 0), *([(0, 2)] if j < 2 else [])):
            row, first = one.around(blocks[i], e1)
            again, second = two.around(blocks[j][row], e2)
            places.append(name | first[again] << 23 | second)
            rows.append(row[again])
            own.append(np.zeros(len(again), bool))
    return np.concatenate(places), fps[np.concatenate(rows)], np.concatenate(own)


# -- comparison at each place ----------------------------------------------------------------------------------------

#: Fingerprints of one place that are compared with all its own ones at once.
BLOCK = 2048


def forest(own: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between a place's own fingerprints and its visitors, reduced to a spanning forest."""
    everyone = np.unique(np.concatenate([own, visitors]))
    label = np.arange(len(everyone))
    out: tuple[list, list] = ([], [])
    bits, mine = everyone.view(np.uint64), np.searchsorted(everyone, np.unique(own))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in mine.tolist():
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= threshold)
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                label[max(a, b)] = min(a, b)
                out[0].append(everyone[i])
                out[1].append(everyone[j])
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def compare(place: np.ndarray, fp: np.ndarray, own: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole places, given sorted by place."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    size = np.diff(edges)
    mine = np.add.reduceat(own.astype(np.int64), edges[:-1])
    use = np.flatnonzero((mine > 0) & (size > 1))
    small = use[mine[use] * size[use] <= BLOCK]
    # all small places together: every own fingerprint against every row of its place
    start, n = edges[small], size[small]
    rows = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(small) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(small)), n)
    is_own = own[rows]
    left, left_owner = rows[is_own], owner[is_own]
    reps = n[left_owner]
    a = np.repeat(left, reps)
    b = np.repeat(start[left_owner], reps) + (np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps))
    near = (np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= threshold) & (fp[a] != fp[b])
    left_fp, right_fp = [fp[a][near]], [fp[b][near]]
    for g in use[mine[use] * size[use] > BLOCK].tolist():
        part = slice(edges[g], edges[g + 1])
        x, y = forest(fp[part][own[part]], fp[part][~own[part]], threshold)
        left_fp.append(x)
        right_fp.append(y)
    return np.concatenate(left_fp), np.concatenate(right_fp)


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints of column fp; enough of them to connect what is connected."""
    assert threshold <= 4, "two of the three blocks hold two differing bits at most only up to four"
    session(fps)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0), np.int64)
            for at in range(0, len(values), 256):
                place, fp, own = placed(values[at : at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(place * 2 + ~own), pa.array(fp)], ["place", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_place, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(key, fp):
            a, b = compare(key >> 1, fp, (key & 1) == 0, threshold)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            held_place = np.concatenate([held_place, np.asarray(batch.column(0), np.int64)])
            held_fp = np.concatenate([held_fp, np.asarray(batch.column(1), np.int64)])
            if len(held_place) < 1 << 16 or held_place[0] >> 1 == held_place[-1] >> 1:
                continue
            cut = int(np.searchsorted(held_place, held_place[-1] >> 1 << 1))
            yield found(held_place[:cut], held_fp[:cut])
            held_place, held_fp = held_place[cut:], held_fp[cut:]
        if len(held_place):
            yield found(held_place, held_fp)

    spark = fps.sparkSession
    distinct = fps.select("fp").where(F.col("fp").isNotNull()).distinct()
    dealt = distinct.mapInArrow(spread, "place bigint, fp bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, F.shiftright("place", 1)).sortWithinPartitions("place")
    return met.mapInArrow(meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b) the smallest node that it can reach.

    Each round hangs larger neighbours onto the smallest known node (large star), then all onto it (small star); the
    number of rounds grows with the logarithm of the longest path. A node's many neighbours are grouped by partial
    aggregation and joins that Spark can split, never gathered in a row.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = digest(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.toDF("a", "b")).distinct(), "links")
        after = digest(edges)
        if before == after:
            return edges.toDF("node", "root")
        before = after


def digest(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges; two numbers, whatever the number of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def group(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links lead to, a document's own included."""
    made = written(fingerprints(docs), "fingerprints")
    roots = components(links(made, threshold))
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def row_name() -> Column:
    """Tells rows of (doc_id, text) apart, null ids too; rows that repeat both are one. A null text is empty."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.concat(text, F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit("")))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of every component, with all its columns: the smallest by doc_id, nulls last, then by hash of the text."""
    (name,) = spare(docs.columns, "_kept")
    made = written(fingerprints(docs, row_name().alias("name")), "fingerprints")
    roots = components(links(made, threshold))
    classes = made.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("first"))
    rooted = classes.join(roots, classes.fp == roots.node, "left")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.name").alias(name))
    return docs.withColumn(name, row_name()).join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
