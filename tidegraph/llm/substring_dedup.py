"""Substring dedup by seed and extend: word passages that an earlier document has already.

Seeds: every window of LENGTH words has one anchor, the smallest hash of its k-word grams (the rightmost among
equals), so equal windows have equal anchors at equal places. Around an anchor lies its record, all words of the
windows that it stands for. Anchors are gathered over all documents, equal records of a batch as one row; only those
that two documents share go on.

Extension: where an earlier document has the same record, the match extends over the whole record both ways at once.
What is left is the first document of each record. If all records of its anchor are the same, nothing of it is
repeated. Otherwise the records part somewhere: each window of the first document's record is hashed, the smallest
doc_id of each hash is found by a partially aggregated group-by, and joined back; a window of a later copy needs none
of this, since the first document has it as well. Neighbouring repeated windows merge into maximal repeats. No pair of
documents is ever formed: an anchor that m documents share costs m rows, and windows as its different records have.

Texts are shuffled once, by row; the exchange serves both the extension and the removal.

Defined cases: a null or empty text has no words; a document is never compared with itself, nor with rows of equal
doc_id; rows that repeat doc_id and text are one document and get the same result each; a null doc_id comes after all
others, in the place of the largest 64-bit number; a text of less than LENGTH words is kept as it is; an empty table
gives an empty table; columns other than doc_id and text have no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import Rolling, in_arrow, mix, of_bytes, raw, row_keys, texts, window_min, word_bounds, written

LENGTH, GRAM = 50, 8
#: Bytes of text that are looked at together: few enough that their numbers stay in a processor's cache.
PIECE_BYTES = 1 << 17
#: A null doc_id's place in the order of documents.
LAST = (1 << 63) - 1
_ROW = np.uint64(0x9E3779B97F4A7C15)


class Records:
    """Anchors of a batch of texts: their hashes, rows, first and last windows, and the hashes of their records."""

    def __init__(self, column: pa.Array, length: int, gram: int):
        data, bounds = raw(column)
        start, end, self.row = word_bounds(data, bounds)
        self.words = Rolling(of_bytes(data).of(start, end))
        self.length = length
        self.first_word = np.searchsorted(self.row, np.arange(len(column)))
        none = np.zeros(0, np.int64)
        self.anchor_row = self.first = self.last = none
        self.hash = self.record = np.zeros(0, np.uint64)
        if len(start) < length:
            return
        at = np.arange(len(start) - gram + 1)
        grams = self.words.of(at, at + gram)
        anchor = window_min(grams, length - gram + 1)
        window = np.arange(len(anchor))
        inside = self.row[window] == self.row[window + length - 1]
        window, anchor = window[inside], anchor[inside]
        if not len(window):
            return
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(self.row[window]) != 0)]))
        self.first = window[new]
        self.last = window[np.concatenate([new[1:], [len(window)]]) - 1]
        at = anchor[new]
        self.anchor_row, self.hash = self.row[at], grams[at]
        self.record = mix(self.words.of(self.first, self.last + length) + (at - self.first).astype(np.uint64))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows, each of less than PIECE_BYTES of text after its first row."""
    bounds = raw(batch.column("text"))[1]
    cuts = np.flatnonzero(np.diff(bounds[1:] // PIECE_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bounds) - 1], strict=True):
        yield batch.slice(a, b - a)


def seeds(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, record, low, high): the different records of each batch of (place, text) rows, with their anchors and first and last places."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for piece in pieces(batch):
            r = Records(piece.column("text"), length, gram)
            found.append((r.hash.view(np.int64), r.record.view(np.int64), np.asarray(piece.column("place"), np.int64)[r.anchor_row]))
        h, record, place = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((place, record))
        edges = np.flatnonzero(np.diff(record[order]))
        low, high = (order[i[: len(order)]] for i in (np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(order) - 1]])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h[low], record[low], place[low], place[high])], ["h", "record", "low", "high"])

    return in_arrow(docs, each, "h bigint, record bigint, low bigint, high bigint")


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(record, place, key, more): the records of every document."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for piece in pieces(batch):
            r = Records(piece.column("text"), length, gram)
            taken = [piece.column(c).take(pa.array(r.anchor_row)) for c in ("place", "key", "more")]
            found.append(pa.RecordBatch.from_arrays([pa.array(r.record.view(np.int64)), *taken], ["record", "place", "key", "more"]))
        return pa.concat_batches(found)

    return in_arrow(docs, each, "record bigint, place bigint, key bigint, more int")


def extended(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, more, place, first, last, window, whole) of (place, text, key, more) rows: stretches of repeated windows, by
    their first words, where whole is true; elsewhere single windows, of which an earlier document may have an equal one.

    window is a window's hash; that of a stretch says nothing, it deals them out evenly.
    """
    found = seeds(docs.select("place", "text"), length, gram).repartition("h").groupBy("h", "record").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    anchor = Window.partitionBy("h")
    spread = {"h_low": F.min("low").over(anchor), "h_high": F.max("high").over(anchor), "r0": F.min("record").over(anchor), "r1": F.max("record").over(anchor)}
    shared = found.withColumns(spread).where("h_low < h_high").select("record", "low", (F.col("r0") == F.col("r1")).alias("same"))
    hits = occurrences(docs.select("place", "text", "key", "more"), length, gram).join(written(shared, "records"), "record")
    hits = hits.select("key", "more", "record", (F.col("place") > F.col("low")).alias("whole"), "same").where("whole or not same")
    wanted = hits.groupBy("key", "more").agg(F.collect_set(F.struct("record", "whole")).alias("records"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.concat_batches([piecewise(piece) for piece in pieces(batch)])

    def piecewise(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = Records(batch.column("text"), length, gram)
        lists = batch.column("records")
        owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        wanted_records, wanted_whole = lists.flatten().flatten()
        name = mix(np.asarray(wanted_records, np.int64).view(np.uint64) + (owner + 1).astype(np.uint64) * _ROW)
        order = np.argsort(name)
        mine = mix(r.record + (r.anchor_row + 1).astype(np.uint64) * _ROW)
        at = order[np.minimum(np.searchsorted(name, mine, sorter=order), len(order) - 1)]
        known, whole = name[at] == mine, np.asarray(wanted_whole.cast(pa.int8()), np.int8)[at] > 0
        all_of, part_of = np.flatnonzero(known & whole), np.flatnonzero(known & ~whole)
        # stretches: neighbouring records are one
        joins = (r.last[all_of][:-1] + 1 == r.first[all_of][1:]) & (r.anchor_row[all_of][:-1] == r.anchor_row[all_of][1:])
        begins, ends = all_of[np.concatenate([[True], ~joins])[: len(all_of)]], all_of[np.concatenate([~joins, [True]])[: len(all_of)]]
        n = (r.last - r.first + 1)[part_of]
        window = np.repeat(r.first[part_of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = np.concatenate([r.anchor_row[begins], np.repeat(r.anchor_row[part_of], n)])
        base = r.first_word[rows]
        first, last = (np.concatenate([x, window]) - base for x in (r.first[begins], r.last[ends]))
        given = np.concatenate([mine[begins], r.words.of(window, window + length)]).view(np.int64)
        taken = [batch.column(c).take(pa.array(rows)) for c in ("key", "more", "place")]
        columns = [first.astype(np.int32), last.astype(np.int32), given, np.arange(len(rows)) < len(begins)]
        return pa.RecordBatch.from_arrays([*taken, *map(pa.array, columns)], ["key", "more", "place", "first", "last", "window", "whole"])

    joined = docs.join(wanted, ["key", "more"])  # all columns, so that its exchange is that of the removal
    return in_arrow(joined, each, "key bigint, more int, place bigint, first int, last int, window bigint, whole boolean")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, more, spans) of (place, text, key, more) rows: array<struct<first, last>> of repeated windows' first words."""
    found = extended(docs, length, gram)
    earliest = found.where("not whole").groupBy("window").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high")
    judged = found.join(earliest.select("window", "low"), "window", "left").where("whole or place > low")
    return judged.groupBy("key", "more").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: kept holds the words that stay, joined by one space.

    spans lists the maximal repeats as word positions, end exclusive.
    """
    keyed = texts(docs).withColumns({"place": F.coalesce("doc_id", F.lit(LAST)), **dict(zip(("key", "more"), row_keys(), strict=True))})

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("spans").fill_null([])
        first, last = (np.asarray(c, np.int64) for c in lists.flatten().flatten())
        row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        # spans by row and start; one begins a repeat where all before it end earlier, those of rows before always do
        apart = int(last.max(initial=0)) + length + 1
        order = np.argsort(row * apart + first)
        row, first, last = row[order], first[order], last[order]
        reach = np.maximum.accumulate(row * apart + last + length)
        new = np.flatnonzero(np.concatenate([[True], (row * apart + first)[1:] > reach[:-1]])[: len(row)])
        owner, starts = row[new], first[new]
        stops = reach[np.concatenate([new[1:], [len(row)]])[: len(new)] - 1] - owner * apart
        cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
        n_words, n_kept, texts_ = [], [], []
        for text, low, high in zip(batch.column("text").cast(pa.binary()).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            for a, b in zip(starts[low:high][::-1].tolist(), stops[low:high][::-1].tolist(), strict=True):
                del words[a:b]
            n_kept.append(len(words))
            texts_.append(b" ".join(words))
        n_words = np.array(n_words, np.int64)
        merged = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], ["start", "end"]))
        columns = [pa.array(n_words), pa.array(n_words - np.array(n_kept, np.int64)), pa.array(texts_, pa.binary()).cast(pa.string()), merged]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    joined = keyed.join(repeated(keyed, length, gram), ["key", "more"], "left")
    return in_arrow(joined, each, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>")
