"""Packing of documents into training sequences by order-preserving dynamic programming.

Each partition packs its own documents in the order in which it reads them: their tokens form one stream, and the
program chooses where to cut it. A cut may stand at the end of a document (free), at the end of a sentence (a small
penalty), or, where a window holds neither, anywhere (a larger one). With f(p) the least cost of all that comes before
a cut p, f(p) = penalty(p) + min over q in [p - L, p) of f(q) + L - (p - q); f(q) + q is kept in a monotone queue, so
each cut is handled in constant time. A sequence whose length is a power of two needs no padding. The program runs
over blocks of a fixed number of tokens; what follows a block's last cut is carried into the next, so memory is
bounded, nothing is shuffled, and only the last sequence of a partition may be left short.

Defined cases: a null or empty text is one token, the end of a document; a document longer than a sequence spans as
many sequences as it needs; repeated rows are packed each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidegraph.llm.common import session, strings, texts

LENGTH = 2048
END_OF_DOCUMENT = 1
SENTENCE_PENALTY, SPLIT_PENALTY = 4.0, 128.0
#: Tokens that one run of the dynamic program covers, beside at most one document.
BLOCK_TOKENS = 1 << 19
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the tokenizer file beside a rank file, which are matched in texts before anything else."""
    beside = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    plain = all(not t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized"))
    assert plain, "only added tokens that match as they stand"
    return {t["content"]: t["id"] for t in found}


class Encoder:
    """The byte-level BPE of byte_bpe_50k.json, its added tokens included: the rank file gives the same ids, faster."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))
        self.ends = np.zeros(self.bpe.max_token_value + 1, bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.rstrip(b" ")[-1:] in b".!?\n" and bool(token.strip(b" "))

    def encode(self, text: str) -> np.ndarray:
        return np.array([*self.bpe.encode(text, allowed_special="all"), END_OF_DOCUMENT], np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def places(sizes: list[int], ends: list[np.ndarray], length: int) -> tuple[list[int], list[float]]:
    """Candidate cuts of a stream of documents and their penalties; no two neighbours lie further apart than length."""
    found: list[np.ndarray] = []
    costs: list[np.ndarray] = []
    at = 0
    for size, end in zip(sizes, ends, strict=True):
        end = end[(end > 0) & (end < size)]
        cost = np.full(len(end), SENTENCE_PENALTY)
        own = np.concatenate([[0], end, [size]])
        if size > length and (gaps := np.flatnonzero(np.diff(own) > length)).size:
            extra = np.concatenate([np.arange(own[g] + length, own[g + 1], length) for g in gaps])
            end, cost = np.concatenate([end, extra]), np.concatenate([cost, np.full(len(extra), SPLIT_PENALTY)])
            order = np.argsort(end, kind="stable")
            end, cost = end[order], cost[order]
        found += [at + end, np.array([at + size])]
        costs += [cost, np.zeros(1)]
        at += size
    return np.concatenate(found).tolist(), np.concatenate(costs).tolist()


def cuts(at: list[int], penalty: list[float], length: int = LENGTH) -> list[int]:
    """The cheapest choice among the candidate cuts; the last one always belongs to it."""
    best, back = [0.0] * (len(at) + 1), [0] * (len(at) + 1)
    place = [0, *at]
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    index = {0: 0}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f(q) + q, number of q), increasing
    for i, (p, extra) in enumerate(zip(at, penalty, strict=True), 1):
        while place[queue[0][1]] < p - length:
            queue.popleft()
        value, q = queue[0]
        cost = value + length - p
        for w in powers:  # a power of two needs no padding
            if (j := index.get(p - w)) is not None and best[j] < cost:
                cost, q = best[j], j
        cost += extra
        best[i], back[i], index[p] = cost, q, i
        value = cost + p
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, i))
    out, i = [], len(at)
    while i:
        out.append(place[i])
        i = back[i]
    return out[::-1]


def pack(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document: where it starts there, its length and checksum, its sequence and place in it."""
    spark_docs = texts(docs)
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (doc_id, ids, ids before them, all ids of the document)

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal sequence, held
            sizes = [len(h[1]) for h in held]
            at, penalty = places(sizes, [np.flatnonzero(coder.ends[h[1]]) + 1 for h in held], length)
            chosen = cuts(at, penalty, length)
            if not last:
                chosen.pop()  # the last sequence is carried on
            rows, doc, done, base = [], 0, 0, 0
            for cut in chosen:
                offset = 0
                while done < cut:
                    doc_id, ids, before, total = held[doc]
                    part = ids[done - base : cut - base]
                    rows.append((doc_id, before + done - base, len(part), zlib.crc32(part.tobytes()), total, sequence, offset))
                    offset += len(part)
                    done += len(part)
                    if done - base == len(ids):
                        base, doc = done, doc + 1
                sequence += 1
            rest = held[doc:]
            if rest and done > base:
                doc_id, ids, before, total = rest[0]
                rest[0] = (doc_id, ids[done - base :], before + done - base, total)
            held = rest
            if not rows:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)

        waiting = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = coder.encode(text).astype("<u4")
                held.append((doc_id, ids, 0, len(ids)))
                waiting += len(ids)
                if waiting >= block:
                    if (out := flush(False)) is not None:
                        yield out
                    waiting = sum(len(h[1]) for h in held)
        if held and (out := flush(True)) is not None:
            yield out

    return spark_docs.mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
