"""Chat formatting by token-level assembly.

The segments of a conversation (role names and texts) are encoded each for itself and spliced between reserved ids,
so no token ever spans a segment's edge and no text can produce a reserved id. The loss mask is a prefix sum: plus one
after the id that opens an assistant's text, minus one at the id that closes it. In the formatted string a control
string that occurs in a text is escaped by a backslash after its first character (one more where some stand there
already), which is undone when the string or the tokens are read back.

Turns are grouped by conversation, which shuffles each text once; a conversation is one row of the result, and so the
unit of memory.

Defined cases: a null text or role is empty; turns are ordered by turn number, then role, then text, nulls first;
repeated rows are turns of their own; rows with a null conversation form one conversation; no rows, no conversations.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_arrow

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Control strings; the reserved id of each follows the ids of the vocabulary, in this order.
OPEN, ROLE, ANSWER, CLOSE = "<s>[INST] ", " [/INST] ", " [/ANSWER] ", "</s>"
CONTROLS = (OPEN, ROLE, ANSWER, CLOSE)
#: Whatever a reader could take for control text, escaped in contents: also without the blanks around it.
GUARDED = ("<s>", "</s>", "[INST]", "[/INST]", "[/ANSWER]")
_ESCAPE = re.compile("|".join(rf"{re.escape(g[0])}\\*(?={re.escape(g[1:])})" for g in GUARDED))
_UNESCAPE = re.compile("|".join(rf"{re.escape(g[0])}\\+(?={re.escape(g[1:])})" for g in GUARDED))
SCHEMA = "conv_id bigint, n_turns bigint, formatted string, ids array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


class Template:
    """<s>[INST] role [/INST] text</s>, or <s>[INST] role [/ANSWER] text</s> where the text is to be learned."""

    def __init__(self, path: str = VOCABULARY, learned: tuple[str, ...] = ("assistant",)):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.reserved = {c: self.first + i for i, c in enumerate(CONTROLS)}
        self.learned = learned

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], np.ndarray]:
        """The formatted string, its tokens, and for each token whether its loss counts."""
        parts, ids = [], []
        for role, text in turns:
            middle = ANSWER if role in self.learned else ROLE
            role, text = escape(role), escape(text)
            parts += [OPEN, role, middle, text, CLOSE]
            ids += [self.reserved[OPEN], *self.bpe.encode_ordinary(role), self.reserved[middle]]
            ids += [*self.bpe.encode_ordinary(text), self.reserved[CLOSE]]
        return "".join(parts), ids, self.mask(ids)

    def mask(self, ids: list[int]) -> np.ndarray:
        at = np.array(ids, np.int64)
        opens, closes = at == self.reserved[ANSWER], at == self.reserved[CLOSE]
        inside = np.cumsum(opens) - opens  # answers opened before this token
        done = np.maximum.accumulate(np.where(closes, np.cumsum(opens), 0)) if len(at) else at
        return (inside - done) > 0

    def read(self, ids: list[int]) -> list[tuple[str, str]]:
        """The turns, from the tokens alone."""
        turns, at = [], np.array(ids, np.int64)
        marks = np.flatnonzero(at >= self.first).tolist()
        for a, b, c in zip(marks[::3], marks[1::3], marks[2::3], strict=True):
            turns.append((self.text(ids[a + 1 : b]), self.text(ids[b + 1 : c])))
        return turns

    def text(self, ids: list[int]) -> str:
        return unescape(self.bpe.decode_bytes(ids).decode("utf-8", "surrogateescape")) if ids else ""

    def learned_text(self, ids: list[int], mask: np.ndarray) -> str:
        """All text under the mask, stretch by stretch, unescaped."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]])))
        return "".join(self.text(ids[a:b]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_TEMPLATES: dict[tuple, Template] = {}


def template(path: str = VOCABULARY, learned: tuple[str, ...] = ("assistant",)) -> Template:
    return _TEMPLATES.get((path, learned)) or _TEMPLATES.setdefault((path, learned), Template(path, learned))


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def apply_template(rows: DataFrame, path: str = VOCABULARY, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted string, token ids and loss mask of every conversation of (conv_id, turn, role, text) rows."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, out = template(path, learned), []
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text, ids, mask = made.format([(t["role"], t["text"]) for t in turns])
            out.append((conv, len(turns), text, ids, mask.tolist()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    return in_arrow(conversations(rows.select("conv_id", "turn", "role", "text")), each, SCHEMA)


NAMES = ["conv_id", "n_turns", "formatted", "ids", "loss_mask"]
