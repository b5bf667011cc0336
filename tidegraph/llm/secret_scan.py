"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams that any match must hold. Every
batch of documents is one shard: an inverted index lists, for each trigram that some rule asks for, the documents of
the shard that hold it; postings are intersected and united as the query says, and only the candidates are verified
with the regular expression. Rules without mandatory trigrams (a run of hexadecimal digits) scan every document. A
shard's index never leaves its task, so nothing is shuffled, memory is bounded by the batch, and a lost executor costs
only its own tasks.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each for itself; matches of one rule
don't overlap, matches of different rules may; an empty table gives an empty table; other columns stay untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_arrow, raw, strings

#: Strings that a sub-expression may stand for before it counts as unknown.
MOST_STRINGS = 64


def trigrams(s: str) -> frozenset[bytes]:
    b = s.encode().lower()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def conj(parts):
    """AND of queries; True asks for nothing, a frozenset of trigrams asks for all of them."""
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def disj(parts):
    parts = list(dict.fromkeys(parts))
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *parts)


def known(strings_: set[str]):
    """The query for text that holds one of these strings."""
    return disj(trigrams(s) or True for s in sorted(strings_))


def of_class(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            out.add(chr(value))
        elif kind is C.RANGE and value[1] - value[0] < 8:
            out |= {chr(x) for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def query_of(tree):
    """(strings or None, query): all strings that the parsed expression can match, if few, and what they need."""
    exact: set[str] | None = {""}
    run, parts = {""}, []

    def flush():
        nonlocal run, exact
        parts.append(known(run))
        run, exact = {""}, None

    def extend(more: set[str]):
        nonlocal run, exact
        if len(run) * len(more) > MOST_STRINGS:
            flush()
        run = {a + b for a in run for b in more} if len(more) <= MOST_STRINGS else {""}
        exact = run if exact is not None else None

    for kind, value in tree:
        if kind is C.LITERAL:
            extend({chr(value)})
        elif kind is C.IN and (chars := of_class(value)):
            extend(chars)
        elif kind is C.AT:
            continue
        elif kind is C.SUBPATTERN or kind is C.BRANCH:
            inner = [query_of(value[-1])] if kind is C.SUBPATTERN else [query_of(x) for x in value[1]]
            if all(x is not None for x, _ in inner):
                extend(set().union(*(x for x, _ in inner)))
            else:
                flush()
                parts.append(disj(q for _, q in inner))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = value
            strings_, query = query_of(body)
            if (least, most) == (0, 1) and strings_ is not None:
                extend(strings_ | {""})
            elif least and strings_ is not None:
                for _ in range(min(least, 8)):
                    extend(strings_)
                if least != most or least > 8:
                    flush()
            else:
                flush()
                parts.append(query if least else True)
        else:
            flush()
    parts.append(known(run))
    return exact, conj(parts)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts, and the least length of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    @cached_property
    def query(self):
        """Boolean trigram query over lower-cased text; True where no trigram is mandatory."""
        strings_, query = query_of(parser.parse(self.pattern, re.ASCII))
        return known(strings_) if strings_ is not None else query

    def find(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed by the contract of the scan.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the same as all maximal runs without the shorter ones
)
#: Publicly documented token shapes that the base kinds don't name.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE_RULES + MORE_RULES


class Index:
    """Postings of one shard for the trigrams that the rules ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        wanted: set[bytes] = set()

        def gather(query):
            if isinstance(query, frozenset):
                wanted.update(query)
            elif isinstance(query, tuple):
                for q in query[1:]:
                    gather(q)

        for rule in rules:
            gather(rule.query)
        self.wanted = sorted(wanted)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted, 1):
            self.number[int.from_bytes(t, "big")] = i

    def build(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.rows = np.arange(len(bounds) - 1)
        low = self.lower[data].astype(np.uint32)
        found = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(found)
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + 3 <= bounds[row + 1]
        at, row = at[inside], row[inside]
        pairs = np.unique(found[at].astype(np.int64) * len(bounds) + row)
        number, row = np.divmod(pairs, len(bounds))
        cuts = np.searchsorted(number, np.arange(1, len(self.wanted) + 2))
        self.postings = {t: row[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.wanted)}

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return self.rows
        if isinstance(query, frozenset):
            lists = sorted((self.postings[t] for t in query), key=len)
        else:
            lists = [self.candidates(q) for q in query[1:]]
            if query[0] == "or":
                return np.unique(np.concatenate(lists))
            lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


_INDEXES: dict[tuple[Rule, ...], Index] = {}


def spans_of(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, number of the rule, end), in that order; code points, end exclusive."""
    index = _INDEXES.get(rules) or _INDEXES.setdefault(rules, Index(rules))
    index.build(*raw(column))
    values, out = strings(column), [[] for _ in range(len(column))]
    for k, rule in enumerate(rules):
        for i in index.candidates(rule.query).tolist():
            out[i].extend((start, k, end) for start, end in rule.find(values[i]))
    for spans in out:
        spans.sort()
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with a column of array<struct<kind, start, end>>; a column of that name is replaced."""
    docs = docs.drop(out)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = spans_of(batch.column(text), rules)
        column = pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found], kind)
        return batch.append_column(out, column)

    schema = docs.withColumn(out, F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")).schema
    return in_arrow(docs, each, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with each maximal stretch of secrets replaced by [SECRET]; the column of lengths, if there, is renewed."""

    def clean(value: str, spans: list[tuple[int, int, int]]) -> str:
        parts, done = [], 0
        for start, _, end in spans:
            if start >= done:
                parts += [value[done:start], "[SECRET]"]
            done = max(done, end)
        return "".join([*parts, value[done:]])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        old = batch.column(at).to_pylist()
        new = [clean(v, s) if s else v for v, s in zip(old, spans_of(batch.column(at), rules), strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    done = in_arrow(docs, each, docs.schema)
    if length not in docs.columns:
        return done
    kind = docs.schema[length].dataType
    return done.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text).cast(kind)))
