"""Byte-level BPE as folds of Spark's higher-order functions.

A word starts as its bytes, each an id with the rank of its pair with the next one. A fold merges, step by step, the
neighbours whose concatenation has the lowest rank (the leftmost among equals) until no concatenation is ranked. The
ranks are a literal of the plan: a table of all pairs of ids whose concatenation is a piece, without collisions, so that
a look-up is arithmetic and two array reads. A step renews the two ranks beside the merge alone.

In a word of more than LONG bytes a step merges all neighbours of the lowest rank at once, from left to right. That
gives the same ids: every piece folds to itself, so a merge of rank r never makes a pair of a rank below r (whose piece
would have been folded before, inside the same bounds). Steps then grow with the ranks that the word uses and not with
its length.

The corpus is cut into words as the tokenizer's pattern cuts it, by the classes of the characters of a whole batch. A
task gathers texts into chunks of a fixed number of bytes and numbers their distinct words; the numbers go on from chunk
to chunk, so a word is folded once until MOST_WORDS of them are known and numbering starts anew. Both bounds are on
memory alone. The most frequent words of a bounded sample are folded beforehand and known to all tasks. Ids are put in
place of the numbers after the fold. No text is shuffled, and a lost executor costs only its own tasks.

Decoding concatenates the pieces of the ids, a batch at a time.

Defined cases: a null or empty text has no ids; null ids and ids outside the vocabulary decode to nothing; repeated
rows are encoded each for itself; an empty table gives an empty table; a column named as the result is replaced, all
others stay as they are.
"""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import in_arrow, raw, session, spare

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# Code points that Unicode 14 to 16 made letters and digits, which the tokenizer library knows and
# Python's tables may not, and white space.
SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"
NEW_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 "
    "A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC "
    "105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 "
    "1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 "
    "11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD "
    "1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D "
    "31350-323AF"
)
NEW_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"

#: Classes of code points, as the tokenizer's pattern has them.
OTHER, LETTER, DIGIT, SPACE = range(4)
#: What the pattern cuts off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
assert public_tokenizers.PATTERN == "'s|'t|'re|'ve|'m|'ll|'d" + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", "words cuts by this pattern"
#: Bytes of words in one chunk, offsets included, and of the longest word that is folded merge by merge.
CHUNK_BYTES, LONG = 4 << 20, 64
#: Distinct words that a task knows at once.
MOST_WORDS = 1 << 19
#: Rows, about, of the sample that frequent words come from, and the words that all tasks know from the start.
SAMPLE_ROWS, COMMON_WORDS = 1 << 14, 1 << 18
#: Moduli of the rank table: of the first look-up, and of the second, to which the first adds less than MOVES.
GROUPS, SPREAD, MOVES = 32749, 196613, 1 << 16
#: No rank, and no id; what an empty slot holds.
NONE, EMPTY = (1 << 16) - 1, 1 << 62


@lru_cache(4)
def vocabulary(path: str = VOCABULARY) -> tuple[bytes, ...]:
    """The binary piece of each id; ids that the file leaves out are empty."""
    with open(path, "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    return tuple(ranks.get(i, b"") for i in range(max(ranks) + 1))


@lru_cache(4)
def _table(path: str) -> str:
    """JSON of the rank table: `first` the state's number of each start, `shift` by group, `slot` with pair and rank in one number."""
    ranks = {piece: i for i, piece in enumerate(vocabulary(path)) if piece}
    assert len(vocabulary(path)) <= NONE, "ids take 16 bits"
    groups: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                key = left << 16 | right
                groups.setdefault(key % GROUPS, []).append((key, rank))
    shift, slot = [0] * GROUPS, [EMPTY] * (SPREAD + MOVES)
    for group, entries in sorted(groups.items(), key=lambda g: -len(g[1])):  # the fullest first, while there is room
        places = [key % SPREAD for key, _ in entries]
        assert len(set(places)) == len(places)
        begin = group * 40503 % MOVES  # anywhere, so that the search seldom meets what earlier groups filled
        move = next(m for m in chain(range(begin, MOVES), range(begin)) if all(slot[p + m] == EMPTY for p in places))
        shift[group] = move
        for (key, rank), p in zip(entries, places, strict=True):
            slot[p + move] = key << 16 | rank
    one = [bytes([b]) for b in range(256)]
    first = [ranks.get(x + y, NONE) << 16 | ranks[x] for x in one for y in one] + [NONE << 16 | ranks[x] for x in one] + [NONE << 16 | NONE]
    return json.dumps({"first": first, "shift": shift, "slot": slot}, separators=(",", ":"))


def rank_map(path: str = VOCABULARY) -> Column:
    """The literal rank map of a vocabulary."""
    return F.from_json(F.lit(_table(path)), "first array<bigint>, shift array<int>, slot array<bigint>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once; for a literal, with one copy of it in the plan.

    Spark's array functions ask for the types of their arguments at each evaluation, and an expression derives its type
    from its parts; a lambda's variable knows it. So what goes into them is bound to variables first: as the start of an
    aggregate over no elements, which neither makes an array nor copies the result.
    """
    return F.reduce(F.array().cast("array<int>"), value, lambda x, _: x, body)


IDS = "array<int>"


def fold(word: Column, ranks: Column) -> Column:
    """array<int>: the ids of one word, given as starts makes it."""
    return let(ranks["first"], lambda first: let(ranks["shift"], lambda shift: let(ranks["slot"], lambda slot: folded(word, first, shift, slot))))


def folded(word: Column, first: Column, shift: Column, slot: Column) -> Column:
    """The fold with the parts of the rank map.

    The state is an array of numbers, an id in the low 16 bits of each and above them the rank of its pair with the next
    one, NONE where there is no such piece. Two ids that no piece has, NONE, stand at the ends.
    """
    none = F.lit(NONE).cast("long")
    low16 = lambda x: x.bitwiseAND(none)

    def pair(left: Column, right: Column) -> Column:
        return F.shiftleft(left, 16).bitwiseOR(right)

    def number(key: Column) -> Column:
        """The state's number of a pair: what else than the pair itself is in a slot makes it larger than any rank."""
        found = F.get(slot, key % SPREAD + F.get(shift, key % GROUPS)).bitwiseXOR(F.shiftleft(key, 16))
        return let(found, lambda x: F.when(x < NONE, F.shiftleft(x, 16)).otherwise(F.lit(NONE << 16))).bitwiseOR(F.shiftright(key, 16))

    def begin(t: Column) -> Column:
        return F.transform(F.transform(t, lambda x, i: pair(x, F.coalesce(F.get(t, i + 1), none))), number)

    def merge(s: Column, _: Column) -> Column:
        """The leftmost pair of the lowest rank becomes one id; where there is none, the first end becomes -1, and s stays so."""

        def put(lowest: Column) -> Column:
            done = F.array(F.array(F.lit(-1).cast("long")), F.slice(s, F.lit(2), F.size(s)))
            joined = let(low16(lowest).cast("int"), lambda j: let(F.shiftright(lowest, 16), lambda rank: at(j, rank)))
            return let(F.when(lowest >= NONE << 16, done).otherwise(joined), F.flatten)

        def at(j: Column, rank: Column) -> Column:
            sides = F.array(pair(low16(F.get(s, j - 1)), rank), pair(rank, low16(F.get(s, j + 2))))
            return F.array(F.slice(s, F.lit(1), j - 1), F.transform(sides, number), F.slice(s, j + 3, F.size(s)))

        places = F.transform(s, lambda x, i: x.bitwiseAND(F.lit(NONE << 16)).bitwiseOR(i.cast("long")))
        return F.when(F.get(s, F.lit(0)) < 0, s).otherwise(let(let(places, F.array_min), put))

    def sweep(s: Column, _: Column) -> Column:
        """All pairs of the lowest rank become one id each; of pairs that overlap, every other one from the left."""

        def put(rank: Column) -> Column:
            flags = F.array_join(F.transform(s, lambda x: F.when(F.shiftright(x, 16) == rank, "1").otherwise("0")), "")
            chosen = F.split(F.regexp_replace(flags, "11", "10"), "")
            return F.when(rank >= NONE, s).otherwise(let(chosen, renew))

        def renew(chosen: Column) -> Column:
            ids = F.transform(s, lambda x, i: F.when(F.get(chosen, i) == "1", F.shiftright(x, 16)).when((i > 0) & (F.get(chosen, i - 1) == "1"), F.lit(-1).cast("long")).otherwise(low16(x)))
            return let(F.filter(ids, lambda x: x >= 0), begin)

        return let(F.shiftright(F.array_min(s), 16), put)

    def ids(s: Column) -> Column:
        return F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: low16(x).cast("int"))

    def whole(t: Column) -> Column:
        steps = lambda: F.sequence(F.lit(1), F.greatest(F.size(t) - 3, F.lit(1)))
        return F.when(F.size(t) <= LONG + 2, F.reduce(steps(), t, merge, ids)).otherwise(F.reduce(steps(), t, sweep, ids))

    return let(F.transform(word, lambda x: F.get(first, x)), whole)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    of = {"L": LETTER, "N": DIGIT}
    made = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for listed, kind in ((NEW_LETTERS, LETTER), (NEW_DIGITS, DIGIT), (SPACES, SPACE)):
        for span in listed.split():
            first, *last = (int(x, 16) for x in span.split("-"))
            made[first : (last or [first])[0] + 1] = kind
    return made


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, as the tokenizer's pattern cuts them; a null has none.

    A word is a run of one class, with a space before it if there is one. Of white space before something else the last
    character stands alone, or is that space. An apostrophe alone, without a space before it, takes its ending along.
    """
    data, bounds = raw(texts)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # no text: bytes cast to one
        return words(pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in pairwise(bounds)], pa.string()))
    n = len(points)
    place = None if n == len(data) else np.flatnonzero((data & 0xC0) != 0x80)  # the byte that each character begins with
    rows = bounds if place is None else np.searchsorted(place, bounds)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)  # a row begins here, or ends
    begins[rows] = True
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    at = np.flatnonzero(points == 0x27)
    at = at[start[at]]
    for ending in ENDINGS:
        found = at[at + len(ending) < n]
        for k, c in enumerate(ending, 1):
            found = found[(points[found + k] == ord(c)) & ~begins[found + k]]
        start[found + 1] = False
        start[found + 1 + len(ending)] = True
    start = np.flatnonzero(start[:n])
    ends = np.append(start if place is None else place[start], len(data))
    cut = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, rows), pa.int32()), cut)


def common(docs: DataFrame, text: str, path: str, rows: int, most: int) -> tuple[pa.Array, pa.Array]:
    """The most frequent words of a sample of about that many rows, and their ids: what all tasks would fold otherwise.

    The sample decides what is folded beforehand and nothing else; both its rows and its words are bounded.
    """
    n = docs.count()
    if n <= rows:  # a table of this size has no more words than the sample
        return pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def counts(texts: pa.Array) -> pa.RecordBatch:
        cut = words(texts).values
        found = cut.filter(pc.less_equal(pc.binary_length(cut), LONG)).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    sample = docs.select(text).sample(rows / n, seed=1)
    word = F.col("word")
    counted = in_arrow(sample, lambda batch: counts(batch.column(0)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    listed = counted.orderBy(F.desc("n"), "word").limit(most).select("word").groupBy((F.crc32(word.cast("binary")) % 64).alias("part")).agg(F.collect_list("word").alias("listed"))

    def in_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("listed")
            yield pa.RecordBatch.from_arrays([lists, pa.ListArray.from_arrays(lists.offsets, starts(lists.values))], ["listed", "spelt"])

    ids = let(rank_map(path), lambda r: F.transform("spelt", lambda w: fold(w, r)))
    found = listed.select("listed").mapInArrow(in_bytes, "listed array<string>, spelt array<array<int>>").select("listed", ids.alias("ids")).toArrow().combine_chunks()
    flat = [found.column(c).combine_chunks() for c in ("listed", "ids")]
    return tuple((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).flatten() for c in flat)


def starts(strings: pa.Array) -> pa.Array:
    """What the fold of each string starts from, as lists: of each byte the place in `first` of its pair with the next one, and the ends."""
    data, bounds = raw(strings)
    n, end = np.diff(bounds), 256 * 257
    after = np.append(data[1:], 0).astype(np.int32)
    place = data.astype(np.int32) * 256 + after
    last = bounds[1:][n > 0] - 1
    place[last] = data[last].astype(np.int32) + 256 * 256
    out = np.full(len(data) + 2 * len(n), end, np.int32)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = place
    return pa.ListArray.from_arrays(pa.array(bounds + 2 * np.arange(len(bounds)), pa.int32()), pa.array(out))


def encode(
    docs: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY, chunk_bytes: int = CHUNK_BYTES, most_words: int = MOST_WORDS,
    keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS, common_words: int = COMMON_WORDS, decoded: str | None = None, as_integers: str | None = None,
) -> DataFrame:
    """docs (of them the columns in keep, if given) with the ids of every text, as the tiktoken library would give them without special tokens.

    With decoded or as_integers, columns of these names have what decode makes of the ids, in the same workers.
    """
    outs = ({decoded: list(vocabulary(path))} if decoded else {}) | ({as_integers: integers(path)} if as_integers else {})
    tables = [piece_table(listed) for listed in outs.values()]
    names = [c for c in (docs.columns if keep is None else keep) if c != out and c not in outs]
    (cut,) = spare(names, "words")
    kept = docs.select(*names)
    listed = docs.select(*names, F.col(text).alias(cut))
    session(docs)
    often, often_ids = common(docs, text, path, sample_rows, common_words)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per chunk: its rows as an Arrow stream, the words of each as numbers, and the bytes of new words."""
        known = often  # the number of a word is its place
        rows: list[pa.RecordBatch] = []
        tokens: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal known
            coded = pa.concat_arrays(tokens).dictionary_encode()
            found = coded.dictionary
            if len(known) + len(found) > most_words:
                known = often
            anew, first = len(known) == len(often), len(known)
            place = pc.index_in(found, value_set=known)
            new = found.filter(place.is_null())
            numbers = np.array(place.fill_null(-1))
            numbers[numbers < 0] = np.arange(first, first + len(new))
            known, fresh = pa.concat_arrays([known, new]), starts(new)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as stream:
                for r in rows:
                    stream.write_batch(r)
            codes = numbers[np.asarray(coded.indices)] if len(found) else np.zeros(0, np.int32)
            parts = (sink.getvalue().to_pybytes(), np.concatenate(sizes).astype("<i4").tobytes(), codes.astype("<i4").tobytes())
            chunk = pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), fresh)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in parts), pa.array([anew]), chunk], ["rows", "sizes", "codes", "anew", "words"])

        held = 0
        for batch in batches:
            lists = words(batch.column(cut))
            rows.append(pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))], names))
            tokens.append(lists.flatten())
            sizes.append(np.diff(np.asarray(lists.offsets)))
            held += tokens[-1].nbytes
            if held >= chunk_bytes:
                yield flush()
                rows, tokens, sizes, held = [], [], [], 0
        if rows:
            yield flush()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each chunk with their ids."""
        start = np.asarray(often_ids.flatten(), np.int32), np.asarray(pc.list_value_length(often_ids), np.int64)
        values, at = start
        for batch in batches:
            for k in range(batch.num_rows):
                stream, sizes, codes = (batch.column(c)[k].as_buffer() for c in ("rows", "sizes", "codes"))
                lists = batch.column("ids")[k].values
                fresh = np.asarray(lists.flatten(), np.int32), np.diff(np.asarray(lists.offsets, np.int64))
                if batch.column("anew")[k].as_py():
                    values, at = start
                values, at = np.concatenate([values, fresh[0]]), np.concatenate([at, fresh[1]])
                first = np.cumsum(at) - at
                sizes, codes = np.frombuffer(sizes, "<i4"), np.frombuffer(codes, "<i4")
                ends, row = np.cumsum(sizes, dtype=np.int64), 0
                for rows in pa.ipc.open_stream(stream):
                    for a in range(0, rows.num_rows, 64):
                        part = rows.slice(a, 64)
                        low, high = ends[row] - sizes[row], ends[row + part.num_rows - 1]
                        used = codes[low:high]
                        n = at[used]
                        total = np.concatenate([[0], np.cumsum(n)])
                        ids = values[np.repeat(first[used] - total[:-1], n) + np.arange(total[-1])]
                        cuts = total[np.concatenate([[0], ends[row : row + part.num_rows] - low])]
                        column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                        yield pa.RecordBatch.from_arrays([*part.columns, column, *(spelt(column, t) for t in tables)], [*names, out, *outs])
                        row += part.num_rows

    chunks = listed.mapInArrow(gather, "rows binary, sizes binary, codes binary, anew boolean, words array<array<int>>")
    ids = let(rank_map(path), lambda r: F.transform("words", lambda w: fold(w, r)))
    schema = kept.withColumns({out: F.array().cast(IDS), **dict.fromkeys(outs, F.lit(b""))}).schema
    return chunks.select("rows", "sizes", "codes", "anew", ids.alias("ids")).mapInArrow(spread, schema)


def piece_table(pieces: list[bytes]) -> pa.Array:
    return pa.array([*pieces, b""], pa.binary())


def spelt(lists: pa.Array, table: pa.Array) -> pa.Array:
    """Of each list of ids the table's pieces, one behind the other; null and unknown ids have the last one, nothing."""
    lists = lists.fill_null([])
    at = np.asarray(lists.flatten().fill_null(-1), np.int64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
    pieces = table.take(pa.array(np.where((at < 0) | (at >= len(table) - 1), len(table) - 1, at)))
    _, offsets, data = pieces.buffers()
    cuts = np.frombuffer(offsets, np.int32)[ends].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts), data])


def concatenated(rows: DataFrame, ids: str, outs: dict[str, list[bytes]]) -> DataFrame:
    """rows with binary columns: for each of them a piece for each id, one behind the other."""
    schema = rows.withColumns(dict.fromkeys(outs, F.lit(b""))).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = {n: spelt(batch.column(ids), listed) for n, listed in tables.items()}
        return pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in schema.names], schema.names)

    tables = {out: piece_table(listed) for out, listed in outs.items()}
    return in_arrow(rows, each, schema)


def integers(path: str = VOCABULARY) -> list[bytes]:
    """Each id as a little-endian unsigned 32-bit integer."""
    return [i.to_bytes(4, "little") for i in range(len(vocabulary(path)))]


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY, as_integers: str | None = None) -> DataFrame:
    """rows with the bytes that their ids stand for and, in a column of its own if one is named, the ids as integers."""
    return concatenated(rows, ids, {out: list(vocabulary(path))} | ({as_integers: integers(path)} if as_integers else {}))
