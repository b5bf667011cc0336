"""Cases that the shared fixture doesn't reach: clashing names, many copies, very long words, new letters."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidegraph.llm import byte_bpe, common, packing, queries, simhash_dedup, substring_dedup, suffix_dedup, url_filter


def covered(texts, length):
    seen = Counter(b[i : i + length] for t in texts for b in [t.encode()] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("most_records", [1, 1 << 12])
def test_suffix_dedup_of_an_anchor_with_many_records(spark, most_records):
    """Texts that share one passage between different neighbours, judged by transforms and by counted windows."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(90)
    texts = [noise(rng.randint(0, 60)) + passage + noise(rng.randint(0, 60)) for _ in range(300)] + [passage[:70] + noise(30)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.strip(docs, length=60, gram=12, block=12, most_records=most_records).collect()
    assert {r["doc_id"]: bytes(r["kept_bytes"]) for r in got} == dict(enumerate(covered(texts, 60)))


def test_suffix_dedup_keeps_columns_that_clash(spark):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(500))
    rows = [(1, text, "a", 7, "b", 0), (2, text, "c", 8, None, 0), (None, None, "d", None, "e", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, spans int, _key string, n_removed bigint").withColumnRenamed("_key", "Anchors")
    got = suffix_dedup.strip(docs)
    assert got.columns == ["doc_id", "text", "key", "spans", "Anchors", "kept_bytes", "n_bytes", "n_removed", "n_spans"]
    assert {(*r[:5], bytes(r[5]), *r[6:]) for r in got.collect()} == {
        (1, text, "a", 7, "b", b"", 500, 500, 1), (2, text, "c", 8, None, b"", 500, 500, 1), (None, None, "d", None, "e", b"", 0, 0, 0)
    }
    kept = suffix_dedup.strip(docs, cleaned=True)
    assert kept.columns == docs.columns
    assert {(r["key"], r["text"]) for r in kept.collect()} == {("a", ""), ("c", ""), ("d", None)}


def test_byte_bpe_equals_the_library(spark):
    """Words beyond the length that is folded merge by merge, runs of one letter, and letters newer than Java's."""
    import public_tokenizers
    import tiktoken

    ranks = {piece: i for i, piece in enumerate(byte_bpe.vocabulary()) if piece}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    letters = lambda n, some: "".join(rng.choice(some) for _ in range(n))
    texts = [letters(n, some) for n in (63, 64, 65, 66, 200, 1500) for some in ("a", "ab", "etaoins", "日本語文字", "éèß", "-", " ")]
    texts += ["aࡰb ࡰ 1\U00010d40 \U000105c0x!", "Ᲊᲊ's \U0001e030\U0001e06d12", "x" * 20000, "   a \n\nb", None, "", "it's they'll 12ab"]
    texts += [letters(300, "the and ing of. 09'\n\t") for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, words string").repartition(2)
    made = byte_bpe.decode(byte_bpe.encode(docs, chunk_bytes=500, most_words=50, sample_rows=40, common_words=30))
    assert made.columns == ["doc_id", "text", "words", "ids", "decoded"]
    for r in made.collect():
        text = r["text"] or ""
        assert list(r["ids"]) == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["words"] == "w"


def test_words_are_cut_in_arrays_as_by_the_pattern(spark):
    """Rows of endings, white space and other scripts, null, empty, sliced or no text at all; no expression of Spark makes words."""
    import public_tokenizers
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(5)
    parts = [*"abst'remvld'  \n\t09.é日\u3000\x1c\x85\U0001d7ce!-\U00010d40", "'s", "'re", "'ll", " '", "''", "'d", "a'", "  "]
    for k in range(1500):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        column = pa.array(["zz's ", *texts], pa.string()).slice(1) if k % 2 else pa.array(texts, pa.string())
        assert byte_bpe.words(column).to_pylist() == [pattern.findall(t or "") for t in texts]
    assert byte_bpe.words(pa.array([b"a\xff b", b"x's"], pa.binary())).to_pylist() == [["a", "\ufffd", " b"], ["x", "'s"]]
    docs = spark.createDataFrame([(1, "it's  so")], "doc_id bigint, text string")
    assert "regexp_extract_all" not in byte_bpe.encode(docs)._jdf.queryExecution().toString()


def test_every_piece_folds_to_itself():
    """What folding all pairs of one rank at once rests on: a piece is made by merges of lower ranks alone."""
    pieces = byte_bpe.vocabulary()
    ranks = {p: i for i, p in enumerate(pieces) if p}
    for piece in pieces:
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert rank < 1 << 30
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_url_filter_knows_keys_of_any_depth(spark):
    """Prefixes of many segments, domains of many labels, a bracketed host, and a column named as a result."""
    deep, long = "h.org/" + "/".join("abcdefgh"), ".".join("abcdefghij") + ".example.net"
    entries = spark.createDataFrame(
        [(deep, "block", "deep", "2024-02-01"), ("." + long, "block", "long", "2024-01-01"), ("[::1]", "block", "six", "2024-01-01"), ("." + ".".join(f"l{i}" for i in range(60)), "allow", "labels", "2024-01-01")],
        "key string, action string, rule string, day string",
    ).selectExpr("key", "action", "rule", "date(day) day")
    urls = [f"https://{deep}/x?y", f"https://{deep}", "https://h.org/a/b/c", f"http://z.{long}/", "http://[::1]:80/p", "http://" + ".".join(f"l{i}" for i in range(60)) + "/", None, "no url"]
    captures = spark.createDataFrame([(i, u, "2024-03-01", "mine") for i, u in enumerate(urls)] + [(99, urls[0], "2024-01-31", "mine")], "page_id int, url string, fetch_day string, Action string")
    captures = captures.selectExpr("page_id", "url", "date(fetch_day) fetch_day", "Action")
    got = url_filter.judge(captures, entries, "2024-01-01", "2024-12-31").collect()
    assert {r["page_id"]: (r["action"], r["rule"]) for r in got} == {
        0: ("block", "deep"), 1: ("block", "deep"), 2: ("allow", None), 3: ("block", "long"), 4: ("block", "six"), 5: ("allow", "labels"), 6: ("allow", None), 7: ("allow", None), 99: ("allow", None)
    }
    assert url_filter.judge(captures.limit(0), entries.limit(0), "2024-01-01", "2024-12-31").count() == 0


def test_packing_equals_the_tokenizer(spark):
    """Every id of every document, in order, against the tokenizers library; little padding."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé 日.,!\n'9") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " ", "a" * 5000] + [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(60)]
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, packing.END_OF_DOCUMENT] for i, t in enumerate(texts)}
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)).collect()
    at = dict.fromkeys(want, 0)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]]
        part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
        assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at[p["doc_id"]], len(ids), zlib.crc32(part.tobytes()))
        at[p["doc_id"]] += p["length"]
    assert at == {i: len(ids) for i, ids in want.items()}
    filled = Counter()
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled.values())
    assert max(filled.values()) <= 2048 and padding <= 0.05 * sum(filled.values()) + 2048


def test_simhash_fingerprint_bit_by_bit():
    rng = random.Random(9)
    texts = ["", " \t\n", "One", "a b c", "a b c d", "A  b\x0bC d e", "é É x y z", "x " * 300] + [" ".join(rng.choice("pqrst") for _ in range(rng.randint(4, 40))) for _ in range(30)]
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash_dedup.fingerprint(t) == want


def spark_hash(*values):
    """xxhash64 over columns: each value's hash with the one before as its seed, nulls left out."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def winnowed(text):
    """(hash, position) pairs: of every 16 neighbouring 5-grams the smallest hash, the rightmost among equals."""
    h = [spark_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = [(spark_hash(*h[i : i + 5]) % (1 << 64)) >> 24 for i in range(max(len(h) - 4, min(len(h), 1)))]
    windows = [range(i, i + 16) for i in range(len(grams) - 15)] if len(grams) > 16 else [range(len(grams))] if grams else []
    return sorted({min(((grams[i], -i) for i in w)) for w in windows}, key=lambda e: -e[1])


def test_winnow_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    texts = [None, "", " \n", "one", "a b c d", "a b c d e", "x " * 90, "é ü 日本 " * 9] + [" ".join(word() for _ in range(rng.choice([3, 15, 20, 21, 60, 300]))) for _ in range(25)]
    texts.append(texts[-1])
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, entries string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op8_winnow(spark, str(tmp_path)).collect()}
    said = [t or "" for t in texts]
    show = lambda f: ",".join(f"{h:x}@{-i}" for h, i in f)

    def near(a, b):
        x, y = {h for h, _ in a}, {h for h, _ in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, text in enumerate(said):
        following = said[i - 1]  # the next in descending order; after the last the first
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        a, b, c = map(winnowed, (text, edit, following))
        r = got[i * 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (show(a), show(b))
        assert abs(r["near_edited"] - near(a, b)) < 1e-12 and abs(r["near_next"] - near(a, c)) < 1e-12


def test_anchors_of_records_against_brute_force():
    """The rightmost smallest of every window, and records that hold each window inside a row once."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 4, 200).astype(np.uint64) << np.uint64(40) | rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 7, 169, 200):
        upper = (values >> np.uint64(32)).tolist()
        want = [min(range(i, i + width), key=lambda k: (upper[k], -k)) for i in range(200 - width + 1)]
        assert suffix_dedup.least(values, width).tolist() == want
    rows = ["".join(rng.choice(list("abc"), int(n))) for n in (50, 0, 19, 20, 45, 21, 0)] + [None]
    r = suffix_dedup.Records(pa.array(rows), 20, 6)
    data, names = r.data.tobytes(), {}
    held = sorted(p for a, b in zip(r.first.tolist(), r.last.tolist(), strict=True) for p in range(a, b + 1))
    assert held == [int(r.bounds[i]) + p for i, t in enumerate(rows) for p in range(len(t or "") - 19)]
    for a, b, h in zip(r.first.tolist(), r.last.tolist(), r.hash.tolist(), strict=True):
        assert all(names.setdefault(data[p : p + 20], h) == h for p in range(a, b + 1))


def test_decoding_joins_pieces_by_batch(spark):
    """Null and unknown ids and null lists give nothing; both columns come from one pass over arrays."""
    pieces = byte_bpe.vocabulary()
    n = len(pieces)
    listed = [[1, 2, 300], None, [], [None, 5, -1, n, n + 7, 6], [n - 1] * 3]
    rows = spark.createDataFrame([(i, x, "old") for i, x in enumerate(listed)], "i int, ids array<int>, decoded string")
    made = byte_bpe.decode(rows.coalesce(1), as_integers="numbers")
    assert made.columns == ["i", "ids", "decoded", "numbers"]
    for r in made.collect():
        known = [k for k in listed[r["i"]] or [] if k is not None and 0 <= k < n]
        assert r["ids"] == listed[r["i"]] and bytes(r["decoded"]) == b"".join(pieces[k] for k in known)
        assert bytes(r["numbers"]) == struct.pack(f"<{len(known)}I", *known)
    assert byte_bpe.decode(rows.where("false")).count() == 0


def test_word_bounds_of_any_rows():
    rng = random.Random(3)
    for _ in range(300):
        rows = [bytes(rng.choice(b"ab \n\t\x0b\x0c\r\x1c") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        data = np.frombuffer(b"".join(rows), np.uint8)
        start, end, row = common.word_bounds(data, np.cumsum([0, *map(len, rows)]))
        words = [(k, w) for k, r in enumerate(rows) for w in re.findall(rb"[^\x20\x09-\x0D]+", r)]
        assert [(k, data[a:b].tobytes()) for k, a, b in zip(row, start, end, strict=True)] == words


def test_substring_dedup_hashes_windows_of_the_first_copy_alone(spark, monkeypatch):
    """Two texts that differ in one word, many times each, by turns: later copies cost stretches, not windows."""
    made, in_arrow = [], substring_dedup.in_arrow
    monkeypatch.setattr(substring_dedup, "in_arrow", lambda *args: made.append(in_arrow(*args)) or made[-1])
    words = [f"w{random.Random(8).random() + i}" for i in range(150)]
    texts = [" ".join(words), " ".join([*words[:70], "other", *words[71:]])]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(40)], "doc_id bigint, text string")
    substring_dedup.strip(docs)
    [rows] = [d.count() for d in made if "window" in d.columns]
    assert rows <= 2 * 101 + 5 * 40


def test_substring_dedup_cuts_batches_at_rows(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 40)
    texts = ["a" * n for n in (0, 39, 1, 0, 90, 5, 5, 5, 30, 0, 200, 0)]
    for low in range(len(texts)):
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[i] * i for i in range(len(texts))])], ["text", "l"]).slice(low)
        parts = list(substring_dedup.pieces(batch))
        assert pa.concat_batches(parts).equals(batch)
        assert all(sum(map(len, p["text"].to_pylist()[1:])) < 40 for p in parts)


def test_substring_dedup_of_few_words(spark):
    """Passages over three letters: anchors with many records, records that repeat within a text, rows that share a doc_id."""
    rng = random.Random(11)
    say = lambda n: [rng.choice("abc") for _ in range(n)]
    passage = say(25)
    texts = [say(rng.randint(0, 40)) for _ in range(60)] + [say(rng.randint(0, 9)) + passage + say(rng.randint(0, 9)) for _ in range(40)] + [["a"] * 30, ["a"] * 40]
    ids = [rng.choice([None, *range(70)]) for _ in texts]
    rows = [(d, " ".join(w)) for d, w in zip(ids, texts, strict=True)]
    rows += rows[:9]
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for i in range(len(t.split()) - 7):
            k = tuple(t.split()[i : i + 8])
            first[k] = min(first.get(k, order(d)), order(d))
    want = []
    for d, t in rows:
        w = t.split()
        gone = [any(first[tuple(w[i : i + 8])] < order(d) for i in range(max(0, j - 7), min(j, len(w) - 8) + 1)) for j in range(len(w))]
        edges = np.flatnonzero(np.diff([0, *gone, 0])).tolist()
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), list(zip(edges[::2], edges[1::2], strict=True))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(*r[:4], [tuple(s) for s in r["spans"]]) for r in substring_dedup.strip(docs, 8, 3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
