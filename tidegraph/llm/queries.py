"""The thin queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import byte_bpe, chat_format, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, url_filter, winnow
from tidegraph.llm.common import in_arrow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


FIRST_DAY, LAST_DAY = "2024-01-01", "2024-12-31"


def op1_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the URLs' hosts: for domains, hosts and first path segments."""
    host, segment, v = F.col("host"), F.col("segment"), F.col("v")
    named = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]+)", 1).alias("segment"))
    rows = named.where("host is not null").distinct().select("*", F.explode(F.array(*map(F.lit, range(6)))).alias("v"))
    domain = F.concat(F.lit("."), F.regexp_replace(host, r"^.*[.]([^.]+[.][^.]+)$", "$1"))
    key = F.when(v < 2, domain).when(v < 4, host).otherwise(F.concat(host, F.lit("/"), segment))
    shift = (F.length(host) * 31 + v * 97 + F.when(v < 4, 0).otherwise(F.length(segment) * 13)) % 366
    turn = (F.length(host) + v) % 3
    kind = F.when(v < 2, "domain").when(v < 4, "host").otherwise("prefix")
    return rows.select(
        key.alias("key"),
        F.when(turn == 0, "block").when(turn == 1, "allow").otherwise("remove").alias("action"),
        F.concat(kind, F.lit("-"), shift.cast("string")).alias("rule"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), shift.cast("int")).alias("day"),
    ).distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    judged = url_filter.judge(captures, op1_entries(pages), FIRST_DAY, LAST_DAY)
    return judged.select("page_id", "url", F.col("fetch_day").cast("string").alias("fetch_day"), "action", "rule", "level", "n_rules")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetch_day,
         lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) AS segment,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
e AS (
  SELECT DISTINCT
         CASE WHEN v < 2 THEN '.' || regexp_replace(host, '^.*[.]([^.]+[.][^.]+)$', '\1') WHEN v < 4 THEN host ELSE host || '/' || segment END AS key,
         CASE (length(host) + v) % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END AS action,
         CASE WHEN v < 2 THEN 'domain-' WHEN v < 4 THEN 'host-' ELSE 'prefix-' END ||
           CAST((length(host) * 31 + v * 97 + CASE WHEN v < 4 THEN 0 ELSE length(segment) * 13 END) % 366 AS VARCHAR) AS rule,
         DATE '2024-01-01' + CAST((length(host) * 31 + v * 97 + CASE WHEN v < 4 THEN 0 ELSE length(segment) * 13 END) % 366 AS INTEGER) AS day
  FROM (SELECT DISTINCT host, segment FROM p WHERE host IS NOT NULL) h, range(6) r(v)),
i AS (
  SELECT key, action, rule, day AS valid_from,
         coalesce(lead(day) OVER (PARTITION BY key ORDER BY day, action, rule), DATE '9999-01-01') AS valid_to
  FROM e),
k AS (
  SELECT page_id, fetch_day, host AS key, 1000 AS level FROM p WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, fetch_day, '.' || array_to_string(string_split(host, '.')[-n:], '.'), n::INTEGER FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) r(n)
  WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, fetch_day, host || '/' || array_to_string(parts[1:n], '/'), (n + 1000)::INTEGER FROM p, unnest(range(1, len(parts) + 1)) r(n)
  WHERE host IS NOT NULL),
m AS (
  SELECT page_id, max({'level': level, 'allows': action = 'allow', 'rule': rule}) AS best, count(*) AS n_rules
  FROM k JOIN i USING (key) WHERE action <> 'remove' AND fetch_day >= valid_from AND fetch_day < valid_to GROUP BY page_id)
SELECT page_id, url, CAST(fetch_day AS VARCHAR) AS fetch_day,
       CASE WHEN best IS NULL OR best.allows THEN 'allow' ELSE 'block' END AS action,
       best.rule AS rule, best.level AS level, coalesce(n_rules, 0)::BIGINT AS n_rules
FROM p LEFT JOIN m USING (page_id)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    base_spans = F.filter(spans, lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(span_string(base_spans), 256).alias("base_sha256"), span_string(spans).alias("spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.strip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
g AS (SELECT r, i, md5(array_slice(b, i, i + 199)) AS h FROM n, unnest(range(1, n - 198)) AS t(i)),
c AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM g WHERE h IN (SELECT h FROM c)),
t AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
u AS (SELECT r, k, min(i) AS a, max(i) + 199 AS z FROM t GROUP BY r, k),
v AS (SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS following FROM u),
p AS (SELECT r, z + 1 AS s, coalesce(following - 1, n) AS e FROM v JOIN n USING (r) UNION ALL SELECT r, 1, min(a) - 1 FROM u GROUP BY r),
q AS (SELECT r, string_agg(hex(array_slice(b, s, e)), '' ORDER BY s) AS x FROM p JOIN n USING (r) WHERE s <= e GROUP BY r),
m AS (SELECT r, sum(z - a + 1)::BIGINT AS gone, count(*) AS spans FROM u GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN gone IS NULL THEN b ELSE unhex(coalesce(x, '')) END) AS kept_sha256
FROM n LEFT JOIN m USING (r) LEFT JOIN q USING (r)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.strip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
f AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
c AS (SELECT DISTINCT r, i + x AS j FROM g JOIN f USING (h), range(50) AS t(x) WHERE doc_id > low OR (doc_id IS NULL AND low IS NOT NULL)),
k AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
m AS (
  SELECT k.r, count(c.j) AS gone, string_agg(word, ' ' ORDER BY k.j) FILTER (WHERE c.j IS NULL) AS kept
  FROM k LEFT JOIN c ON c.r = k.r AND c.j = k.j GROUP BY k.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (r)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    rows = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], decoded="decoded", as_integers="integers")
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2("integers", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.col("failed_bits")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (failed.bitwiseAND(F.lit(quality_rules.BASE_MASK).cast("long")) != 0).alias("base_failed"),
        quality_rules.verdict(quality_rules.POLICIES[quality_rules.CURRENT]).alias("kept"),
        "failed_bits",
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
t AS (
  SELECT doc_id, text, words, lines,
         list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS triples
  FROM w),
u AS (SELECT *, row_number() OVER () AS r FROM t),
g AS (SELECT r, unnest(triples) AS triple, unnest(range(len(triples))) AS i FROM u),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, triple) AS c FROM g),
k AS (SELECT DISTINCT r, i + x AS j FROM h, (VALUES (0), (1), (2)) v(x) WHERE c > 1),
n AS (SELECT r, count(*) AS n FROM k GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM u LEFT JOIN n USING (r)),
b AS (
  SELECT *,
         (n_words < 50)::BIGINT AS b0, (100 * n_repeat_words > 50 * n_words)::BIGINT AS b1,
         (100 * n_symbols > 10 * n_words)::BIGINT AS b2, (100 * n_dup_lines > 50 * n_lines)::BIGINT AS b3,
         (n_letters > 0 AND 100 * n_capitals > 60 * n_letters)::BIGINT AS b4,
         (word_chars > 25 * n_words OR word_chars < 2 * n_words)::BIGINT AS b5
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       b0 + b1 > 0 AS base_failed, b0 + b1 + b2 + b3 + b4 + b5 = 0 AS kept,
       b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 AS failed_bits
FROM b
"""


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.with_next(table(spark, sf_dir, "documents"))
    changed = rows.withColumn("edited", winnow.edited(F.col("text"), F.col("next_text")))
    made = changed.withColumn("edited_entries", winnow.entries(F.col("edited")))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        winnow.written_as(F.col("entries")).alias("fingerprint"),
        winnow.written_as(F.col("edited_entries")).alias("edited_fingerprint"),
        winnow.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        winnow.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = chat_format.apply_template(rows.unionByName(more))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, out = chat_format.template(), []
        for conv, formatted, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "ids", "loss_mask")), strict=True):
            turns, learned = t.read(ids), t.learned_text(ids, np.array(mask, bool))
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            digests = [hashlib.sha256(x.encode("utf-8", "surrogateescape")).hexdigest() for x in (told, learned)]
            out.append((conv, len(turns), digests[0], len(learned), digests[1], len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return in_arrow(made, each, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(regexp_extract_all(role, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|\[\\*/ANSWER\]'))
            + len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|\[\\*/ANSWER\]')) AS escapes
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(23 + CASE WHEN role = 'assistant' THEN 2 ELSE 0 END + length(role) + length(text) + escapes)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.group(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_winnow": op8_winnow,
    "op9_chat_format": op9_chat_format,
    "op10_simhash_dedup": op10_simhash_dedup,
}
ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op3_suffix_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_chat_format": OP9_SQL,
}
