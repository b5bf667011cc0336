"""String and hash functions of the graph layer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(pattern: str | list[str], column: Column) -> Column:
    """Whether a column matches a glob, or any of several; * is the only wildcard and doesn't cross a line's end."""
    if not isinstance(pattern, str):
        hit = F.lit(False)
        for p in pattern:
            hit = hit | glob(p, column)
        return hit
    if pattern == "*":
        return F.lit(True)
    if "*" not in pattern:
        return column == pattern
    head = pattern[: pattern.index("*")]
    body = column.rlike("\\A" + "[^\\n\\r\\u2028\\u2029]*".join(re.escape(p) for p in pattern.split("*")) + "\\z")
    return column.startswith(head) & body if head else body  # the prefix reaches the scan as a filter


def encode_dot(writer: Column, counter: Column) -> Column:
    return F.concat(writer, F.lit(":"), counter.cast("string"))


def decode_dot(dot: Column) -> Column:
    """struct<writer, counter>, parted at the last colon; null if the text is no dot."""
    writer = F.regexp_extract(dot, "(?s)^(.+):([1-9][0-9]*)$", 1)
    counter = F.regexp_extract(dot, "(?s)^(.+):([1-9][0-9]*)$", 2)
    return F.when(writer != "", F.struct(writer.alias("writer"), F.try_to_number(counter, F.lit("9999999999999999999")).cast("long").alias("counter")))


def shard_key(column: Column) -> Column:
    """Two hexadecimal digits: the first two of a 40- or 64-digit id, else the low byte of FNV-1a over its UTF-8 bytes."""
    digits = F.hex(F.encode(column, "UTF-8"))
    size = (F.length(digits) / 2).cast("int")
    byte_at = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte_at(i)) * 0x01000193).bitwiseAND(mask)
    low = F.reduce(F.sequence(F.lit(1), size), F.lit(0x811C9DC5).cast("long"), step)
    fnv = F.when(size == 0, F.lit(0x811C9DC5).cast("long")).otherwise(low)
    hashed = F.lower(F.lpad(F.hex(fnv.bitwiseAND(F.lit(255).cast("long"))), 2, "0"))
    return F.when(column.rlike("\\A(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\\z"), F.lower(F.substring(column, 1, 2))).otherwise(hashed)
