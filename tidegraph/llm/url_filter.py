"""URL filters by a temporal list join.

List entries are dated: an entry adds or removes a rule for a host, a domain with all below it, or a URL prefix. The
entries of one key, in order of date, become validity intervals: each holds from its date to the next entry's. A
capture asks for the keys that could name it (its host, all domains above it, all its leading paths, as far as the
list's longest key goes) and an as-of join
keeps the interval that holds at the capture's fetch time; entries dated later have no effect. The most specific rule
decides, and a rule that allows wins over one that blocks at the same specificity.

Captures meet the lists on (key, bucket of dates): an interval stands once for every bucket that it touches, a capture
in its own alone. So a host with a third of all captures is spread over the buckets, and each capture finds one
interval of a key at most. What the join returns is one row per rule that holds, which is then reduced by capture;
both use DataFrame functions alone. Keys with no entry leave the join at once.

Defined cases: a null or unparsable URL, or a null fetch time, matches no rule and is allowed; captures that repeat
are judged each for itself, and share a verdict; of entries for one key with equal dates the last by (action, rank)
holds; null keys or dates in a list are ignored; an empty list allows all; columns named as the results are replaced,
all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that one bucket of the join spans.
BUCKET_DAYS = 32
#: Levels: a domain's is the number of its labels, a host's and a path's lie above all of those.
HOST_LEVEL = 1000
FAR = "9999-01-01"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)
    return F.when(F.length(host) > 0, F.lower(F.regexp_replace(host, r"\.$", "")))


def keys_of(url: Column, deepest: Column) -> Column:
    """array<struct<key, level>>: every key of at most `deepest` labels or segments that could name the URL, more specific ones with a higher level."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    upto = lambda size: F.filter(F.sequence(F.lit(1), F.greatest(F.least(size, deepest), F.lit(1))), lambda i: i <= size)
    domains = F.transform(upto(n), lambda i: F.struct(F.concat(F.lit("."), F.array_join(F.slice(labels, n - i + 1, i), ".")).alias("key"), i.alias("level")))
    paths = F.transform(upto(F.size(parts)), lambda i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"), (i + HOST_LEVEL).alias("level")))
    own = F.array(F.struct(host.alias("key"), F.lit(HOST_LEVEL).alias("level")))
    return F.when(host.isNotNull(), F.concat(domains, own, paths)).otherwise(F.slice(own, 1, 0))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, rule, valid_from, valid_to) of dated entries (key, action, rule, day); action remove ends a rule."""
    ordered = Window.partitionBy("key").orderBy("day", "action", "rule")
    rows = entries.select("key", "action", "rule", "day").where("key is not null and day is not null and action is not null")
    spans = rows.withColumn("valid_to", F.coalesce(F.lead("day").over(ordered), F.lit(FAR).cast("date")))
    return spans.withColumnRenamed("day", "valid_from").where("valid_from < valid_to and action <> 'remove'")


def bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS).cast("int")


def judge(captures: DataFrame, entries: DataFrame, first_day: str, last_day: str, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """captures with `action` (allow or block), `rule`, `level` and `n_rules` (how many held at its fetch time).

    first_day and last_day bound the fetch days, so that an open interval stands for a known number of buckets.
    Captures outside them are judged too, by the intervals that are open there.
    """
    names = [c for c in captures.columns if c.lower() not in ("action", "rule", "level", "n_rules")]
    low, high = bucket(F.lit(first_day).cast("date")), bucket(F.lit(last_day).cast("date"))

    def within(b: Column) -> Column:
        return F.least(F.greatest(b, low), high)

    spans = intervals(entries)
    start, end = within(bucket(F.col("valid_from"))), within(bucket(F.date_sub("valid_to", 1)))
    deepest = spans.agg(F.coalesce(F.max(F.greatest(F.size(F.split("key", "/")), F.size(F.split("key", r"\.")))), F.lit(1)).alias("n")).scalar()
    listed = spans.withColumn("_bucket", F.explode(F.sequence(start, end)))
    rows = captures.select(F.struct(*names).alias("_row"), F.col(url).alias("_url"), F.col(day).alias("_day"))
    # equal (url, day) pairs share a verdict: they are judged once, however many captures repeat them
    asked = rows.select("_url", "_day").where("_url is not null and _day is not null").distinct()
    wanted = asked.withColumn("_deepest", deepest).select("_url", "_day", within(bucket(F.col("_day"))).alias("_bucket"), F.inline(keys_of(F.col("_url"), F.col("_deepest"))))
    holding = wanted.join(listed, ["key", "_bucket"]).where("_day >= valid_from and _day < valid_to")
    best = F.max(F.struct("level", (F.col("action") == "allow").alias("allows"), "rule")).alias("_best")
    verdicts = holding.groupBy("_url", "_day").agg(best, F.count("*").alias("n_rules"))
    joined = rows.join(verdicts, ["_url", "_day"], "left")
    return joined.select(
        "_row.*",
        F.when(F.col("_best.allows") | F.col("_best").isNull(), "allow").otherwise("block").alias("action"),
        F.col("_best.rule").alias("rule"),
        F.col("_best.level").alias("level"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
    )
