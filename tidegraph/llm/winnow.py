"""Document fingerprints by winnowing, made of DataFrame functions alone.

The k-grams of a text's words are hashed; of every window of w consecutive hashes the smallest is kept, the rightmost
among equals, with its position. Any passage of w + k - 1 words that two texts share leaves a common hash, and no
passage of less than k words can. A hash and its position share one 64-bit integer (hash above, falling position
below), so a window's minimum settles ties by itself, and the minima of all windows take log2(w) passes of pairwise
minima, each over one row at a time. Nothing is shuffled.

Neighbours in an order over all documents come from a range partitioning: a document and the next one nearly always
lie in one range, where a window function finds it; only the ranges' edges, one row a range, are matched apart.

Defined cases: a null or empty text, or one of white space, has an empty fingerprint, and two empty ones are alike
(1.0); a text of less than k words is one gram; one of less than w grams is one window; documents with equal doc_id
are ordered by their texts' hashes, null doc_ids come last; positions count modulo 2**23.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 5, 16
#: Low bits of an entry: they hold the position, inverted so that the rightmost of equal hashes is the smallest.
POSITION_BITS = 23
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entries(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """array<bigint>: the chosen hashes with their positions, in order of position."""
    assert w & (w - 1) == 0, "windows are halved"
    mask = (1 << POSITION_BITS) - 1

    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1)))

        def gram(_: Column, i: Column) -> Column:
            value = F.xxhash64(*(F.get(h, i + j) for j in range(k)))
            place = F.lit(mask).cast("long") - i.cast("long").bitwiseAND(F.lit(mask).cast("long"))
            return F.shiftleft(F.shiftrightunsigned(value, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(place)

        return F.transform(F.slice(h, 1, n), gram)

    def halved(values: Column, step: int) -> Column:
        """Minima of windows twice as long; a text of fewer windows keeps what it has at its end."""
        return let(values, lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - step, F.least(F.size(v), F.lit(1)))), lambda x, i: F.least(x, F.coalesce(F.get(v, i + step), x))))

    def chosen(g: Column) -> Column:
        low, span = g, 1
        while span < w:
            low, span = halved(low, span), 2 * span
        return F.when(F.size(g) <= w, F.slice(F.array(F.array_min(g)), 1, F.least(F.size(g), F.lit(1)))).otherwise(F.array_distinct(low))

    hashed = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != ""), lambda x: F.xxhash64(x))
    return let(let(hashed, grams), chosen)


def hashes(entry: Column) -> Column:
    return F.transform(entry, lambda e: F.shiftright(e, POSITION_BITS))


def positions(entry: Column) -> Column:
    mask = (1 << POSITION_BITS) - 1
    return F.transform(entry, lambda e: (F.lit(mask).cast("long") - e.bitwiseAND(F.lit(mask).cast("long"))).cast("int"))


def written_as(entry: Column) -> Column:
    """hash@position of each, comma-joined."""
    place = positions(entry)
    return F.array_join(F.zip_with(hashes(entry), place, lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' sets of hashes; 1 if both are empty."""
    return let(
        F.struct(F.array_distinct(hashes(a)).alias("x"), F.array_distinct(hashes(b)).alias("y")),
        lambda s: let(
            F.size(F.array_intersect(s["x"], s["y"])).cast("double"),
            lambda both: F.when((F.size(s["x"]) + F.size(s["y"])) == 0, F.lit(1.0)).otherwise(both / (F.size(s["x"]) + F.size(s["y"]) - both)),
        ),
    )


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """docs with their entries; a column of that name is replaced."""
    return docs.withColumn(out, entries(F.col(text), k, w))


def ranged(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows with `_range`: ranges of falling doc_id of about equal size, nulls in the last one.

    The bounds come from a quantile sketch, a fixed number of values; a row's range is a function of the row, so a
    task that is run again deals its rows out as before.
    """
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    last = F.lit(len(cuts) + 1)
    if not cuts:
        return rows.withColumn("_range", F.when(F.col("doc_id").isNull(), last).otherwise(0))
    above = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c >= F.col("doc_id")))
    return rows.withColumn("_range", F.when(F.col("doc_id").isNull(), last).otherwise(above))


def with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(doc_id, text, entries, next_text, next_entries) of (doc_id, text) rows: the next row in descending order.

    The row after the last one is the first. Heads of ranges, one row each, are found by a join with the ranges' largest
    doc_ids, whose number is that of the ranges.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), F.length("text").desc()]
    rows = ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    own = F.struct("text", "entries")
    tops = F.broadcast(rows.groupBy("_range").agg(F.max("doc_id").alias("_top")))
    heads = rows.join(tops, "_range").where(F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).where("_n = 1")
    heads = heads.select("_range", "text").withColumn("entries", entries(F.col("text"), k, w)).select("_range", own.alias("_own"))
    along = Window.orderBy("_range")
    start = F.first("_own").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = heads.select(F.col("_range").alias("_of"), F.coalesce(F.lead("_own").over(along), start).alias("_after"))
    dealt = rows.withColumn("entries", entries(F.col("text"), k, w))
    linked = dealt.withColumn("_next", F.lead(own).over(Window.partitionBy("_range").orderBy(*order)))
    joined = linked.join(after, (F.col("_range") == F.col("_of")) & F.col("_next").isNull(), "left")
    found = joined.withColumn("_next", F.coalesce("_next", "_after"))
    return found.select("doc_id", "text", "entries", F.col("_next.text").alias("next_text"), F.col("_next.entries").alias("next_entries"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by as many, or all, of the following text's first ones."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
