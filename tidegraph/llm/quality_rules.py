"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps what was measured and one bit per failed rule; a
policy is a versioned mask of the rules that it enforces, so a change of policy never reads a text again, and the
effect of each rule on a policy (its ablation) is a bitwise aggregate over the ledger. All of it is made of DataFrame
functions over one row at a time: no shuffle but the small one of the ablation's sums.

Repeated word triples are found by sorting pairs of hash and position, so a document of n words takes n log n steps.

Defined cases: a null text has no words; a text without words fails too_short; white space is space and tab to
carriage return alone; repeated rows are judged each for itself; columns that clash with the ledger's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import spare

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A rule has a fixed bit for ever; retired rules keep theirs."""

    bit: int
    name: str
    failed: str  # SQL over the measurements


#: Bits 0 and 1 are the base rules of the contract.
RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_triples", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "capitals", "n_letters > 0 and 100 * n_capitals > 60 * n_letters"),
    Rule(5, "word_length", "word_chars > 25 * n_words or word_chars < 2 * n_words"),
)
BASE_MASK = 0b11
#: Version of a policy: the rules that it enforces.
POLICIES = {1: BASE_MASK, 2: 0b001111, 3: 0b111111}
CURRENT = 3


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": words,
        "lines": lines,
        "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
    }


def repeat_words(words: Column) -> Column:
    """Words that lie in a triple of words which occurs twice or more, by the sorted triples' neighbours."""
    n = F.size(words)
    triples = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    # an array of one element binds the sorted triples, which are then sorted once and not for every lookup
    sorted_once = F.array(F.sort_array(triples))
    places = F.flatten(
        F.transform(
            sorted_once,
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
    )
    covered = F.transform(
        F.array(F.sort_array(places)),
        lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x
        ),
    )
    return F.get(covered, F.lit(0)).cast("long")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every measurement and `failed_bits`, a bigint with one bit per failed rule."""
    docs = docs.drop("failed_bits", *MEASURES)
    words, lines = spare(docs.columns, "_words", "_lines")  # columns of the caller's of these names stay
    found = measures(F.col(text))
    lists = docs.withColumns({words: found.pop("words"), lines: found.pop("lines")})
    found |= {
        "n_words": F.size(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(F.col(words)),
    }
    measured = lists.withColumns(found).drop(words, lines)
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total)


def verdict(mask: int) -> Column:
    """Whether a document of the ledger is kept under a policy's mask."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def keep(docs: DataFrame, policy: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns.

    The verdict is a generator of one row or none: a filter would be pushed below the ledger, and every measurement
    would be taken again for each rule that uses it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    mask = F.lit(POLICIES[policy]).cast("long")
    clean = F.filter(F.array("failed_bits"), lambda bits: bits.bitwiseAND(mask) == 0)
    return ledger(rows, "_text").select("_row", F.explode(clean).alias("_bits")).select("_row.*")


def ablations(ledger_rows: DataFrame, policies: dict[int, int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule: documents it fails, documents only it fails, and documents kept without it."""
    bits = F.col("failed_bits")
    sums = []
    for version, mask in sorted(policies.items()):
        for r in rules:
            own, others = 1 << r.bit & mask, mask & ~(1 << r.bit)
            hit = bits.bitwiseAND(F.lit(own).cast("long")) != 0
            free = bits.bitwiseAND(F.lit(others).cast("long")) == 0
            sums += [F.count_if(hit).alias(f"f{version}_{r.bit}"), F.count_if(hit & free).alias(f"o{version}_{r.bit}"), F.count_if(free).alias(f"k{version}_{r.bit}")]
    rows = [
        F.struct(F.lit(v).alias("policy"), F.lit(r.name).alias("rule"), F.lit(bool(m >> r.bit & 1)).alias("enforced"), *(F.col(f"{c}{v}_{r.bit}").alias(n) for c, n in (("f", "n_failed"), ("o", "n_failed_alone"), ("k", "n_kept_without"))))
        for v, m in sorted(policies.items())
        for r in rules
    ]
    return ledger_rows.agg(*sums).select(F.inline(F.array(*rows)))
