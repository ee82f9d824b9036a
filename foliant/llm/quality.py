"""Quality rules as a bitmask ledger.

measure() reads each text once and stores measurements; ledger() evaluates every rule once and stores a bit for each
failed rule; apply_policy() and ablation() then work on bits alone, so a new policy never reads a text again.

Nulls and texts without a word have all measurements 0 and fail the rules that ask for words. Very long texts are
measured whole. Repeated rows are judged each on their own; an empty table gives an empty ledger; input columns that
have the name of a measurement are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.base import annotate, field, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WINDOW = 8

#: Rule name -> failing condition over the measurements. A rule's bit is its place here; new rules go to the end.
RULES: dict[str, callable] = {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbols": lambda: 4 * F.col("n_symbols") > F.col("n_words"),
    "duplicate_lines": lambda: (F.col("n_lines") >= 5) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
}
BASE = ("few_words", "repeated_words")

#: Policy version -> rules that reject a document. Published versions never change.
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: tuple(RULES)}


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of so many words which occurs twice or more. Exact: windows are compared by rank."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    size = 1
    while size < window:  # double the length that a rank stands for; the last step may overlap
        step = min(size, window - size)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank, size = np.unique(pair, return_inverse=True)[1], size + step
    hit = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at exactly the six separators
    seen: set[str] = set()
    lines = copies = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            copies += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        copies,
        repeated_words(words),
        lines,
    )


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    def make():
        return lambda texts: list(zip(*map(measure_text, texts), strict=True)) if texts else [[]] * len(MEASURES)

    return annotate(docs, make, [field(m, "long") for m in MEASURES], text, carry)


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The measurements and failed_rules, a long with one bit for each rule of RULES."""
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text, carry).withColumn("failed_rules", total)


def passes(policy: int) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(entries: DataFrame, policy: int = max(POLICIES)) -> DataFrame:
    """Add base_failed and kept under a policy version, from the stored bits."""
    base = F.col("failed_rules").bitwiseAND(F.lit(mask(BASE))) != 0
    return entries.withColumns({"base_failed": base, "kept": ~base & passes(policy)})


def ablation(entries: DataFrame, policy: int = max(POLICIES)) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger shrinks first to one row for each combination of bits, of which there are at most 2 ** len(RULES).
    """
    rules = POLICIES[policy]
    combos = entries.groupBy(F.col("failed_rules").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    return (
        combos.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r).alias("name"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in rules])))
        .groupBy(F.col("rule.name").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("rule.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("rule.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("rule.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_policy(ledger(docs, carry=["doc_id"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed_rules"
    )
