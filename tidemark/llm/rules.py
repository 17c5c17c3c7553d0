"""Quality rules as a ledger of bits, with versioned policies over it.

``ledger`` measures each text once and evaluates every rule once: a row keeps the measurements and one bit for each
rule that failed. A policy is a mask of rules, so applying another version, or asking what a rule alone decides, is
integer arithmetic on the ledger and never reads texts again. Everything is DataFrame functions in one map-only pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS
from .mixing import trimmed

#: Rules in the order of their bits: a text fails where the condition over its measurements holds.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
#: Rules of each version of the policy.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(RULES),
}
CURRENT = "v2"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


#: (hash of three words, place) pairs of ``words``, sorted. Arrays are bound as lambda variables, so that they are made once a row
#: even where the optimizer moves the expression into a filter.
GRAMS = """
    transform(array(words), ws -> sort_array(slice(
        transform(ws, (w, i) -> named_struct('h', xxhash64(w, get(ws, i + 1), get(ws, i + 2)), 'i', i)), 1, greatest(0, size(ws) - 2))))[0]"""

#: Words in three-word windows that stand at two or more places: neighbours with equal hashes are repeats, and the places that they
#: cover are summed in order, so the work is that of sorting the words.
REPEATED = """
    transform(array(grams), gs -> aggregate(
        sort_array(transform(
            filter(gs, (g, k) -> coalesce(g.h = get(gs, k - 1).h, false) or coalesce(g.h = get(gs, k + 1).h, false)),
            g -> g.i)),
        named_struct('n', 0L, 'to', 0),
        (a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.to), 'to', i + 3),
        a -> a.n))[0]"""


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) and fail_bits of each row.

    Null texts measure as empty ones: all zero. Rows are independent, so ties and repeats don't matter; only doc_id and
    text are read. An empty table gives no rows. A long text is one row with arrays of its words' size.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = trimmed(text)
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{BLANKS}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    blanks = " \t\n\x0b\f\r"
    first = docs.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, blanks, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = first.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(GRAMS).alias("grams"),
    )
    measured = counted.withColumn("n_repeat_words", F.expr(REPEATED)).drop("grams")
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits + F.when(F.expr(fails), F.lit(BITS[name])).otherwise(F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept``: no rule of that version failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0)


def ablations(rows: DataFrame, version: str = CURRENT, by: list[str] | None = None) -> DataFrame:
    """For each rule of a version (and each value of the columns ``by``): rows that fail it, and rows that it alone removes; also any_bits and all_bits, the union and the intersection of the rows' failures.

    Rows are first counted by their bits (at most 2 ** rules groups, combined before the shuffle).
    """
    by = by or []
    counts = rows.groupBy(*by, F.col("fail_bits").bitwiseAND(F.lit(mask(version))).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[version]))
    each = counts.withColumn("rule", F.explode(names)).select(*by, "bits", "n", "rule.*")
    failed = F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0))
    alone = F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0))
    return each.groupBy(*by, "rule").agg(failed.alias("failed"), alone.alias("removed_alone"), F.bit_or("bits").alias("any_bits"), F.bit_and("bits").alias("all_bits"))
