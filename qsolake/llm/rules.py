"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once: the ledger stores a document's measurements and one failure bit for each rule.
A policy is a version name and a mask of the rules it enforces; applying one, or asking what each of its rules
rejects alone (an ablation), is arithmetic on the bits and never reads a text again.

Defined cases: a null or empty text has no words and fails the word count; ids may be null or repeated; an empty
table gives an empty ledger; columns that are named like a ledger column are replaced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsolake.llm.common import BLANKS, with_let

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """fails is true where a document breaks the rule; it reads measurement columns only."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 20 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that each enforces.
POLICIES = {
    "v1-base": BASE,
    "v2-shape": (*BASE, "short_words", "long_words"),
    "v3-full": tuple(r.name for r in RULES),
}
CURRENT = "v3-full"


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found at least twice; hashes are the windows' hashes in text order.

    Equal windows become neighbours in one sort; each repeated window adds the words that no earlier one covers."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, i, j: s[i]["h"] == s[j]["h"]

    def repeats(s: Column) -> Column:
        last = F.size(s) - 1
        near = F.transform(
            s,
            lambda x, k: F.when(
                F.when(k > 0, same(s, k, k - 1)).otherwise(False) | F.when(k < last, same(s, k, k + 1)).otherwise(False),
                x.getField("i"),
            ),
        )
        return F.array_sort(F.filter(near, lambda x: x.isNotNull()))

    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct(
            (acc.getField("n") + F.least(F.lit(3), x - acc.getField("last"))).alias("n"), x.alias("last")
        ),
        lambda acc: acc.getField("n"),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
        with_let(placed, lambda s: with_let(repeats(s), covered))
    )


def measurements(text: Column) -> Column:
    """One struct of all measurements, so that the words of a text are made once."""
    text = F.coalesce(text, F.lit(""))
    content = F.length(F.translate(text, BLANKS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)

    def of(w: Column) -> Column:
        windows = F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            with_let(windows, repeated_words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    split = F.split(text, "[\\x20\\x09-\\x0D]+")
    return F.struct(
        with_let(F.filter(split, lambda w: w != ""), of).alias("w"),
        with_let(lines, of_lines).alias("l"),
        content.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failure_bits, one row for each row of docs."""
    m = docs.select(F.col(id_col).alias("doc_id"), measurements(F.col(text_col)).alias("m")).select(
        "doc_id", "m.w.n_words", "m.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words"
    )
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return m.withColumn("failure_bits", bits)


def apply_policy(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    return ledger.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """version, rule, n_kept, n_kept_without_rule, n_failed: from at most 2^rules distinct bit sets."""
    sets = ledger.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    policies = ledger.sparkSession.createDataFrame(
        [(v, r.name, mask(names), mask(names) & ~(1 << r.bit), 1 << r.bit) for v, names in POLICIES.items() for r in RULES if r.name in names],
        "version string, rule string, mask long, rest long, bit long",
    )
    passes = lambda m: F.sum(F.when(F.col("failure_bits").bitwiseAND(F.col(m)) == 0, F.col("n")).otherwise(0))
    return (
        sets.join(F.broadcast(policies))  # bit sets x rules, both of fixed size
        .groupBy("version", "rule")
        .agg(passes("mask").alias("n_kept"), passes("rest").alias("n_kept_without_rule"), F.sum(F.when(F.col("failure_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"))
    )
