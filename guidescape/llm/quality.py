"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
named, versioned mask over these bits, so verdicts under any policy and ablations of single rules are bit operations on the
ledger and never touch a text again. Only DataFrame functions are used.

Null and blank texts have no words and fail ``too_short``. Repeated rows get a row each. Columns other than doc_id and text
are not read. An empty table gives an empty ledger. Windows of three words are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from guidescape.llm.text import A_WORD, SPACES, words


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements; whole-number arithmetic, so that every engine agrees


#: A rule's place is its bit; new rules are appended.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("exclamations", "10 * n_exclamations > n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_words"]
POLICIES = {
    "base/1": BASE,
    "web/1": BASE | BIT["symbols"] | BIT["exclamations"] | BIT["repeated_lines"],
    "web/2": sum(BIT.values()),
}
CURRENT = "web/2"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated(windows: Column) -> Column:
    """Places, in order, of the windows that occur at least twice. ``windows``: sorted structs of (hash, place)."""
    last = F.size(windows) - 1
    return F.sort_array(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), last),
                lambda i: (F.get(windows, i)["h"] == F.get(windows, i - 1)["h"]).eqNullSafe(True)
                | (F.get(windows, i)["h"] == F.get(windows, i + 1)["h"]).eqNullSafe(True),
            ),
            lambda i: F.get(windows, i)["at"],
        )
    )


def _covered(places: Column) -> Column:
    """Words covered by windows starting at these places: three each, less what the next window covers again."""
    steps = F.transform(
        places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(3)), F.lit(3))
    )
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def measure(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns and the measurements, one pass over the texts without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(A_WORD))
    bare = _without(text, SPACES)
    rows = docs.select(
        *carried,
        words(F.col("text")).alias("_w"),
        lines.alias("_lines"),
        F.char_length(bare).alias("word_chars"),
        F.char_length(text).alias("_chars"),
        F.char_length(_without(text, "#*$%&|<>")).alias("_plain"),
        F.char_length(_without(text, "!")).alias("_calm"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("n_capitals"),
    )
    at = F.sequence(F.lit(0), F.size("_w") - 3)
    window = F.transform(
        at,
        lambda i: F.struct(
            F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("at")
        ),
    )
    windows = F.when(F.size("_w") >= 3, F.sort_array(window))
    rows = rows.select(
        *carried,
        F.size("_w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        (F.col("_chars") - F.col("_plain")).cast("long").alias("n_symbols"),
        (F.col("_chars") - F.col("_calm")).cast("long").alias("n_exclamations"),
        F.col("n_capitals").cast("long"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    rows = rows.withColumn("_places", _repeated(F.col("_windows")))
    # Adding nothing, but not a constant: else a filter on measurements would be pushed below, where every mention of one is
    # replaced by its nested definition, and the plan grows without bound.
    nothing = F.least(F.spark_partition_id(), F.lit(0))
    covered = F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("long") + nothing
    return rows.withColumn("n_repeat_words", covered).drop("_windows", "_places")


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements, and ``failed``: the bits of the rules that the document fails."""
    return measure(docs).withColumn("failed", failure_bits())


def passes(failed: Column, policy: str = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    return rows.withColumn("kept", passes(F.col("failed"), policy))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: rule, failing, only_rule (rejected by nothing else), rejected, rejected_without.

    The ledger is first counted by its failure bits (at most 2^rules groups, combined before the shuffle).
    """
    mask = POLICIES[policy]
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask]
    )
    per = counts.select("bits", "n", F.inline(named))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return per.groupBy("rule").agg(
        total(has).alias("failing"),
        total(alone).alias("only_rule"),
        total(F.col("bits") != 0).alias("rejected"),
        total((F.col("bits") != 0) & ~alone).alias("rejected_without"),
    )
