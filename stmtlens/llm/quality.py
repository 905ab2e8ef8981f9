"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``fail_bits``
number, in which bit ``k`` says that rule ``k`` failed. A policy is a versioned set of rules, that is
a bit mask: applying one, or asking what each of its rules does to the corpus, needs the ledger and
never the texts again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import BLANKS

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
LETTER = r"\p{L}"  # of any script


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition over the measurements, in SQL that any engine reads."""

    bit: int
    name: str
    failed: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


TOO_SHORT, REPEATED_WORDS = "too_short", "repeated_words"
RULES = (
    Rule(0, TOO_SHORT, "n_words < 50"),
    Rule(1, REPEATED_WORDS, "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "4 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "few_letters", "2 * n_letter_words < n_words"),
)
BASE = Policy("base", 1, (TOO_SHORT, REPEATED_WORDS))
POLICIES = (
    BASE,
    Policy("prose", 1, (TOO_SHORT, REPEATED_WORDS, "symbols", "repeated_lines")),
    # Version 2 had the same rules, but counted Latin letters only.
    Policy("prose", 3, tuple(rule.name for rule in RULES)),
)
CURRENT = POLICIES[-1]


def policy_mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    known = {rule.name: rule.mask for rule in rules}
    return sum(known[name] for name in dict.fromkeys(policy.rules))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often and deep ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array holds twice or more.

    The windows are sorted with their positions, so that equal ones are neighbours; the positions
    of those are widened to the words they cover.
    """

    def covered(ordered: Column) -> Column:
        def repeated(window: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1), F.get(ordered, i + 1)
            same = before["key"] == window["key"]
            return F.coalesce(same, F.lit(False)) | F.coalesce(
                after["key"] == window["key"], F.lit(False)
            )

        starts = F.filter(ordered, repeated)
        places = F.transform(
            starts, lambda window: F.array(*[window["at"] + k for k in range(3)])
        )
        return F.size(F.array_distinct(F.flatten(places)))

    def over(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("key"),
                i.alias("at"),
            ),
        )
        return F.when(F.size(w) < 4, 0).otherwise(_bound(F.sort_array(windows), covered))

    return _bound(words, over).cast("long")


def _repeat_lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return _bound(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of the whole text, one row per input row.

    A null or blank text has no words and all counts 0. Repeated rows are measured each. Other
    columns of the input are left out, whatever their names.
    """
    text = F.col("text")
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        .select("doc_id", "text", words.alias("words"))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            (F.length("text") - F.length(F.regexp_replace(text, NOT_SPACE, "")))
            .cast("long")
            .alias("word_chars"),
            F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
            _repeat_lines(text).alias("n_dup_lines"),
            _repeat_words(F.col("words")).alias("n_repeat_words"),
            F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
            F.size(F.filter("words", lambda w: w.rlike(LETTER)))
            .cast("long")
            .alias("n_letter_words"),
        )
    )


def ledger(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The measurements and ``fail_bits`` (long) of each document."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(rule.mask)).otherwise(0))
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(
    entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, out: str = "kept"
) -> DataFrame:
    """Add the verdict of a policy to ledger entries: kept if none of its rules failed."""
    return entries.withColumn(
        out, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0
    )


def ablation(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of a policy does: documents it fails, and those that only it rejects.

    The ledger shrinks to one row per distinct ``fail_bits`` (at most 2 to the number of rules)
    before anything else happens.
    """
    mask = policy_mask(policy, rules)
    kinds = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    chosen = [rule for rule in rules if rule.name in policy.rules]
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).alias("m")) for r in chosen])
    )
    return (
        kinds.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.m")) != 0, F.col("n")).otherwise(0))
            .alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.m"), F.col("n")).otherwise(0))
            .alias("n_only_this"),
            F.sum(
                F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.m"))) == 0, F.col("n"))
                .otherwise(0)
            ).alias("n_kept_without"),
        )
    )


def accepted(
    docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that a policy accepts, with all their columns and without a join."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    carried = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    judged = apply_policy(ledger(carried, id_col="row", text_col="text"), policy)
    return judged.where("kept").select("doc_id.*")
