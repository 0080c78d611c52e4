"""Quality rules: a ledger of failure bits and measurements, policies and ablations over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def repeated_window_words(words: Column, length: int = 3) -> Column:
    """How many words lie in a window of ``length`` words that occurs twice or more in the same text.

    Windows are sorted with their places, so equal ones are neighbours: no join and no shuffle.
    """

    def window(at: Column) -> Column:
        text = F.concat_ws(" ", F.slice(words, at + 1, F.lit(length)))
        return F.struct(F.xxhash64(text).alias("hash"), text.alias("text"), at.alias("at"))

    def same(one: Column, other: Column) -> Column:
        return (one["hash"] == other["hash"]) & (one["text"] == other["text"])

    def repeated(ordered: Column) -> Column:
        last = F.size(ordered) - 1

        def has_twin(item: Column, at: Column) -> Column:
            before = (at > 0) & same(item, F.get(ordered, at - 1))
            return before | ((at < last) & same(item, F.get(ordered, at + 1)))

        return F.filter(ordered, has_twin)

    places = F.sequence(F.lit(0), F.size(words) - length)
    twins = bound(F.sort_array(F.transform(places, window)), repeated)
    covered = F.flatten(F.transform(twins, lambda w: F.sequence(w["at"], w["at"] + (length - 1))))
    return F.when(F.size(words) < length, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every document; a null text measures like an empty one."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    split = docs.select("doc_id", content.alias("text"), words_of(F.col(text)).alias("words"), lines.alias("lines"))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(_SYMBOLS)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": bound(F.col("words"), lambda words: repeated_window_words(words)),
    }
    return split.select("doc_id", *[count.cast("long").alias(name) for name, count in counts.items()])


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document, by its measurements, that breaks the rule. Null is no failure."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """A version of what is enforced: a document is kept if it fails none of these rules."""

    version: str
    enforced: tuple[str, ...] = field(default=())

    def mask(self, rules: list[Rule]) -> int:
        known = [rule.name for rule in rules]
        return sum(1 << known.index(name) for name in self.enforced)


def default_rules() -> list[Rule]:
    """The rules in the order of their bits; a new rule takes the next bit, so old ledgers stay readable."""
    col = F.col
    return [
        Rule("few_words", col("n_words") < 50),
        Rule("repeated_windows", 100 * col("n_repeat_words") > 50 * col("n_words")),
        Rule("repeated_lines", 100 * col("n_dup_lines") > 50 * col("n_lines")),
        Rule("symbols", 100 * col("n_symbols") > 50 * col("n_words")),
        Rule("long_words", col("word_chars") > 12 * col("n_words")),
        Rule("short_words", col("word_chars") < 2 * col("n_words")),
    ]


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("1", (*BASE.enforced, "repeated_lines", "symbols", "long_words", "short_words"))


def ledger(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Measurements of every row plus ``failed_bits``, one bit per rule. Rows stay as they are many.

    Nothing but ``doc_id`` and the text is read, so other columns may have any name. Each document is
    judged inside its row: no shuffle, and one source or key may hold any share of the rows.
    """
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules or default_rules()):
        bits = bits + F.when(rule.fails, F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(docs).withColumn("failed_bits", bits)


def fails(policy: Policy, rules: list[Rule] | None = None) -> Column:
    """Whether a row of a ledger fails a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules or default_rules())).cast("long")) != 0


def ablations(entries: DataFrame, policies: list[Policy], rules: list[Rule] | None = None) -> DataFrame:
    """For each policy and each rule it enforces, by bits alone: documents failing the rule, and those that
    fail no other enforced rule, which leaving the rule out would bring back.

    The ledger is first counted by its bits, so what is compared has a row per combination of failures.
    """
    rules = rules or default_rules()
    cases = [
        F.struct(
            F.lit(policy.version).alias("version"),
            F.lit(rule.name).alias("rule"),
            F.lit(1 << place).cast("long").alias("bit"),
            F.lit(policy.mask(rules)).cast("long").alias("mask"),
        )
        for policy in policies
        for place, rule in enumerate(rules)
        if rule.name in policy.enforced
    ]
    failed, bit = F.col("failed_bits"), F.col("bit")
    enforced = failed.bitwiseAND(F.col("mask"))
    held = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    return (
        held.select("failed_bits", "n", F.inline(F.array(*cases)))
        .groupBy("version", "rule")
        .agg(
            F.sum("n").alias("documents"),
            F.sum(F.when(failed.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(enforced == bit, F.col("n")).otherwise(0)).alias("only_this"),
            F.sum(F.when(enforced == 0, F.col("n")).otherwise(0)).alias("kept"),
        )
    )
