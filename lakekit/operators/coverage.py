"""Which identifier occurrences no rule covers.

Occurrences have item_type, rel_path, id and context (the stripped line). Rules come from
``normalise_rules``. "Not covered by any rule" is "by no literal rule" and then "by no pattern
rule", so two anti-joins follow one another: a hash join, and a search over what it leaves.
Many pattern rules are searched through an index of what their matches and paths must hold.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lakekit.functions.paths import glob_to_regex
from lakekit.operators.matching import fits_broadcast
from lakekit.operators.rule_index import row_keys, rule_index
from lakekit.operators.skew import frequent
from lakekit.session import stored

INLINE_RULES = 64
STORED_AFTER = 16


def _java_pattern(written: Column) -> Column:
    """A pattern written for Python, as Java spells it.

    Named groups become plain ones, which keeps their numbers; a brace that opens no quantifier is a character;
    ``{,n}`` counts from 0; classes such as ``\\s`` cover more than ASCII.
    """
    unnamed = F.regexp_replace(written, r"\(\?P<[A-Za-z_]\w*>", "(")
    from_zero = F.regexp_replace(unnamed, r"(?<!\\)\{,(\d*)\}", "{0,$1}")
    braces = F.regexp_replace(from_zero, r"(?<!\\)(?<!\\[pPxNk])\{(?!\d+(?:,\d*)?\})", r"\\{")
    return F.when(F.rlike(braces, F.lit(r"\\[sSdDwWbB]")), F.concat(F.lit("(?U)"), braces)).otherwise(braces)


def _with_pattern(rules: DataFrame) -> DataFrame:
    """Rules with ``pattern``, null for literal rules, and whether it compiles."""
    compiles = F.expr("try_reflect('java.util.regex.Pattern', 'compile', pattern)").isNotNull()
    written = rules.withColumn("pattern", F.when(F.col("is_regex"), _java_pattern(F.col("find_value"))))
    return written.withColumn("_compiles", ~F.col("is_regex") | compiles)


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Pattern rules that do not compile, with a reason. They cover nothing, and rewriting refuses them."""
    refused = _with_pattern(rules).filter(~F.col("_compiles"))
    return refused.select(*rules.columns, F.lit("pattern does not compile").alias("reason"))


def compile_rules(rules: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add path_regexes and, for pattern rules, the group that holds the id; drop what cannot match.

    Pattern rules whose pattern does not compile cover nothing; ``rejected_rules`` lists them.
    ``keep`` names further columns to carry along.
    """
    no_escapes = F.regexp_replace("pattern", r"(?s)\\Q.*?(\\E|$)|\\.", "")
    no_classes = F.regexp_replace(no_escapes, r"\[\^?\]?[^\]]*\]", "")
    has_group = F.rlike(no_classes, F.lit(r"\((?!\?)|\(\?<[A-Za-z]"))
    return (
        _with_pattern(rules)
        .filter("_compiles")
        .select(
            *(keep or []),
            "find_value",
            "is_regex",
            "item_types",
            F.transform("file_paths", glob_to_regex).alias("path_regexes"),
            "pattern",
            F.when(F.col("is_regex"), has_group.cast("int")).alias("group_no"),
        )
    )


def in_scope(item_type: Column, rel_path: Column) -> Column:
    """A rule's scope, against the rule's own columns; the cheap test comes first."""
    types, paths = F.col("item_types"), F.col("path_regexes")
    of_type = (F.size(types) == 0) | F.coalesce(F.array_contains(types, item_type), F.lit(False))
    on_path = (F.size(paths) == 0) | F.coalesce(F.exists(paths, lambda p: F.rlike(rel_path, p)), F.lit(False))
    return of_type & on_path


def _agree(by: list[str] | None) -> tuple[list[Column], Column]:
    """Rule columns that occurrences must agree with, renamed for a join, and the condition."""
    renamed = [F.col(c).alias(f"_rule_{c}") for c in by or []]
    return renamed, reduce(and_, [F.col(c) == F.col(f"_rule_{c}") for c in by or []], F.lit(True))


def uncovered_by_literals(occurrences: DataFrame, compiled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Occurrences whose id no literal rule in scope names, compared case by case.

    A proven small rule table is broadcast. Beyond that both sides shuffle on the id. The occurrences
    are stored, as they come out of texts; a sketch over their ids tells the frequent ones, which are
    spread over salts by their share, and the rules of such an id are repeated per salt.
    """
    renamed, agree = _agree(by)
    literals = compiled.filter(~F.col("is_regex")).select(*renamed, "find_value", "item_types", "path_regexes")
    scope = agree & in_scope(F.col("item_type"), F.col("rel_path"))
    if fits_broadcast(literals):
        return occurrences.join(F.broadcast(literals), (F.col("id") == F.col("find_value")) & scope, "left_anti")
    occurrences = stored(occurrences, "occurrences")
    fans = frequent(occurrences, ["id"])
    spread = fans.spread(occurrences)
    repeated = fans.repeat(literals.distinct().withColumnRenamed("find_value", "id"), "_rule_salt")
    repeated = repeated.withColumnRenamed("id", "find_value")
    same = (F.col("id") == F.col("find_value")) & (F.col("_salt") == F.col("_rule_salt"))
    return spread.join(repeated, same & scope, "left_anti").drop("_salt")


def uncovered_by_patterns(
    occurrences: DataFrame, compiled: DataFrame, by: list[str] | None = None, inline: int = INLINE_RULES
) -> DataFrame:
    """Occurrences that no pattern rule in scope covers.

    Only the first match of a pattern on the line counts: with a group, group 1 must be the id,
    without one the match must hold it. A few rules become constant expressions, so each pattern
    is compiled once per task. More rules are indexed by what their matches or paths must hold, and
    an occurrence is searched only by the rules it shares a key with. Rules without a key, such as
    a pattern of classes alone, become constants in as many filters as they need.
    """
    renamed, _ = _agree(by)
    patterns = compiled.filter("is_regex").select(
        *renamed, "pattern", "group_no", "item_types", "path_regexes", "file_paths"
    )
    few = patterns.take(inline + 1)
    if not few:
        return occurrences
    if len(few) <= inline:
        return occurrences.filter(~_covered_by_any(few, by))
    numbered = patterns.distinct().withColumn("rule_no", F.monotonically_increasing_id())
    rules = stored(numbered, "patterns")
    index = stored(rule_index(rules), "rule-index")
    left = _uncovered_by_index(occurrences, rules, index, by)
    size, chunks, chunk = max(1, INLINE_RULES), 0, []
    for rule in rules.join(index, "rule_no", "left_anti").toLocalIterator():
        chunk.append(rule)
        if len(chunk) == size:
            left, chunks, chunk = left.filter(~_covered_by_any(chunk, by)), chunks + 1, []
            if chunks % STORED_AFTER == 0:
                left = stored(left, "uncovered")
    return left.filter(~_covered_by_any(chunk, by)) if chunk else left


def _uncovered_by_index(occurrences: DataFrame, rules: DataFrame, index: DataFrame, by: list[str] | None) -> DataFrame:
    """Occurrences that no indexed rule covers: found by key, searched, and left out by their number."""
    kinds = [row.kind for row in index.select("kind").distinct().orderBy("kind").collect()]
    if not kinds:
        return occurrences
    folders = index.filter(F.col("kind") == "folder").select(F.char_length("key").alias("n")).distinct().orderBy("n")
    lengths = [row.n for row in folders.collect()]  # at most the length of the longest path
    rows = stored(occurrences.withColumn("_row", F.monotonically_increasing_id()), "occurrences")
    keys = F.explode(row_keys(kinds, lengths, F.col("context"), F.col("rel_path"))).alias("_key")
    covers = _agree(by)[1] & in_scope(F.col("item_type"), F.col("rel_path")) & _covers()
    searched = ["_row", "id", "context", "item_type", "rel_path", *(by or [])]
    known = rules.join(index, "rule_no")
    if fits_broadcast(known):
        probes = rows.select(*searched, keys).select(*searched, "_key.kind", "_key.key")
        hits = probes.join(F.broadcast(known), ["kind", "key"]).filter(covers)
    else:
        # Only numbers and keys are shuffled here; a frequent key is spread over salts by its share.
        probes = stored(rows.select("_row", keys).select("_row", "_key.kind", "_key.key"), "row-keys")
        fans = frequent(probes, ["kind", "key"])
        met = fans.spread(probes).join(fans.repeat(index), ["kind", "key", "_salt"]).select("_row", "rule_no").distinct()
        hits = met.join(rows.select(*searched), "_row").join(rules, "rule_no").filter(covers)
    return rows.join(hits.select("_row").distinct(), "_row", "left_anti").drop("_row")


def _covers() -> Column:
    """Whether the first match of the rule beside an occurrence covers its id."""
    found = F.call_function("regexp_extract", F.col("context"), F.col("pattern"), F.col("group_no"))
    return F.when(F.col("group_no") == 1, found == F.col("id")).otherwise(F.contains(found, F.col("id")))


def _covered_by_any(rules: list[Row], by: list[str] | None) -> Column:
    return reduce(or_, [_covered_by(rule, by or []) for rule in rules])


def _covered_by(rule: Row, by: list[str]) -> Column:
    """One rule as a constant condition on an occurrence, cheap tests first."""
    tests = [F.col(c) == F.lit(rule[f"_rule_{c}"]) for c in by]
    if rule.item_types:
        tests.append(F.col("item_type").isin(rule.item_types))
    if rule.path_regexes:
        tests.append(reduce(or_, [F.rlike("rel_path", F.lit(p)) for p in rule.path_regexes]))
    found = F.regexp_extract("context", rule.pattern, rule.group_no)
    tests.append(found == F.col("id") if rule.group_no else F.contains(found, F.col("id")))
    return F.coalesce(reduce(and_, tests), F.lit(False))


def uncovered(occurrences: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Occurrences that no rule covers at all; ``by`` names columns a rule and what it covers share."""
    compiled = stored(compile_rules(rules, keep=[*(by or []), "file_paths"]), "compiled-rules")
    return uncovered_by_patterns(uncovered_by_literals(occurrences, compiled, by), compiled, by)
