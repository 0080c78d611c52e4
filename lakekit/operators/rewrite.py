"""Rule-driven text rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.constants import ALL_ENVIRONMENTS
from lakekit.operators.coverage import compile_rules, rejected_rules
from lakekit.operators.cuts import cut
from lakekit.operators.matching import BROADCAST_ROWS, fits_broadcast, match
from lakekit.session import stored

# References a replacement may hold. The "$" before the attribute is optional.
ITEM_REFERENCE = r"^\$items\.([^.]+)\.(.+)\.\$?([A-Za-z]+)$"
SPACE_REFERENCE = r"^\$workspace\.\$?([A-Za-z]+)$"
SPACE_TYPE = "Workspace"

# A pattern with one group that stands by itself: flags, what precedes the group, the group, what follows it.
_ATOMS = r"(?:[^\\()\[\]|]++|\\[^0-9kQE]|\[\^?\]?(?:[^\]\\]|\\.)*+\])"
_ONE_GROUP = rf"^((?:\(\?[a-zA-Z]+\))*)({_ATOMS}*+)\(((?:{_ATOMS}|\|)*+)\)((?![?*+{{]){_ATOMS}*+)$"


def resolve_replacements(
    rules: DataFrame, inventory: DataFrame, environment: str, by: list[str] | None = None
) -> DataFrame:
    """Rules with ``replacement``, the value for one environment.

    ``replace_value`` maps an environment, or ``_ALL_``, to a text or a reference. References are
    looked up in the inventory rows (environment, type, name, attribute, value) of the
    environment; the space itself is the row of type ``Workspace`` with an empty name. ``by`` names
    columns that a rule and the inventory it may refer to share, such as the unit. What cannot be
    resolved stays null.
    """
    given = F.coalesce(
        F.try_element_at("replace_value", F.lit(environment)),
        F.try_element_at("replace_value", F.lit(ALL_ENVIRONMENTS)),
    )
    of_item = F.rlike("_given", F.lit(ITEM_REFERENCE))
    of_space = F.rlike("_given", F.lit(SPACE_REFERENCE))
    keyed = rules.withColumn("_given", given).select(
        "*",
        F.when(of_item, F.regexp_extract("_given", ITEM_REFERENCE, 1)).when(of_space, SPACE_TYPE).alias("_type"),
        F.when(of_item, F.regexp_extract("_given", ITEM_REFERENCE, 2)).when(of_space, "").alias("_name"),
        F.when(of_item, F.regexp_extract("_given", ITEM_REFERENCE, 3))
        .when(of_space, F.regexp_extract("_given", SPACE_REFERENCE, 1))
        .alias("_attribute"),
    )
    values = (
        inventory.filter(F.col("environment") == environment)
        .groupBy(*(by or []), F.col("type").alias("_type"), F.col("name").alias("_name"), F.col("attribute").alias("_attribute"))
        .agg(F.min("value").alias("_value"))
    )
    looked_up = keyed.join(values, [*(by or []), "_type", "_name", "_attribute"], "left")
    replacement = F.when(F.col("_type").isNotNull(), F.col("_value")).otherwise(F.col("_given"))
    return looked_up.select(*rules.columns, replacement.alias("replacement"))


def rewrite(
    df: DataFrame,
    rules: DataFrame,
    order: list[str],
    text: str = "text",
    rules_per_pass: int = BROADCAST_ROWS,
    by: list[str] | None = None,
) -> DataFrame:
    """Apply every rule in scope to each text, in rule order: a rule sees what the rules before it left.

    A literal rule replaces each copy of its value. A pattern rule replaces group 1 inside each
    match, or the whole match without a group. The rows need item_type and rel_path, and item_name
    if a rule is limited to items by name. ``by`` names columns, such as the unit, that a rule and
    the rows it applies to must agree in. Rules that tie in ``order`` follow their unit, their
    source_file and then their other columns, however many there are.

    The rules reach the rows as one array from a scalar subquery, folded over the text, so the
    texts are neither joined nor shuffled; with ``by`` it is one array per unit, matched to the
    rows. More rules than the broadcast check allows are applied in several passes of bounded size.
    Rules that do not compile or have no replacement are refused.
    """
    if not rejected_rules(rules).isEmpty():
        raise ValueError("a pattern does not compile, see rejected_rules")
    prepared = stored(_prepared(rules, order, by or []), "rewrite-rules")
    if not prepared.filter(F.col("replacement").isNull()).isEmpty():
        raise ValueError("a replacement could not be resolved")
    if fits_broadcast(prepared, rules_per_pass):
        return _apply(df, text, prepared, by)
    cuts = stored(cut(prepared, prepared.columns, rules_per_pass, "_pass"), "rule-passes")
    passes = cuts.select("_pass").distinct().orderBy("_pass").collect()  # one number per pass
    for each in passes:
        df = _apply(df, text, cuts.filter(F.col("_pass") == each[0]).drop("_pass"), by)
    return df


def _prepared(rules: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Rules in the form the fold reads. Their columns, from left to right, are the order they apply in."""
    ties = [c for c in [*by, "unit", "source_file"] if c in rules.columns and c not in order]
    compiled = compile_rules(rules, keep=[*order, *dict.fromkeys(ties), "replacement", "item_names"])
    flags, before, group, after = [F.regexp_extract("pattern", _ONE_GROUP, no) for no in range(1, 5)]
    may_be_empty = F.rlike(F.lit(""), F.concat(flags, F.lit("^(?:"), group, F.lit(")$")))
    alone = F.col("is_regex") & F.rlike("pattern", F.lit(_ONE_GROUP)) & ~may_be_empty
    parted = F.concat(flags, F.lit("("), before, F.lit(")(?:"), group, F.lit(")("), after, F.lit(")"))
    quoted = F.regexp_replace("replacement", r"([\\$])", r"\\$1")
    return compiled.withColumns(
        {"parted": F.when(alone, parted), "put": F.when(alone, F.concat(F.lit("$1"), quoted, F.lit("$2")))}
    )


def _with_rules(df: DataFrame, rules: DataFrame, by: list[str] | None) -> DataFrame:
    """The rows with the sorted array of the rules they may need."""
    entries = F.struct(*[c for c in rules.columns if c not in (by or [])])
    entries = F.array_sort(F.collect_list(entries)).alias("_rules")
    if not by:
        return df.withColumn("_rules", rules.agg(entries).scalar())
    return match(df, rules.groupBy(*by).agg(entries), by, "left", keep={"_rules": F.first("_rules")})


def _apply(df: DataFrame, text: str, rules: DataFrame, by: list[str] | None) -> DataFrame:
    item_type, rel_path = F.col("item_type"), F.col("rel_path")
    item_name = F.col("item_name") if "item_name" in df.columns else F.lit(None).cast("string")

    def one_of(values: Column, value: Column) -> Column:
        return (F.size(values) == 0) | F.array_contains(values, value)

    def step(done: Column, rule: Column) -> Column:
        of_item = one_of(rule["item_types"], item_type) & one_of(rule["item_names"], item_name)
        on_path = (F.size(rule["path_regexes"]) == 0) | F.exists(rule["path_regexes"], lambda p: F.rlike(rel_path, p))
        # The search of the text comes last for patterns, first for literals: cheap before costly.
        literal = F.when(
            F.contains(done, rule["find_value"]) & of_item & on_path,
            F.replace(done, rule["find_value"], rule["replacement"]),
        ).otherwise(done)
        in_place = F.when(rule["parted"].isNotNull(), F.regexp_replace(done, rule["parted"], rule["put"]))
        in_place = in_place.otherwise(_replace_group(done, rule))
        by_pattern = F.when(of_item & on_path & F.rlike(done, rule["pattern"]), in_place).otherwise(done)
        return F.when(rule["is_regex"], by_pattern).otherwise(literal)

    # A subquery may not stand inside the fold itself, so it is a column of its own first.
    folded = F.coalesce(F.aggregate("_rules", F.col(text), step), F.col(text))
    return _with_rules(df, rules, by).withColumn(text, folded).select(*df.columns)


def _replace_group(text: Column, rule: Column) -> Column:
    """Put a text together again from what lies between the matches and the changed matches.

    For patterns without a group, and those whose group lies within others: there, each copy of the group's text inside
    the match is replaced, as its place cannot be told.
    """
    matches = F.call_function("regexp_extract_all", text, rule["pattern"], F.lit(0))
    groups = F.call_function("regexp_extract_all", text, rule["pattern"], rule["group_no"])
    between = F.split(text, rule["pattern"], -1)
    changed = F.zip_with(matches, groups, lambda m, g: F.replace(m, g, rule["replacement"]))
    # Splitting does not cut at an empty match in front of the text, so the piece before it is restored.
    pieces = F.when(F.size(between) == F.size(matches), F.concat(F.array(F.lit("")), between)).otherwise(between)
    return F.array_join(F.zip_with(pieces, changed, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
