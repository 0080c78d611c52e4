"""The audit of whole units as files: a tree is made of the documents, with rule files, and then audited.

A unit is a source. Its documents in two languages become lines of notebooks, those in the others lines of JSON files, one
language's in a folder that listings take for hidden. Identifiers are digests of what they stand for. Each unit's rule
file extends a shared one outside the tree, which extends a broken one.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.constants import GUID_PATTERN, NOTEBOOK_FILE, ROOT_RULE_FILE, UNIT_CONFIG_FILE
from lakekit.operators.coverage import rejected_rules
from lakekit.operators.extract import extract_ids
from lakekit.operators.matching import match
from lakekit.operators.rewrite import resolve_replacements, rewrite
from lakekit.plans.audit import Audit, audit_corpus
from lakekit.session import run_dir, stored
from lakekit.sources import normalise_rules, read_corpus, read_path, spread
from lakekit.sources.rule_files import reached_rule_files, read_unit_rules, unit_starts

ITEMS = {"en": "n.Notebook", "de": "m.Notebook", "fr": "_old/c.CopyJob", "es": "d.Report"}
ROWS_PER_FILE = 10_000
# An id that the shared rule covers: the first group of a line, if it begins with a low digit.
LOW_ID = '"id": "([0-7][0-9a-f-]{35})"'


def guid(*parts: Column | str) -> Column:
    digest = F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _notebook(unit: Column, doc: Column) -> Column:
    """A document's lines in a notebook. Its block closes, so documents may follow one another in any order."""
    lines = [
        F.concat(F.lit('# META   "default_lakehouse": "'), guid("lake", unit), F.lit('",')),
        F.lit('# META   "known_lakehouses": ['),
        F.concat(F.lit('# META     "id": "'), guid("known", doc), F.lit('"')),
        F.lit("# META   ]"),
        F.concat(F.lit('# META   "id": "'), guid("free", doc), F.lit('"')),
        F.concat(F.lit('x = "'), guid("code", doc), F.lit('"')),
    ]
    return F.concat_ws("\n", *lines)


def _json(unit: Column, doc: Column) -> Column:
    ids = [F.lit('{"workspaceId": "'), guid("space", unit), F.lit('", "artifactId": "'), guid("item", doc), F.lit('"}')]
    return F.concat(*ids)


def _rule(find: Column, item_type: str | None, file_path: str | None, environment: str, value: Column) -> Column:
    return F.struct(
        find.alias("find_value"),
        F.lit(item_type).cast("string").alias("item_type"),
        F.lit(file_path).cast("string").alias("file_path"),
        F.create_map(F.lit(environment), value).alias("replace_value"),
    )


def _write_named(spark: SparkSession, rows: DataFrame, root: str, name: str, numbered: bool = False) -> None:
    """The ``text`` of each ``folder`` as files of a fixed name; with ``numbered`` a part of it is a folder of its own.

    Spark names the files it writes, so they are renamed, which moves no data: one call for every 10,000 rows.
    """
    stage = run_dir(spark, "named")
    rows.hint("rebalance", F.col("folder")).write.partitionBy("folder").option("maxRecordsPerFile", ROWS_PER_FILE).text(stage)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(stage).getFileSystem(spark._jsc.hadoopConfiguration())
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for part_no, status in enumerate(store.globStatus(hadoop.Path(f"{stage}/folder=*/part-*"))):
        folder = unescape(status.getPath().getParent().getName().removeprefix("folder="))
        above, item = posixpath.split(folder)
        target = f"{root}/{above}/{part_no}-{item}" if numbered else f"{root}/{folder}".rstrip("/")
        store.mkdirs(hadoop.Path(target))
        store.rename(status.getPath(), hadoop.Path(f"{target}/{name}"))


def written_units(spark: SparkSession, sf_dir: str) -> str:
    """Write the tree; returns its root."""
    base = run_dir(spark, "units")
    root = f"{base}/in/units"
    docs = read_path(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.col("source").alias("unit"))
    unit, doc = F.col("unit"), F.col("doc_id").cast("string")
    item = F.element_at(F.create_map(*[F.lit(x) for pair in ITEMS.items() for x in pair]), F.col("lang"))
    placed = docs.select(F.concat(unit, F.lit("/"), item).alias("folder"), "lang", "unit", "doc_id")
    notebook = F.col("lang").isin("en", "de")
    _write_named(spark, placed.filter(notebook).select("folder", _notebook(unit, doc).alias("text")), root, NOTEBOOK_FILE, True)
    _write_named(spark, placed.filter(~notebook).select("folder", _json(unit, doc).alias("text")), root, "c.json", True)

    labels = read_path(spark, f"{sf_dir}/labels.parquet").filter("toxic = 1")
    owners = match(docs, labels, ["doc_id"], "left_semi").select("unit").distinct()
    _write_named(spark, owners.select(F.col("unit").alias("folder"), F.lit("core:").alias("text")), root, UNIT_CONFIG_FILE)
    rules = [
        _rule(guid("space", unit), None, None, "_ALL_", F.lit("x")),
        _rule(guid("lake", unit), "Notebook", "**/*n.Notebook/*.py", "prod", guid("prod", unit)),
    ]
    # JSON is YAML too.
    content = F.to_json(F.struct(F.lit("../../../shared.rules").alias("extend"), F.array(*rules).alias("find_replace")))
    units = docs.select("unit").distinct()
    _write_named(spark, units.select(F.col("unit").alias("folder"), content.alias("text")), root, ROOT_RULE_FILE)
    shared = f"extend: broken.yml\nfind_replace:\n- find_value: '{LOW_ID}'\n  is_regex: true\n  replace_value: {{_ALL_: y}}"
    for name, text in {"shared.rules": shared, "broken.yml": "find_replace: ["}.items():
        lines = units.agg(F.count("*").alias("n")).select(F.lit(".").alias("folder"), F.lit(text).alias("text"))
        _write_named(spark, lines, base, name)
    return root


def audited(spark: SparkSession, sf_dir: str) -> Audit:
    return audit_corpus(spark, written_units(spark, sf_dir))


def unit_audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the audit of a tree of files; how rows are spread over files is no part of the result."""
    found = audited(spark, sf_dir).findings
    return found.groupBy("unit", "item_type", "field_name", "id", "context").agg(F.count("*").alias("n"))


def unit_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).per_unit


def unit_audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).gate


def unit_rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files that the units' own ones lead to and that cannot be used."""
    root = written_units(spark, sf_dir)
    units = read_path(spark, f"{sf_dir}/documents.parquet").select(F.col("source").alias("unit")).distinct()
    found = reached_rule_files(spark, root, unit_starts(units)).unreadable
    return found.select(F.regexp_extract("source_file", "[^/]*$", 0).alias("name"), "reason")


def unit_rewrite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of each unit that its literal rules name: in the files, and after the files are rewritten for production."""
    root = written_units(spark, sf_dir)
    docs = read_path(spark, f"{sf_dir}/documents.parquet")
    units = stored(docs.select(F.col("source").alias("unit")).distinct(), "units")
    rules = stored(read_unit_rules(spark, root, units), "unit-rules")
    inventory = spark.createDataFrame([], "environment string, type string, name string, attribute string, value string")
    resolved = resolve_replacements(rules, inventory, "prod")
    files = spread(read_corpus(spark, root)).select("unit", "rel_path", "item_type", "item_name", "text")
    after = rewrite(files, resolved, ["visit_no", "rule_no"], by=["unit"])
    named = rules.filter("not is_regex").select("unit", F.col("find_value").alias("id"))

    def left(texts: DataFrame, name: str) -> DataFrame:
        ids = extract_ids(texts.select("unit", F.col("text").alias("line")), GUID_PATTERN).select("unit", "id")
        return match(stored(ids, "ids"), named, ["unit", "id"], "left_semi").select("unit", F.lit(name).alias("state"))

    counted = left(files, "before").union(left(after, "after")).groupBy("unit", "state").agg(F.count("*").alias("n"))
    every = units.select("unit", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("state"))
    return match(every, counted, ["unit", "state"], "left", keep={"ids": F.max("n")}).fillna(0, ["ids"])


def rules_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern rules made of parts, some of which do not compile."""
    name = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("("), "p_name")).when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("[")))
    rules = read_path(spark, f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("source_file"),
        F.lit(1).alias("visit_no"),
        F.col("p_partkey").alias("rule_no"),
        F.coalesce(name, F.concat(F.lit("("), "p_name", F.lit(")"))).alias("find_value"),
        F.when(F.col("p_size") % 2 == 0, "true").alias("is_regex"),
        F.lit(None).cast("string").alias("item_type"),
        F.lit(None).cast("string").alias("file_path"),
    )
    return rejected_rules(normalise_rules(rules)).select("source_file", "rule_no", "find_value", "reason")


def rewrite_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's texts by the unit's own rule, with a value that the inventory holds for the unit."""
    docs = spread(read_path(spark, f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.col("source").alias("unit"), "text", F.lit("Text").alias("item_type"), F.col("lang").alias("rel_path")
    )
    units = stored(read_path(spark, f"{sf_dir}/documents.parquet").select(F.col("source").alias("unit")).distinct(), "units")
    rows = units.select(
        "unit",
        F.lit("own.yml").alias("source_file"),
        F.lit(1).alias("visit_no"),
        F.lit(1).alias("rule_no"),
        F.lit("License").alias("find_value"),
        F.lit(None).cast("string").alias("is_regex"),
        F.lit(None).cast("string").alias("item_type"),
        F.lit("e?").alias("file_path"),
        F.create_map(F.lit("_ALL_"), F.lit("$items.Terms.main.id")).alias("replace_value"),
    )
    terms = units.select(
        "unit",
        F.lit("test").alias("environment"),
        F.lit("Terms").alias("type"),
        F.lit("main").alias("name"),
        F.lit("id").alias("attribute"),
        F.concat("unit", F.lit(" terms")).alias("value"),
    )
    resolved = resolve_replacements(normalise_rules(rows), terms, "test", by=["unit"])
    return rewrite(docs, resolved, ["visit_no", "rule_no"], by=["unit"]).select("doc_id", "text")


QUERIES = {
    "unit_audit_findings": unit_audit_findings,
    "unit_audit_report": unit_audit_report,
    "unit_audit_gate": unit_audit_gate,
    "unit_rule_problems": unit_rule_problems,
    "unit_rewrite_check": unit_rewrite_check,
    "rules_rejected": rules_rejected,
    "rewrite_units": rewrite_units,
}


def guid_sql(text: str) -> str:
    return rf"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


# What the files hold, document by document, and what of it no rule covers.
FOUND = f"""docs AS (
    SELECT doc_id, source AS unit, lang, {guid_sql("'lake' || source")} AS lake, {guid_sql("'known' || doc_id")} AS known,
           {guid_sql("'space' || source")} AS space, {guid_sql("'item' || doc_id")} AS item
    FROM documents
), owners AS (
    SELECT DISTINCT source AS unit FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
), occurrences AS (
    SELECT unit, 'Notebook' AS item_type, 'default_lakehouse' AS field_name, lake AS id,
           '# META   "default_lakehouse": "' || lake || '",' AS context, lang = 'en' AS covered
    FROM docs WHERE lang IN ('en', 'de')
    UNION ALL
    SELECT unit, 'Notebook', 'known_lakehouses', known, '# META     "id": "' || known || '"', regexp_matches(known, '^[0-7]')
    FROM docs WHERE lang IN ('en', 'de')
    UNION ALL
    SELECT unit, CASE lang WHEN 'fr' THEN 'CopyJob' ELSE 'Report' END, field_name, id,
           left('{{"workspaceId": "' || space || '", "artifactId": "' || item || '"}}', 120), id = space
    FROM (SELECT *, unnest([space, item]) AS id FROM docs WHERE lang IN ('fr', 'es')),
         (SELECT unnest(['workspaceId', 'artifactId']) AS field_name)
), findings AS (
    SELECT * FROM occurrences WHERE NOT covered AND unit IN (SELECT unit FROM owners)
)"""

ORACLES = {
    "unit_audit_findings": f"""
        WITH {FOUND} SELECT unit, item_type, field_name, id, context, count(*) AS n FROM findings GROUP BY ALL
    """,
    "unit_audit_report": f"""
        WITH {FOUND}, counts AS (SELECT unit, count(*) AS n FROM findings GROUP BY unit)
        SELECT unit, coalesce(n, 0) AS findings, n IS NULL AS clean FROM owners LEFT JOIN counts USING (unit)
    """,
    "unit_audit_gate": f"""
        WITH {FOUND}
        SELECT count(*) > 0 AS failed, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM findings
    """,
    "unit_rule_problems": """
        SELECT 'broken.yml' AS name, 'does not parse: ParserError' AS reason FROM documents HAVING count(*) > 0
    """,
    "unit_rewrite_check": """
        SELECT unit, state, CAST(CASE state WHEN 'before' THEN n WHEN 'after' THEN german END AS BIGINT) AS ids
        FROM (SELECT source AS unit, count(*) AS n, count(*) FILTER (lang = 'de') AS german
              FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY source),
             (SELECT unnest(['before', 'after']) AS state)
    """,
    "rules_rejected": """
        SELECT p_brand AS source_file, p_partkey AS rule_no, 'pattern does not compile' AS reason,
               CASE WHEN p_size % 7 = 0 THEN '(' || p_name ELSE p_name || '[' END AS find_value
        FROM part WHERE p_size % 2 = 0 AND (p_size % 7 = 0 OR p_size % 5 = 0)
    """,
    "rewrite_units": """
        SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN replace(text, 'License', source || ' terms') ELSE text END AS text
        FROM documents
    """,
}
