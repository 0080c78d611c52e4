"""Rules, scopes, coverage and rewriting over the documents, which stand for the files of a corpus.

A document's source is its unit. Its path has a folder per language whose suffix is the item type;
one language has no proper type, and short documents carry names of the skip list.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions import glob_to_regex, item_type, matches_any_glob, not_skipped, relative_to, strip_space
from lakekit.operators.checks import only_unit
from lakekit.operators.coverage import uncovered
from lakekit.operators.extract import explode_lines, extract_ids
from lakekit.operators.matching import match
from lakekit.operators.rewrite import resolve_replacements, rewrite
from lakekit.operators.rollup import findings_per_unit, gate, overall
from lakekit.plans.audit import findings_of, sorted_findings
from lakekit.session import stored
from lakekit.sources import normalise_rules, read_path, spread
from workload.text import DOC_LINES, IDS, MAIL, TOKEN

ROOT = "/corpus/"
RULE_FIELDS = [
    pa.field("source_file", pa.string()),
    pa.field("visit_no", pa.int32()),
    pa.field("rule_no", pa.int32()),
    pa.field("find_value", pa.string()),
    pa.field("is_regex", pa.string()),
    pa.field("item_type", pa.string()),
    pa.field("file_path", pa.string()),
]
REPLACEMENT = [pa.field("replacement", pa.string())]

# Rules as a user writes them: origin, pattern or literal, flag, item type, path.
PATTERN_RULES = [
    ("a.yml", 1, 1, f'token = "({TOKEN})"', "true", "Notebook", None),
    ("a.yml", 1, 2, f'token = "({TOKEN})"', "TRUE", '["CopyJob", "Report"]', '["**/src1*/**", "src3/*/doc-?.json"]'),
    ("a.yml", 1, 3, r"([0-9]+)\.[0-9]+\.[0-9]+\.[0-9]+", "true", None, None),
    ("a.yml", 1, 4, MAIL, "true", '["Notebook", "Report"]', None),
    ("a.yml", 1, 5, "token = (", "true", None, None),
    ("b.yml", 2, 1, "[0-9]{16}", "true", None, "**/doc-*5.json"),
    ("b.yml", 2, 2, "[0-9]{16}", "yes", None, None),
    ("a.yml", 3, 1, f'token = "({TOKEN})"', "true", "Notebook", None),
]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = (
        F.when(F.col("lang") == "en", ".Notebook").when(F.col("lang") == "de", ".CopyJob").when(F.col("lang") == "fr", ".Report")
    )
    name = (
        F.when(F.col("n_chars") < 100, "stage_config.json")
        .when(F.col("n_chars") < 200, F.concat(F.lit("doc-"), "doc_id", F.lit(".metadata.json")))
        .otherwise(F.concat(F.lit("doc-"), "doc_id", F.lit(".json")))
    )
    folder = F.concat("source", F.lit("/"), "lang", F.coalesce(suffix, F.lit(".nb")))
    return spread(read_path(spark, f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        F.col("source").alias("unit"),
        F.concat(F.lit(ROOT), folder, F.lit("/"), name).alias("path"),
        name.alias("name"),
        "text",
    )


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir).filter(not_skipped(F.col("name")))
    return (
        files.withColumn("item_type", item_type(F.col("path")))
        .filter(F.col("item_type") != "Unknown")
        .withColumn("rel_path", relative_to(F.col("path"), ROOT))
    )


def typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("doc_id", "item_type", "rel_path")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences_in(kept(spark, sf_dir))


def occurrences_in(files: DataFrame) -> DataFrame:
    found = extract_ids(explode_lines(files.drop("name", "path")), IDS)
    kind = F.when(F.rlike("id", F.lit("@")), "mail").when(F.rlike("id", F.lit(f"^{TOKEN}$")), "token").otherwise("number")
    return found.select(
        "doc_id",
        "unit",
        "item_type",
        "rel_path",
        F.col("rel_path").alias("file"),
        "line_no",
        kind.alias("field_name"),
        "id",
        strip_space(F.col("line")).alias("context"),
    )


def literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One literal rule per identifier and item type of the documents labelled good."""
    good = read_path(spark, f"{sf_dir}/labels.parquet").filter(F.col("quality") == 1)
    held = kept(spark, sf_dir).select("doc_id", "item_type", F.regexp_extract_all("text", F.lit(IDS), 0).alias("ids"))
    known = match(stored(held.filter(F.size("ids") > 0), "ids"), good, ["doc_id"], "left_semi")
    ids = known.select("item_type", F.explode("ids").alias("id")).distinct()
    return ids.select(
        F.lit("labelled.yml").alias("source_file"),
        F.lit(1).alias("visit_no"),
        F.lit(1).alias("rule_no"),
        F.concat(F.lit(" "), "id").alias("find_value"),
        F.lit("false").alias("is_regex"),
        "item_type",
        F.lit(None).cast("string").alias("file_path"),
    )


def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token rule for every unit and language folder that holds a document labelled toxic."""
    toxic = read_path(spark, f"{sf_dir}/labels.parquet").filter(F.col("toxic") == 1)
    folders = match(kept(spark, sf_dir).select("doc_id", "rel_path"), toxic, ["doc_id"], "left_semi").select(
        F.regexp_replace("rel_path", "/[^/]*$", "").alias("folder")
    )
    return folders.distinct().select(
        F.lit("folders.yml").alias("source_file"),
        F.lit(1).alias("visit_no"),
        F.lit(1).alias("rule_no"),
        F.lit(f'token = "({TOKEN})"').alias("find_value"),
        F.lit("true").alias("is_regex"),
        F.lit(None).cast("string").alias("item_type"),
        F.concat("folder", F.lit("/*.json")).alias("file_path"),
    )


def inline_rules(spark: SparkSession, rows: list[tuple], more: list[pa.Field] | None = None) -> DataFrame:
    """Rules written in a program, as a local table that needs no Python worker to read."""
    schema = pa.schema([*RULE_FIELDS, *(more or [])])
    named = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=schema))


def pattern_rules(spark: SparkSession) -> DataFrame:
    return normalise_rules(inline_rules(spark, PATTERN_RULES))


def _plain(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "item_type", "line_no", "field_name", "id")


def coverage_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(uncovered(occurrences(spark, sf_dir), normalise_rules(literal_rules(spark, sf_dir))))


def coverage_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(uncovered(occurrences(spark, sf_dir), pattern_rules(spark)))


def coverage_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(uncovered(occurrences(spark, sf_dir), normalise_rules(unit_rules(spark, sf_dir))))


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_rules(literal_rules(spark, sf_dir).unionByName(inline_rules(spark, PATTERN_RULES)))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = findings_of(occurrences(spark, sf_dir), all_rules(spark, sf_dir))
    return sorted_findings(findings)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_path(spark, f"{sf_dir}/documents.parquet").select(F.col("source").alias("unit")).distinct()


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per unit, clean units too."""
    findings = findings_of(occurrences(spark, sf_dir), all_rules(spark, sf_dir))
    return findings_per_unit(_units(spark, sf_dir), findings).orderBy("unit")


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall(audit_report(spark, sf_dir))


def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(findings_of(occurrences(spark, sf_dir), all_rules(spark, sf_dir)))


def audit_one_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = only_unit(kept(spark, sf_dir), "src3")
    return _plain(uncovered(occurrences_in(files), pattern_rules(spark)))


def glob_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages each list of globs selects; the empty list selects all."""
    path = F.regexp_replace("url", "^https?://[^/]*/|[?#].*$", "")
    globs = {
        "folder": ["en/**"],
        "anywhere": ["**/*.html", "/./fr/2?"],
        "suffix": ["d?/*5", "\\es\\*\\"],
        "special": ["(en)/*", "en.*", "[a-z]+/*"],
        "every": [],
    }
    pages = read_path(spark, f"{sf_dir}/pages.parquet").select("page_id", path.alias("path"))
    lists = {name: F.array(*[F.lit(g) for g in each]).cast("array<string>") for name, each in globs.items()}
    return pages.select("page_id", "path", *[matches_any_glob(F.col("path"), each).alias(n) for n, each in lists.items()])


def glob_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern of a glob made from each page's path."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    path = F.regexp_replace("url", "^https?://[^/]*/", "")
    glob = F.concat(F.lit("./**/"), host, F.lit("/*/"), path)
    return read_path(spark, f"{sf_dir}/pages.parquet").select("page_id", glob_to_regex(glob).alias("pattern"))


def rule_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows made of parts and suppliers, with blanks, missing values, repeats and mixed spellings."""
    size = F.col("p_size")
    padded = F.concat(F.lit(" \t"), "p_name", F.lit("\n"))
    both = F.to_json(F.array("p_type", "p_brand"))
    part = read_path(spark, f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("source_file"),
        F.when(size > 40, 2).otherwise(1).alias("visit_no"),
        F.col("p_partkey").alias("rule_no"),
        F.when(size < 5, "  ").when(size < 8, None).otherwise(padded).alias("find_value"),
        F.when(size < 20, "TRUE").when(size < 30, "true").when(size < 35, "yes").alias("is_regex"),
        F.when(size < 25, F.col("p_type")).when(size < 35, both).alias("item_type"),
        F.lit(None).cast("string").alias("file_path"),
    )
    supplier = read_path(spark, f"{sf_dir}/supplier.parquet").select(
        F.lit("suppliers").alias("source_file"),
        F.lit(7).alias("visit_no"),
        F.col("s_suppkey").alias("rule_no"),
        F.col("s_name").alias("find_value"),
        F.lit(None).cast("string").alias("is_regex"),
        F.lit(None).cast("string").alias("item_type"),
        F.concat(F.lit("**/"), "s_name").alias("file_path"),
    )
    rules = normalise_rules(part.unionByName(supplier))
    return rules.select(
        "source_file",
        F.col("visit_no").cast("bigint").alias("visit_no"),
        "rule_no",
        "find_value",
        "is_regex",
        F.array_join("item_types", "|").alias("item_types"),
        F.array_join("file_paths", "|").alias("file_paths"),
    )


def _rewritten(spark: SparkSession, sf_dir: str, rules: DataFrame) -> DataFrame:
    done = rewrite(kept(spark, sf_dir), rules, ["visit_no", "rule_no"])
    return done.select("doc_id", "text")


def rewrite_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second rule sees what the first one wrote; the third is limited by type, the fourth by path."""
    rules = [
        ("r", 1, 1, "@mail1.example.com", None, None, None, "@mail2.example.com"),
        ("r", 1, 2, "@mail2.example.com", None, None, None, "@post.example.org"),
        ("r", 1, 3, "MIT License", None, "Notebook", None, "M$1T License"),
        ("r", 1, 4, "Version 2.0", None, None, "**/src1*/**", "Version 3"),
    ]
    return _rewritten(spark, sf_dir, normalise_rules(inline_rules(spark, rules, REPLACEMENT)))


def rewrite_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("r", 1, 1, f'token = "({TOKEN})"', "true", None, None, "$workspace"),
        ("r", 1, 2, "[0-9]{16}", "true", '["Notebook", "Report"]', None, "<number>"),
    ]
    return _rewritten(spark, sf_dir, normalise_rules(inline_rules(spark, rules, REPLACEMENT)))


def rewrite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements taken from an inventory of nations and suppliers."""
    nations = read_path(spark, f"{sf_dir}/nation.parquet").select(
        F.lit("test").alias("environment"),
        F.lit("Nation").alias("type"),
        F.col("n_nationkey").cast("string").alias("name"),
        F.lit("label").alias("attribute"),
        F.col("n_name").alias("value"),
    )
    suppliers = read_path(spark, f"{sf_dir}/supplier.parquet").select(
        F.lit("test").alias("environment"),
        F.lit("Supplier").alias("type"),
        F.col("s_suppkey").cast("string").alias("name"),
        F.lit("id").alias("attribute"),
        F.col("s_name").alias("value"),
    )
    rows = [
        ("r", 1, 1, f'token = "({TOKEN})"', "true", None, None, [("_ALL_", "$items.Nation.3.$label")]),
        ("r", 1, 2, "MIT License", "false", None, None, [("test", "$items.Supplier.5.id"), ("_ALL_", "other")]),
        ("r", 1, 3, "Apache License", "false", None, None, [("prod", "P"), ("_ALL_", "plain text")]),
    ]
    rules = inline_rules(spark, rows, [pa.field("replace_value", pa.map_(pa.string(), pa.string()))])
    resolved = resolve_replacements(normalise_rules(rules), nations.unionByName(suppliers), "test")
    return _rewritten(spark, sf_dir, resolved)


QUERIES = {
    "typed_paths": typed_paths,
    "glob_scope": glob_scope,
    "glob_patterns": glob_patterns,
    "rule_normalise": rule_normalise,
    "coverage_literal": coverage_literal,
    "coverage_regex": coverage_regex,
    "coverage_folders": coverage_folders,
    "audit_findings": audit_findings,
    "audit_report": audit_report,
    "audit_totals": audit_totals,
    "audit_gate": audit_gate,
    "audit_one_unit": audit_one_unit,
    "rewrite_literal": rewrite_literal,
    "rewrite_regex": rewrite_regex,
    "rewrite_lookup": rewrite_lookup,
}

# The files that are kept, with their type and path, and the identifiers on their lines.
KEPT = """kept AS (
    SELECT doc_id, source, lang, text,
           CASE lang WHEN 'en' THEN 'Notebook' WHEN 'de' THEN 'CopyJob' WHEN 'fr' THEN 'Report' END AS item_type,
           source || '/' || lang || '.' ||
           CASE lang WHEN 'en' THEN 'Notebook' WHEN 'de' THEN 'CopyJob' WHEN 'fr' THEN 'Report' END
           || '/doc-' || doc_id || '.json' AS rel_path
    FROM documents WHERE lang IN ('en', 'de', 'fr') AND n_chars >= 200
)"""
OCCURRENCES = f"""{DOC_LINES}, {KEPT}, occ AS (
    SELECT *, CASE WHEN contains(id, '@') THEN 'mail' WHEN length(id) = 40 THEN 'token' ELSE 'number' END AS field_name
    FROM (SELECT doc_id, source AS unit, item_type, rel_path, line_no, trim(line) AS context,
                 unnest(regexp_extract_all(line, '{IDS}')) AS id
          FROM doc_lines JOIN kept USING (doc_id))
)"""
LITERALS = f"""literals AS (
    SELECT DISTINCT item_type, unnest(regexp_extract_all(text, '{IDS}')) AS id
    FROM kept WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
)"""
NOT_LITERAL = "NOT EXISTS (SELECT 1 FROM literals l WHERE l.id = occ.id AND l.item_type = occ.item_type)"
BY_PATTERN = rf"""(
    (item_type = 'Notebook' AND regexp_extract(context, 'token = "({TOKEN})"', 1) = id)
    OR (item_type IN ('CopyJob', 'Report')
        AND regexp_matches(rel_path, 'src1[^/]*/.*$|src3/[^/]*/doc-[^/]\.json$')
        AND regexp_extract(context, 'token = "({TOKEN})"', 1) = id)
    OR regexp_extract(context, '([0-9]+)\.[0-9]+\.[0-9]+\.[0-9]+', 1) = id
    OR (item_type IN ('Notebook', 'Report') AND contains(regexp_extract(context, '{MAIL}'), id))
    OR (regexp_matches(rel_path, 'doc-[^/]*5\.json$') AND contains(regexp_extract(context, '[0-9]{{16}}'), id))
)"""
PLAIN = "doc_id, item_type, line_no, field_name, id"
PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"


def rewritten_sql(expression: str) -> str:
    return f"WITH {KEPT} SELECT doc_id, {expression} AS text FROM kept"


ORACLES = {
    "typed_paths": f"WITH {KEPT} SELECT doc_id, item_type, rel_path FROM kept",
    "glob_scope": rf"""
        SELECT page_id, path,
               regexp_matches(path, 'en/.*$') AS folder,
               regexp_matches(path, '[^/]*\.html$|fr/2[^/]$') AS anywhere,
               regexp_matches(path, 'd[^/]/[^/]*5$|es/[^/]*/$') AS suffix,
               regexp_matches(path, '\(en\)/[^/]*$|en\.[^/]*$|\[a-z\]\+/[^/]*$') AS special,
               true AS every
        FROM (SELECT page_id, {PATH} AS path FROM pages)
    """,
    "glob_patterns": r"""
        SELECT page_id, '.*' || regexp_replace(host, '\.', '\\.', 'g') || '/[^/]*/' ||
               replace(replace(path, '.', '\.'), '?', '[^/]') || '$' AS pattern
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
                     regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages)
    """,
    "rule_normalise": """
        WITH rules AS (
            SELECT p_brand AS source_file, CASE WHEN p_size > 40 THEN 2 ELSE 1 END AS visit_no, p_partkey AS rule_no,
                   CASE WHEN p_size < 5 THEN '' WHEN p_size < 8 THEN 'None' ELSE p_name END AS find_value,
                   p_size < 30 AS is_regex,
                   CASE WHEN p_size < 25 THEN p_type WHEN p_size < 35 THEN p_type || '|' || p_brand ELSE '' END AS item_types,
                   '' AS file_paths
            FROM part
            UNION ALL
            SELECT 'suppliers', 7, s_suppkey, s_name, false, '', '**/' || s_name FROM supplier
        )
        SELECT source_file, CAST(visit_no AS BIGINT) AS visit_no, rule_no, find_value, is_regex, item_types, file_paths
        FROM rules r
        WHERE find_value <> '' AND visit_no = (SELECT min(visit_no) FROM rules s WHERE s.source_file = r.source_file)
    """,
    "coverage_literal": f"WITH {OCCURRENCES}, {LITERALS} SELECT {PLAIN} FROM occ WHERE {NOT_LITERAL}",
    "coverage_regex": f"WITH {OCCURRENCES} SELECT {PLAIN} FROM occ WHERE NOT {BY_PATTERN}",
    "coverage_folders": f"""
        WITH {OCCURRENCES}, folders AS (
            SELECT DISTINCT regexp_replace(rel_path, '/[^/]*$', '') AS folder
            FROM kept WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
        )
        SELECT {PLAIN} FROM occ
        WHERE NOT (regexp_extract(context, 'token = "({TOKEN})"', 1) = id
                   AND EXISTS (SELECT 1 FROM folders f WHERE regexp_replace(occ.rel_path, '/[^/]*$', '') LIKE '%' || f.folder))
    """,
    "audit_findings": f"""
        WITH {OCCURRENCES}, {LITERALS}
        SELECT unit, rel_path AS file, item_type, field_name, id, left(context, 120) AS context
        FROM occ WHERE {NOT_LITERAL} AND NOT {BY_PATTERN}
    """,
    "audit_report": f"""
        WITH {OCCURRENCES}, {LITERALS},
        counts AS (SELECT unit, count(*) AS n FROM occ
                   WHERE {NOT_LITERAL} AND NOT {BY_PATTERN} GROUP BY unit)
        SELECT unit, coalesce(n, 0) AS findings, n IS NULL AS clean
        FROM (SELECT DISTINCT source AS unit FROM documents) LEFT JOIN counts USING (unit)
    """,
    "audit_totals": f"""
        WITH {OCCURRENCES}, {LITERALS},
        counts AS (SELECT unit, count(*) AS n FROM occ
                   WHERE {NOT_LITERAL} AND NOT {BY_PATTERN} GROUP BY unit)
        SELECT count(*) AS units, count(*) - count(n) AS clean_units,
               CAST(coalesce(sum(n), 0) AS BIGINT) AS findings
        FROM (SELECT DISTINCT source AS unit FROM documents) LEFT JOIN counts USING (unit)
    """,
    "audit_gate": f"""
        WITH {OCCURRENCES}, {LITERALS}
        SELECT count(*) > 0 AS failed, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code
        FROM occ WHERE {NOT_LITERAL} AND NOT {BY_PATTERN}
    """,
    "audit_one_unit": f"WITH {OCCURRENCES} SELECT {PLAIN} FROM occ WHERE unit = 'src3' AND NOT {BY_PATTERN}",
    "rewrite_literal": rewritten_sql("""
        CASE WHEN source LIKE 'src1%' THEN replace(t, 'Version 2.0', 'Version 3') ELSE t END
    """).replace(
        "FROM kept",
        """FROM (SELECT *, CASE WHEN item_type = 'Notebook' THEN replace(u, 'MIT License', 'M$1T License') ELSE u END AS t
           FROM (SELECT *, replace(replace(text, '@mail1.example.com', '@mail2.example.com'),
                                   '@mail2.example.com', '@post.example.org') AS u FROM kept))""",
    ),
    "rewrite_regex": rewritten_sql(f"""
        CASE WHEN item_type IN ('Notebook', 'Report') THEN regexp_replace(t, '[0-9]{{16}}', '<number>', 'g') ELSE t END
    """).replace(
        "FROM kept",
        f"""FROM (SELECT *, regexp_replace(text, 'token = "{TOKEN}"', 'token = "$workspace"', 'g') AS t FROM kept)""",
    ),
    "rewrite_lookup": rewritten_sql(f"""
        replace(replace(
            regexp_replace(text, 'token = "{TOKEN}"',
                           'token = "' || (SELECT n_name FROM nation WHERE n_nationkey = 3) || '"', 'g'),
            'MIT License', (SELECT s_name FROM supplier WHERE s_suppkey = 5)), 'Apache License', 'plain text')
    """),
}
