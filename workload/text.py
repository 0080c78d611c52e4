"""Lines, identifiers, fields and blocks of the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions import id_count, marker_lines, split_lines
from lakekit.operators.extract import block_lines, block_rows, explode_lines, extract_ids, field_ids, notebook_ids
from lakekit.session import run_dir
from lakekit.sources import read_corpus, read_path, spread

# Identifier shapes that occur in the text tables.
TOKEN = "[0-9a-f]{40}"
MAIL = r"[A-Za-z]+\.[0-9]+@mail[0-9]+\.example\.com"
NUMBERS = rf"{TOKEN}|[0-9]{{16}}|[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}"
IDS = f"{NUMBERS}|{MAIL}"
TOKEN_PAIR = f'([a-z]+) = "({TOKEN})"'
HREF = '"/[^"]*"'
WORD_LINK = '(href)="(/(?:And|Und|De))"'
PAGE_FIELDS = ["ad", "utf-8", "en", "de"]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read_path(spark, f"{sf_dir}/documents.parquet").select(*columns))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_path(spark, f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(documents(spark, sf_dir, "doc_id", "text"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the lines with a marker."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.explode(marker_lines(split_lines(F.col("text")), " = ")).alias("line"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_ids(lines(spark, sf_dir), IDS).select("doc_id", "line_no", "id")


def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = id_count(F.col("text"), IDS)
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", counted.alias("ids"))


def named_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked names, and every mail address of a line that has no pair."""
    found = notebook_ids(
        documents(spark, sf_dir, "doc_id", "text"),
        marker=" ",
        fields=["token"],
        block_key="@",
        id_pattern=f"{TOKEN}|{MAIL}",
        pair_pattern=TOKEN_PAIR,
    )
    return found.select("doc_id", "line_no", "field_name", "id")


def inline_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the page lines without a link to one of three words."""
    found = notebook_ids(
        pages(spark, sf_dir), marker="<", block_key="href", id_pattern=HREF, pair_pattern=WORD_LINK
    )
    return found.select("page_id", "line_no", "field_name", "id")


def ids_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that count only inside a block, which opens at one word and closes at another."""
    found = notebook_ids(
        documents(spark, sf_dir, "doc_id", "text"),
        marker=" ",
        fields=[],
        block_key=" que ",
        block_end=" de ",
        id_field="token",
        id_pattern=TOKEN,
        pair_pattern=TOKEN_PAIR,
    )
    return found.select("doc_id", "line_no", "field_name", "id")


def field_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = field_ids(pages(spark, sf_dir), fields=PAGE_FIELDS, id_pattern=HREF)
    return found.select("page_id", "line_no", "field_name", "id")


def block_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return block_lines(docs, marker=" ", opens=" the ", closes=" of ")


def block_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_path(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    return block_rows(events, ["user_id"], "event_id", kind == "error", kind == "signup")


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of JSON files, then scanned as files."""
    root = f"{run_dir(spark, 'corpus')}/units"
    tree = read_path(spark, f"{sf_dir}/documents.parquet").withColumns(
        {"unit": F.col("source"), "folder": F.concat("lang", F.lit(".Notebook"))}
    )
    # Rebalanced by folder: few files per folder, and a large folder is split over several tasks.
    tree.hint("rebalance", F.col("unit"), F.col("folder")).write.partitionBy("unit", "folder").option("maxRecordsPerFile", 10_000).json(root)
    found = field_ids(read_corpus(spark, root), fields=["text", "source", "absent"], id_pattern=NUMBERS)
    return found.groupBy(F.regexp_replace("unit", "^unit=", "").alias("unit"), "item_type", "field_name", "id").agg(
        F.count("*").alias("n")
    )


QUERIES = {
    "lines": lines,
    "marked_lines": marked_lines,
    "identifiers": identifiers,
    "identifier_counts": identifier_counts,
    "named_fields": named_fields,
    "inline_fallback": inline_fallback,
    "ids_in_block": ids_in_block,
    "field_cross": field_cross,
    "block_state": block_state,
    "block_state_rows": block_state_rows,
    "corpus_scan": corpus_scan,
}


def split_sql(table: str, key: str, text: str) -> str:
    """Numbered lines of a text column; a final line break opens no further line."""
    return f"""
        SELECT {key}, line_no, line FROM (
            SELECT {key}, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line, len(parts) AS n
            FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {table})
        ) WHERE NOT (line = '' AND line_no = n)
    """


DOC_LINES = f"doc_lines AS ({split_sql('documents', 'doc_id', 'text')})"
PAGE_LINES = f"page_lines AS ({split_sql('pages', 'page_id', 'html')})"


def state_sql(table: str, key: str, opens: str, closes: str) -> str:
    """Block state of lines by a running window."""
    return f"""
        SELECT *, coalesce(last_value(CASE WHEN contains(line, '{opens}') THEN true
                                           WHEN contains(line, '{closes}') THEN false END IGNORE NULLS)
            OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside
        FROM {table}
    """


ORACLES = {
    "lines": f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM doc_lines",
    "marked_lines": f"WITH {DOC_LINES} SELECT doc_id, line FROM doc_lines WHERE contains(line, ' = ')",
    "identifiers": f"""
        WITH {DOC_LINES}
        SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{IDS}')) AS id FROM doc_lines
    """,
    "identifier_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{IDS}')) AS ids FROM documents",
    "named_fields": f"""
        WITH {DOC_LINES},
        pairs AS (SELECT *, regexp_extract(line, '{TOKEN_PAIR}', 1) AS name FROM doc_lines WHERE contains(line, ' '))
        SELECT doc_id, line_no, 'token' AS field_name, regexp_extract(line, '{TOKEN_PAIR}', 2) AS id
        FROM pairs WHERE name = 'token'
        UNION ALL
        SELECT doc_id, line_no, '@' AS field_name, unnest(regexp_extract_all(line, '{TOKEN}|{MAIL}')) AS id
        FROM pairs WHERE name = '' AND contains(line, '@')
    """,
    "inline_fallback": f"""
        WITH {PAGE_LINES}
        SELECT page_id, line_no, 'href' AS field_name, unnest(regexp_extract_all(line, '{HREF}')) AS id
        FROM page_lines
        WHERE contains(line, '<') AND contains(line, 'href') AND NOT regexp_matches(line, '{WORD_LINK}')
    """,
    "ids_in_block": f"""
        WITH {DOC_LINES}, marked AS (SELECT * FROM doc_lines WHERE contains(line, ' '))
        SELECT doc_id, line_no, ' que ' AS field_name, regexp_extract(line, '{TOKEN_PAIR}', 2) AS id
        FROM ({state_sql("marked", "doc_id", " que ", " de ")})
        WHERE inside AND regexp_extract(line, '{TOKEN_PAIR}', 1) = 'token'
        UNION ALL
        SELECT doc_id, line_no, ' que ' AS field_name, unnest(regexp_extract_all(line, '{TOKEN}')) AS id
        FROM marked WHERE contains(line, ' que ') AND NOT regexp_matches(line, '{TOKEN_PAIR}')
    """,
    "field_cross": f"""
        WITH {PAGE_LINES}, fields AS (SELECT unnest({PAGE_FIELDS}) AS field_name)
        SELECT page_id, line_no, field_name, unnest(regexp_extract_all(line, '{HREF}')) AS id
        FROM page_lines, fields WHERE contains(line, '"' || field_name || '"')
    """,
    "block_state": f"""
        WITH {DOC_LINES}, marked AS (SELECT * FROM doc_lines WHERE contains(line, ' '))
        SELECT doc_id, line_no, line, inside FROM ({state_sql("marked", "doc_id", " the ", " of ")})
    """,
    "block_state_rows": """
        SELECT user_id, event_id, event_type,
               coalesce(last_value(CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END IGNORE NULLS)
                   OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   false) AS inside
        FROM events
    """,
    "corpus_scan": f"""
        SELECT source AS unit, 'Notebook' AS item_type, field_name, id, count(*) AS n
        FROM (SELECT source, unnest(regexp_extract_all(text, '{NUMBERS}')) AS id FROM documents),
             (SELECT unnest(['text', 'source']) AS field_name)
        GROUP BY ALL
    """,
}
