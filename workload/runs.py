"""Inventories compared, parameters checked, and the outcomes of runs counted and documented."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions import display_name, status_of
from lakekit.operators.checks import Checked, in_domain, look_up, outside_domain, quarantine, without_mapping
from lakekit.operators.matching import match
from lakekit.operators.reconcile import discover_units, existing, find_by_name, missing, orphans, reconcile
from lakekit.operators.rollup import count_by, flatten_fragments, result_document, roll_up, roll_up_requested
from lakekit.plans.reconciliation import reconcile_and_report
from lakekit.sources import read_path

# Which environment a priority belongs to; one priority has none.
PRIORITY_MAP = [("1-URGENT", "prod"), ("2-HIGH", "prod"), ("3-MEDIUM", "test"), ("5-LOW", "dev")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_path(spark, f"{sf_dir}/{name}.parquet")


def _desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id", "source")


def _actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter(F.col("toxic") == 0).select("doc_id", "quality")


def reconcile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(_desired(spark, sf_dir), _actual(spark, sf_dir), ["doc_id"])


def create_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing(_desired(spark, sf_dir), _actual(spark, sf_dir), ["doc_id"])


def remove_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(_actual(spark, sf_dir), _desired(spark, sf_dir), ["doc_id"])


def find_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the name of its customer, where the inventory of solvent customers has it."""
    wanted = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("name"))
    inventory = _table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return find_by_name(wanted, inventory.select(F.col("c_custkey").alias("name"), F.col("c_name").alias("id")))


def grant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that hold status P."""
    held = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("principal"), F.col("o_orderstatus").alias("role"))
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("principal"), F.lit("P").alias("role"), "c_name")
    return existing(asked, held, ["principal", "role"])


def discover_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that own a system turn."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "role")
    return discover_units(turns, turns.filter(F.col("role") == "system"), "conv_id")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), "o_orderstatus")


def _map(spark: SparkSession) -> DataFrame:
    priorities, environments = zip(*PRIORITY_MAP)
    return spark.createDataFrame(pa.table({"priority": priorities, "environment": environments}))


def environment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_up(_orders(spark, sf_dir), _map(spark), "priority", "environment")


def environment_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_mapping(_orders(spark, sf_dir), _map(spark), "priority")


def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_domain(_orders(spark, sf_dir), "o_orderstatus", ["o", "p"])


def _checked_orders(spark: SparkSession, sf_dir: str) -> Checked:
    """Orders with an environment, checked for their status, their priority's environment and the price."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), "o_orderstatus", "o_totalprice")
    return quarantine(
        look_up(orders, _map(spark), "priority", "environment"),
        {
            "status": in_domain("o_orderstatus", ["o", "p", "f"]),
            "environment": in_domain("environment"),
            "price": F.col("o_totalprice") < 300_000,
        },
    )


def quarantine_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_orders(spark, sf_dir).valid.select("o_orderkey", "environment")


def quarantine_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _checked_orders(spark, sf_dir).rejected
    return rejected.select("o_orderkey", "environment", F.array_join("failed", "|").alias("failed"))


def quarantine_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_orders(spark, sf_dir).violations


def quarantine_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_orders(spark, sf_dir).gate


def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by(_table(spark, sf_dir, "events"), "event_type")


def _environment():
    value = F.col("value")
    return F.when(value < 2, "dev").when(value < 5, "test").otherwise("prod")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an outcome: errors failed, and some have no display name."""
    value = F.col("value")
    name = F.when(value < 1, "").when(value < 8, F.concat(F.lit("event "), "event_id"))
    return _table(spark, sf_dir, "events").select(
        _environment().alias("environment"),
        F.concat(F.lit("user-"), "user_id").alias("folder"),
        name.alias("name"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        "event_id",
    )


def outcome_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select(
        "environment",
        "folder",
        display_name(F.col("name"), F.col("folder")).alias("full_name"),
        status_of(F.col("success")).alias("status"),
    )


def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(outcomes(spark, sf_dir), ["environment"])


def outcome_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order left no outcome and count as failed."""
    requested = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    urgent = _table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    left = urgent.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") != "P").alias("success"))
    return roll_up_requested(requested, left, ["c_custkey"], ["segment"])


def outcome_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of all events, flattened again."""
    all_outcomes = outcomes(spark, sf_dir)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = (F.max(second) - F.min(second)).cast("double")
    times = _table(spark, sf_dir, "events").withColumn("environment", _environment())
    durations = times.groupBy("environment").agg(span.alias("duration"))
    timed = match(all_outcomes, durations, ["environment"], "left", keep={"duration": F.max("duration")})
    header = ["environment", "duration"]
    return flatten_fragments(result_document(timed, header), header)


def outcome_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result documents of all events, as the fragments they are made of."""
    return result_document(outcomes(spark, sf_dir), ["environment"])


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions, outcome counts per language, and documented entries per status, of one reconciled run."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = _table(spark, sf_dir, "labels")
    labelled = match(docs, labels, ["doc_id"], "left", keep={"quality": F.min("quality")}).filter(F.col("quality").isNotNull())
    left = labelled.select(
        "doc_id",
        "lang",
        F.col("source").alias("folder"),
        F.lit("").alias("name"),
        (F.col("quality") == 1).alias("success"),
        F.lit("").alias("error"),
    )
    run = reconcile_and_report(docs.select("doc_id", "lang"), labels.select("doc_id"), left, ["doc_id"], ["lang"])
    entries = flatten_fragments(run.documents, ["lang"])

    def part(label: str, df: DataFrame, key: str, count: str) -> DataFrame:
        return df.select(F.lit(label).alias("part"), F.col(key).alias("key"), F.col(count).alias("n"))

    return (
        part("action", run.action_counts, "action", "items")
        .unionByName(part("failed", run.summary, "lang", "failed_count"))
        .unionByName(part("requested", run.summary, "lang", "total_workspaces"))
        .unionByName(part("entry", entries.groupBy("status").agg(F.count("*").alias("n")), "status", "n"))
    )


QUERIES = {
    "reconcile": reconcile_documents,
    "create_missing": create_missing,
    "remove_orphans": remove_orphans,
    "find_by_name": find_customers,
    "grant_check": grant_check,
    "discover_units": discover_conversations,
    "environment_lookup": environment_lookup,
    "environment_missing": environment_missing,
    "domain_check": domain_check,
    "quarantine_valid": quarantine_valid,
    "quarantine_rejected": quarantine_rejected,
    "quarantine_violations": quarantine_violations,
    "quarantine_gate": quarantine_gate,
    "count_by_type": count_by_type,
    "outcome_names": outcome_names,
    "outcome_rollup": outcome_rollup,
    "outcome_fallback": outcome_fallback,
    "outcome_document": outcome_document,
    "outcome_fragments": outcome_fragments,
    "run_report": run_report,
}

OUTCOMES = """outcomes AS (
    SELECT CASE WHEN value < 2 THEN 'dev' WHEN value < 5 THEN 'test' ELSE 'prod' END AS environment,
           'user-' || user_id AS folder,
           CASE WHEN value < 1 THEN '' WHEN value < 8 THEN 'event ' || event_id END AS name,
           event_type <> 'error' AS success,
           CASE WHEN event_type = 'error' THEN props ELSE '' END AS error,
           epoch(date_trunc('second', ts)) AS second
    FROM events
)"""
FULL_NAME = "coalesce(nullif(name, ''), folder)"
STATUS = "CASE WHEN success THEN 'success' ELSE 'failure' END"

CHECKED = """checked AS (
    SELECT o_orderkey, environment,
           concat_ws('|', CASE WHEN o_orderstatus NOT IN ('O', 'P', 'F') THEN 'status' END,
                     CASE WHEN environment IS NULL THEN 'environment' END,
                     CASE WHEN o_totalprice >= 300000 THEN 'price' END) AS failed
    FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'prod' WHEN '2-HIGH' THEN 'prod'
                                         WHEN '3-MEDIUM' THEN 'test' WHEN '5-LOW' THEN 'dev' END AS environment FROM orders)
)"""

ORACLES = {
    "reconcile": """
        SELECT coalesce(d.doc_id, a.doc_id) AS doc_id,
               CASE WHEN a.doc_id IS NULL THEN 'create' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'keep' END AS action
        FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d
        FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) a ON d.doc_id = a.doc_id
    """,
    "create_missing": """
        SELECT doc_id, min(source) AS source FROM documents
        WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY doc_id
    """,
    "remove_orphans": """
        SELECT doc_id, quality FROM labels
        WHERE toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
    """,
    "find_by_name": """
        SELECT o_orderkey, o_custkey AS name, c_name AS id
        FROM orders LEFT JOIN (SELECT c_custkey, min(c_name) AS c_name FROM customer WHERE c_acctbal > 0 GROUP BY 1)
            ON c_custkey = o_custkey
    """,
    "grant_check": """
        SELECT c_custkey AS principal, 'P' AS role, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
    """,
    "discover_units": "SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'",
    "environment_lookup": """
        SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'prod' WHEN '2-HIGH' THEN 'prod'
                                    WHEN '3-MEDIUM' THEN 'test' WHEN '5-LOW' THEN 'dev' END AS environment
        FROM orders
    """,
    "environment_missing": """
        SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
    """,
    "domain_check": """
        SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'P')
    """,
    "quarantine_valid": f"WITH {CHECKED} SELECT o_orderkey, environment FROM checked WHERE failed = ''",
    "quarantine_rejected": f"WITH {CHECKED} SELECT o_orderkey, environment, failed FROM checked WHERE failed <> ''",
    "quarantine_violations": f"""
        WITH {CHECKED}
        SELECT c AS "check", count(*) FILTER (contains(failed, c)) AS violations, count(*) AS rows
        FROM checked, (SELECT unnest(['status', 'environment', 'price']) AS c) GROUP BY c
    """,
    "quarantine_gate": f"""
        WITH {CHECKED} SELECT count(*) > 0 AS failed, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code
        FROM checked WHERE failed <> ''
    """,
    "count_by_type": "SELECT event_type, count(*) AS items FROM events GROUP BY event_type",
    "outcome_names": f"WITH {OUTCOMES} SELECT environment, folder, {FULL_NAME} AS full_name, {STATUS} AS status FROM outcomes",
    "outcome_rollup": f"""
        WITH {OUTCOMES}
        SELECT environment, count(*) AS total_workspaces, count(*) FILTER (success) AS successful_count,
               count(*) FILTER (NOT success) AS failed_count
        FROM outcomes GROUP BY environment
    """,
    "outcome_fallback": """
        WITH urgent AS (SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS ok FROM orders
                        WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
        SELECT c_mktsegment AS segment, count(*) AS total_workspaces, count(*) FILTER (coalesce(ok, false)) AS successful_count,
               count(*) FILTER (NOT coalesce(ok, false)) AS failed_count
        FROM customer LEFT JOIN urgent ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
    "outcome_document": f"""
        WITH {OUTCOMES},
        totals AS (SELECT environment, CAST(max(second) - min(second) AS DOUBLE) AS duration, count(*) AS total_workspaces,
                          count(*) FILTER (success) AS successful_count, count(*) FILTER (NOT success) AS failed_count
                   FROM outcomes GROUP BY environment)
        SELECT environment, duration, total_workspaces, successful_count, failed_count,
               folder AS name, {FULL_NAME} AS full_name, {STATUS} AS status, error
        FROM outcomes JOIN totals USING (environment)
    """,
    "outcome_fragments": f"""
        WITH {OUTCOMES},
        entries AS (SELECT environment, folder AS name, {FULL_NAME} AS full_name, {STATUS} AS status, error FROM outcomes),
        totals AS (SELECT environment, count(*) AS n, count(*) FILTER (success) AS good FROM outcomes GROUP BY environment),
        placed AS (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY name, full_name, status, error) AS position
                   FROM entries)
        SELECT environment, position,
            CASE WHEN position > 1 THEN ',' ELSE '' END || '{{"name":' || CAST(to_json(name) AS VARCHAR)
            || ',"full_name":' || CAST(to_json(full_name) AS VARCHAR) || ',"status":' || CAST(to_json(status) AS VARCHAR)
            || ',"error":' || CAST(to_json(error) AS VARCHAR) || '}}' AS fragment
        FROM placed
        UNION ALL
        SELECT environment, 0, '{{"environment":"' || environment || '","total_workspaces":' || n || ',"successful_count":' || good
            || ',"failed_count":' || (n - good) || ',"workspaces":['
        FROM totals
        UNION ALL
        SELECT environment, n + 1, ']}}' FROM totals
    """,
    "run_report": """
        WITH labelled AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
        SELECT 'action' AS part, CASE WHEN quality IS NULL THEN 'create' ELSE 'keep' END AS key, count(*) AS n
        FROM labelled GROUP BY ALL
        UNION ALL
        SELECT 'failed', lang, count(*) FILTER (coalesce(quality, 0) = 0) FROM labelled GROUP BY lang
        UNION ALL
        SELECT 'requested', lang, count(*) FROM labelled GROUP BY lang
        UNION ALL
        SELECT 'entry', CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END, count(*)
        FROM labelled WHERE quality IS NOT NULL GROUP BY ALL
    """,
}
