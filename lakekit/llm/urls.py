"""URL filters: host and path rules, and gradient-boosted trees over lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch
from lakekit.session import stored

SAMPLE_URLS = 20_000
TREES = 20
DEPTH = 4
SEED = 7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "labels",
    "hyphens",
    "digit_ratio",
    "entropy",
    "parameters",
    "suffix_blocked",
    "suffix_seen",
]


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host and the start of a path, parted by the first slash: ``net/`` or ``example.org/en/1``."""

    verdict: str
    pattern: str

    def fits(self) -> Column:
        host, _, path = self.pattern.partition("/")
        same = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        return same & F.startswith("path", F.lit("/" + path))


def parts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path`` of every row; both parts empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    after = F.substring("rest", F.length("raw") + 1, F.length("rest"))
    return (
        pages.select("page_id", "url", rest.alias("rest"))
        .withColumn("raw", host)
        .select(
            "page_id",
            "url",
            F.translate("raw", _UPPER, _LOWER).alias("host"),
            F.regexp_extract(after, "^[^?#]*", 0).alias("path"),
        )
    )


def ruled(rows: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, else null. Rules are few and constant."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for each in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        rule = F.when(each.fits(), F.lit(each.pattern)).otherwise(rule)
        verdict = F.when(each.fits(), F.lit(each.verdict)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Bits per character of a string's own character frequencies."""
    size = F.length(text).cast("double")

    def part(char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return -share * F.log2(share)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.coalesce(F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds what can be told from the characters of a url, and ``suffix``, the last label of its host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.regexp_count(url, F.lit("[0-9]"))
    named = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/[^/]")),
        "labels": F.size(F.split("host", r"\.")),
        "hyphens": F.regexp_count("host", F.lit("-")),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
    }
    with_suffix = rows.withColumn("suffix", F.substring_index("host", ".", -1))
    return with_suffix.withColumns({name: value.cast("double") for name, value in named.items()})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Per last host label, over all labelled urls: the smoothed share that is blocked, and the log of their number."""
    blocked = F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0))
    return labelled.groupBy("suffix").agg(
        ((blocked + 1) / (F.count("*") + 2)).alias("suffix_blocked"), F.log1p(F.count("*")).alias("suffix_seen")
    )


def judge(pages: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, blocked_score`` of every row of ``pages`` (``page_id``, ``url``).

    The longest fitting rule decides. Urls that no rule fits are judged by boosted trees whose labelled urls are
    those that rules decide. Counts by suffix cover all labelled urls; the trees are fitted on at most
    ``SAMPLE_URLS`` of them, the least by hash. All of it is column functions and Spark's own learner: no Python
    runs on executors.

    With no labelled url or only one verdict among them there is nothing to learn: that verdict, or allow. A null
    or malformed url has empty host and path and is judged by its features like any other. Rows stay as many as
    they are, equal urls get equal verdicts, other columns are not read, an empty table gives an empty result.
    """
    with Scratch(pages.sparkSession, "urls") as work:
        rows = work.keep(lexical(ruled(parts(pages), rules)))
        labelled = rows.filter("rule_verdict is not null")
        statistics = work.keep(suffix_statistics(labelled))
        unseen = {"suffix_blocked": F.coalesce("suffix_blocked", F.lit(0.5)), "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0))}
        featured = rows.join(statistics, "suffix", "left").withColumns(unseen)
        label = (F.col("rule_verdict") == "block").cast("double").alias("label")
        chosen = labelled.orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(SAMPLE_URLS)
        sample = chosen.join(statistics, "suffix").select(label, *FEATURES)
        sample = work.keep(sample.coalesce(4))
        seen = [row.label for row in sample.select("label").distinct().collect()]
        verdict = F.when(F.col("score") > 0.5, "block").otherwise("allow")
        if len(seen) < 2:
            scored = featured.withColumn("score", F.lit(seen[0] if seen else 0.0))
        else:
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="vector")
            model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="vector"), trees]).fit(sample)
            scored = model.transform(featured).withColumn("score", F.col("prediction"))
        result = scored.select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce(F.col("rule_verdict"), verdict).alias("verdict"),
        )
        return stored(result, "urls")
