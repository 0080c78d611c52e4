"""Severity of toxic language by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch
from lakekit.sources.tables import spread

SAMPLE_DOCS = 20_000
VOCABULARY = 2_048
MIN_DOCS = 5
MIN_SCORE = 5.0
REJECT_FROM = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_NOT_WORD = r"[^\p{L}]+"


@dataclass(frozen=True)
class Model:
    """One weight per word for all thresholds; threshold k parts the grades up to k from those above."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """For each score the odds, as a share, of a grade above each threshold."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def features(text: str | None, words: dict[str, int]) -> tuple[list[int], list[float]]:
    """Known words of a whole text, in lower case, each valued by one and the logarithm of how often it occurs."""
    counts = Counter(word for word in _WORD.findall((text or "").lower()) if word in words)
    return [words[w] for w in counts], [1 + float(np.log(n)) for n in counts.values()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``limit`` labelled documents, the least by hash of their id.

    Null labels and ids are left out; of several labels of a document the greatest counts, of several texts the least.
    The sample is bounded, in rows too, so it is sent to the scan of the texts instead of moving these.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def telling_words(sample: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS, least: float = MIN_SCORE) -> list[tuple[str, float]]:
    """Words whose presence goes with the positive grades or against them more than chance explains, with the score:
    the signed root of chi-square. At most ``size``, strongest first; ties in word order."""
    totals = sample.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("n1")).first()
    n, n1 = totals.n, totals.n1 or 0
    if not n or n1 in (0, n):
        return []
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), _NOT_WORD))
    seen = sample.select((F.col("label") > 0).cast("long").alias("y"), F.explode(words).alias("word")).filter("word != ''")
    counts = seen.groupBy("word").agg(F.count("*").alias("df"), F.sum("y").alias("a")).filter(F.col("df") >= min_docs)
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    spread_of = F.sqrt(df * (n - df) * float(n1) * float(n - n1) / n)
    score = F.when(spread_of > 0, (a * n - df * n1) / spread_of).otherwise(0.0)
    strong = counts.withColumn("score", score).filter(F.abs("score") >= least)
    rows = strong.orderBy(F.abs("score").desc(), "word").limit(size).collect()
    return [(row.word, row.score) for row in rows]


def _rows(words: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text, words) for text in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([at for at, _ in found], pa.list_(pa.int32())),
                    pa.array([value for _, value in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "label", "at", "value"],
            )

    return run


def fit_ordinal(at: list, value: list, grades: np.ndarray, width: int, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient steps (Adam) on the whole sample.

    The chance of a grade above threshold k is the logistic of ``weights . x - threshold k``: one set of weights for
    all thresholds. Thresholds stay in order because each is the one before plus an exponential.
    """
    top = int(grades.max())
    sizes = np.array([len(x) for x in at])
    doc = np.repeat(np.arange(len(at)), sizes)
    word = np.concatenate([np.asarray(x, dtype=np.int64) for x in at]) if sizes.sum() else np.empty(0, dtype=np.int64)
    x = np.concatenate([np.asarray(v, dtype=np.float64) for v in value]) if sizes.sum() else np.empty(0)
    n = len(grades)
    shares = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - shares) / shares)
    theta = np.r_[np.zeros(width), first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        cuts = theta[width] + np.r_[0, np.cumsum(np.exp(theta[width + 1 :]))]
        score = np.bincount(doc, weights=x * theta[word], minlength=n)
        # chance of at most each grade, with 0 before the first and 1 after the last
        upto = np.c_[np.zeros(n), 1 / (1 + np.exp(-(cuts[None, :] - score[:, None]))), np.ones(n)]
        slope = upto * (1 - upto)
        chance = np.maximum(upto[rows, grades + 1] - upto[rows, grades], 1e-12)
        by_score = (slope[rows, grades + 1] - slope[rows, grades]) / chance
        by_cut = np.zeros(top)
        for k in range(top):
            by_cut[k] = -(np.where(grades == k, slope[:, k + 1], 0) - np.where(grades == k + 1, slope[:, k + 1], 0)).dot(1 / chance) / n
        grad = np.empty_like(theta)
        grad[:width] = np.bincount(word, weights=x * by_score[doc], minlength=width) / n + decay * theta[:width]
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad[width] = tail[0]
        grad[width + 1 :] = tail[1:] * np.exp(theta[width + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:width], theta[width] + np.r_[0, np.cumsum(np.exp(theta[width + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, grade: str, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model of the grades 0, 1, 2 ... in column ``grade`` of ``labels`` (``doc_id``), or None without two grades.

    Fitted on at most ``sample_docs`` labelled documents. Counts of words are made by Spark; at most ``VOCABULARY``
    words and their places in the sample's documents reach the driver.
    """
    with Scratch(docs.sparkSession, "toxicity") as work:
        sample = work.keep(labelled_sample(docs, labels, grade, sample_docs))
        return _fit(sample)


def _fit(sample: DataFrame) -> Model | None:
    words = {word: place for place, (word, _) in enumerate(telling_words(sample))}
    seen = sample.select("label").distinct().collect()
    if len(seen) < 2:
        return None
    schema = "doc_id long, label int, at array<int>, value array<double>"
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(_rows(words), schema)
    frame = rows.toPandas().sort_values("doc_id", kind="stable")
    ranks = sorted({int(row.label) for row in seen})
    grades = frame["label"].map({label: place for place, label in enumerate(ranks)}).to_numpy()
    weights, cuts = fit_ordinal(list(frame["at"]), list(frame["value"]), grades, len(words))
    return Model(words, weights, cuts)


def graded(docs: DataFrame, labels: DataFrame, work: Scratch, limit: int = SAMPLE_DOCS) -> DataFrame:
    """Severity grades for labels that only say toxic or not: ``doc_id, label, text`` of a bounded sample.

    Not toxic is 0. A toxic document is 2 if its telling words, those that go with the toxic label, occur more often
    in it than in the median toxic document that has any, and 1 otherwise.
    """
    sample = work.keep(labelled_sample(docs, labels, "toxic", limit))
    marks = {word: place for place, (word, score) in enumerate(telling_words(sample)) if score > 0}
    schema = "doc_id long, label int, at array<int>, value array<double>"
    hits = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(_rows(marks), schema)
    weight = F.aggregate("value", F.lit(0.0), lambda total, x: total + F.exp(x - 1))
    hits = work.keep(hits.select("doc_id", "label", weight.alias("hits")))
    middle = hits.filter("label > 0 and hits > 0").agg(F.percentile_approx("hits", 0.5, 1000).alias("m")).first().m
    severe = (F.col("label") > 0) & (F.col("hits") > F.lit(middle if middle is not None else 0.0))
    by_doc = hits.groupBy("doc_id").agg(F.max(F.when(severe, 2).otherwise((F.col("label") > 0).cast("int"))).alias("grade"))
    return work.keep(sample.join(by_doc, "doc_id").select("doc_id", F.col("grade").alias("label"), "text"))


def severity_model(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the severity grades that ``graded`` makes of the column ``toxic`` of ``labels``."""
    with Scratch(docs.sparkSession, "toxicity") as work:
        return _fit(graded(docs, labels, work))


def _expected(texts: list[str | None], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and the odds of each grade from 1 up, for each text."""
    if model is None:
        return np.zeros(len(texts)), np.zeros((len(texts), 1))
    scores = np.empty(len(texts))
    for place, text in enumerate(texts):
        at, value = features(text, model.words)
        scores[place] = model.weights[at] @ np.asarray(value) if at else 0.0
    above = model.above(scores)
    return above.sum(axis=1), above


def _score(model: Model | None, reject_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, above = _expected(batch.column("text").to_pylist(), model)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(expected, pa.float64()),
                    pa.array((above > 0.5).sum(axis=1), pa.int32()),
                    pa.array(list(above), pa.list_(pa.float64())),
                    pa.array(expected >= reject_from, pa.bool_()),
                ],
                ["doc_id", "expected_severity", "severity", "above", "toxic"],
            )

    return run


def severities(docs: DataFrame, model: Model | None, reject_from: float = REJECT_FROM) -> DataFrame:
    """``doc_id, expected_severity, severity, above, toxic`` of every row of ``docs`` (``doc_id``, ``text``).

    ``above`` holds the odds of a grade above each threshold, their sum is the expected severity, ``severity`` is the
    median grade, and ``toxic`` is true from an expected severity of ``reject_from`` on.

    Null and empty texts have no features: they get the severity of a text without any telling word. Repeated rows
    and null ids are scored like any other, other columns are not read, an empty table gives an empty result. Without
    a model (no labels, or one grade only) every severity is 0. Each text is scored inside its row: no shuffle.
    """
    schema = "doc_id long, expected_severity double, severity int, above array<double>, toxic boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_score(model, reject_from), schema)


def without_toxic(docs: DataFrame, model: Model | None, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, _ = _expected(batch.column(place).to_pylist(), model)
            yield batch.filter(pa.array(expected < reject_from))

    place = docs.columns.index("text")
    return spread(docs).mapInArrow(run, docs.schema)


def accuracy(spark: SparkSession, scored: DataFrame, labels: DataFrame) -> DataFrame:
    """How many labelled documents each verdict holds, to judge a model on documents it was not fitted on."""
    known = labels.select("doc_id", (F.col("toxic") > 0).alias("labelled")).dropna()
    return scored.join(known, "doc_id").groupBy("labelled", "toxic").agg(F.count("*").alias("documents"))
