from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakekit.functions import id_count, marker_lines, report_context, split_lines, strip_space
from lakekit.operators.extract import explode_lines

TEXT = st.text(alphabet="ab]\t \n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029é", max_size=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=60))
def test_lines_split_as_text_files_do(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", split_lines(F.col("text")).alias("l"))
    assert {r.k: r.l for r in df.collect()} == {k: t.splitlines() for k, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=60))
def test_space_is_stripped_at_both_ends(spark, texts):
    lines = [t.replace("\n", "a") for t in texts]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, text string").select("k", strip_space(F.col("text")).alias("s"))
    assert {r.k: r.s for r in df.collect()} == {k: t.strip() for k, t in enumerate(lines)}


def test_explode_numbers_lines_from_one(spark, as_rows):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, None)], "k int, text string")
    assert as_rows(explode_lines(df)) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c")]


def test_marker_lines_and_counts(spark):
    df = spark.createDataFrame([("# META x\ny\n  # META z",)], "text string")
    got = df.select(
        marker_lines(split_lines(F.col("text")), "# META").alias("m"),
        id_count(F.col("text"), "[xyz]").alias("n"),
        F.length(report_context(F.repeat(F.lit("q"), 500))).alias("c"),
    ).first()
    assert (got.m, got.n, got.c) == (["# META x", "  # META z"], 3, 120)
