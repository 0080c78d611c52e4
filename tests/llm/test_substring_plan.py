"""How often texts are shuffled to cut repeated passages."""

from lakekit.llm import substring
from lakekit.llm.scratch import Scratch

PASSAGE = " ".join(f"w{i}" for i in range(50))


def test_last_level_and_cut_share_a_shuffle_of_texts(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(substring, "stored", lambda df, label: df.collect() and ran.append(df) or df)
    docs = spark.createDataFrame(
        [(1, f"a b {PASSAGE} c"), (2, f"d {PASSAGE}"), (3, "alone"), (3, "alone"), (None, None)], "doc_id long, text string"
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        substring.without_repeats(docs, window=35)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = ran[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1


def test_cutting_texts_shuffles_them_once(spark):
    docs = spark.createDataFrame(
        [(1, f"a b {PASSAGE} c", "x", 0), (2, f"d {PASSAGE}", "y", 0), (3, "alone", None, 5), (3, "alone", None, 5), (None, None, "z", None)],
        "doc_id long, text string, `the.source` string, n_chars int",
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = substring.cut_texts(docs, window=35)
        found = sorted(map(tuple, cut.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert cut.schema == docs.schema
    assert found == sorted([(1, "a b c", "x", 5), (2, "d", "y", 1), (3, "alone", None, 5), (3, "alone", None, 5), (None, None, "z", None)], key=repr)
    plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1


def test_longer_levels_are_kept(spark):
    docs = spark.createDataFrame([(1, f"a {PASSAGE}"), (2, f"{PASSAGE} b"), (3, "alone")], "doc_id long, text string")
    with Scratch(spark, "levels") as work:
        rows = substring.repeated_windows(docs, 8, work, longest=64).select("length", "first", "last").collect()
    assert sorted({(r.length, r.last[0] - r.first[0] + 1) for r in rows}) == [(8, 43), (16, 35), (32, 19)]
