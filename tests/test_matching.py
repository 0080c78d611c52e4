import pytest
from pyspark.sql import functions as F

from lakekit.operators.matching import fits_broadcast, match, row_salt
from lakekit.operators.skew import frequent

WAYS = {
    "broadcast": {},
    "shuffled": {"broadcast_rows": 0},
    "hot keys salted": {"broadcast_rows": 0, "hot_key_rows": 10, "fan_out": 4},
}


@pytest.fixture(scope="module")
def left(spark):
    """One key holds most rows, and one key is missing."""
    hot = spark.range(900).select(F.lit("hot").alias("k"), F.col("id").alias("n"))
    others = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 20).alias("k"), (F.col("id") + 900).alias("n"))
    return hot.union(others).union(spark.range(1000, 1003).select(F.lit(None).cast("string"), "id"))


@pytest.fixture(scope="module")
def right(spark):
    rows = [("hot", 3), ("hot", 1), ("k1", 7), ("k2", 5), ("gone", 1), (None, 9)]
    return spark.createDataFrame(rows, "k string, v int")


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("how", ["left_semi", "left_anti", "left"])
def test_rows_are_matched_once(left, right, way, how):
    keep = {"v": F.min("v")} if how == "left" else None
    got = sorted((r.n, r.asDict().get("v")) for r in match(left, right, ["k"], how, keep, **WAYS[way]).collect())
    best = {"hot": 1, "k1": 7, "k2": 5}
    rows = [(r.n, best.get(r.k)) for r in left.collect()]
    expected = {
        "left": rows,
        "left_semi": [(n, None) for n, v in rows if v is not None],
        "left_anti": [(n, None) for n, v in rows if v is None],
    }[how]
    assert got == sorted(expected)


def test_kept_columns_need_names_of_their_own(left, right):
    with pytest.raises(ValueError, match="both sides: .'n'."):
        match(left, right, ["k"], "left", keep={"n": F.min("v")})


def test_copies_of_one_row_are_spread(spark):
    copies = spark.range(0, 4000, 1, 40).select(F.lit("hot").alias("k"))
    salts = copies.withColumn("s", row_salt(copies, F.lit(4))).groupBy("s").count().collect()
    assert len(salts) == 4 and max(r["count"] for r in salts) < 2500
    right = spark.createDataFrame([("hot",), ("cold",)], "k string")
    assert match(copies, right, ["k"], "left_semi", **WAYS["hot keys salted"]).count() == 4000


def test_broadcast_check_bounds_rows_and_bytes(spark):
    assert fits_broadcast(spark.range(10), rows=10)
    assert not fits_broadcast(spark.range(11), rows=10)
    assert not fits_broadcast(spark.range(2).select(F.repeat(F.lit("x"), 100).alias("t")), rows=10, size=150)
    assert fits_broadcast(spark.range(0))


def test_incomplete_keys_on_the_left_are_spread_and_kept(spark):
    left = spark.range(200).select(F.when(F.col("id") < 3, F.col("id")).alias("k"), "id")
    right = spark.range(2).select(F.col("id").alias("k"))
    for how, rows in (("left", 200), ("left_anti", 198), ("left_semi", 2)):
        assert match(left, right, ["k"], how, broadcast_rows=0).count() == rows


def test_a_hot_key_and_thousands_of_warm_ones_are_spread(spark):
    """One key has a sixth of the rows, 10,000 warm ones share two thirds, the rest is cold; the share decides the salts."""
    n = F.col("id")
    key = F.when(n % 6 == 0, F.lit(-1)).when(n % 6 < 5, n % 10_000).otherwise(n + 1_000_000)
    left = spark.range(0, 900_000, 1, 8).select(key.alias("k"), n.alias("v"))
    fans = frequent(left, ["k"], rows_per_salt=20)
    # a salt takes 54 rows, a 16,384th of them all; a warm key has 60
    assert fans.incomplete == 1 and len(fans.keys) == 10_001
    assert max(fans.keys.values()) == 2_778 and sorted(fans.keys.values())[-2] == 2
    salts = fans.spread(left).groupBy("k", "_salt").count()
    assert salts.agg(F.max("count")).first()[0] < 200
    right = spark.range(-1, 12_000).select(F.col("id").alias("k"))
    joined = match(left, right, ["k"], "left_semi", broadcast_rows=0, hot_key_rows=20)
    assert joined.count() == left.filter("k < 12000").count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 900000") == 1


def test_incomplete_keys_take_salts_by_their_share(spark):
    left = spark.range(1_000).select(F.when(F.col("id") < 100, F.col("id")).alias("k"), F.lit(1).alias("j"), "id")
    fans = frequent(left, ["k", "j"], rows_per_salt=90)
    assert (fans.keys, fans.incomplete) == ({}, 10)
    assert fans.spread(left).select("_salt").distinct().count() == 10
    assert frequent(left.limit(0), ["k"]).keys == {}
