"""Hard negatives against all pairs, and the R-tree's bounds."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakekit.llm import negatives, queries

TABLES = "/root/testdata/sf0.01"


def brute(rows, is_anchor, positives=5, top=3, low=50, high=95):
    """``rows`` are (vec_id, label, vector); every pair is compared."""
    last = 1 << 63
    out = []
    for at, (anchor, label, vector) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), i if i is not None else last, other_label)
            for n, (i, other_label, other) in enumerate(rows)
            if n != at and len(other) == len(vector)
        ]
        good = sorted(s for s in scored if s[2] == label)[:positives]
        bad = sorted(s for s in scored if s[2] != label)
        for p, positive, _ in good:
            inside = [s for s in bad if low * -p <= 100 * -s[0] <= high * -p][:top]
            out += [(anchor, positive, rank, i, -p, -n) for rank, (n, i, _) in enumerate(inside, 1)]
    return collections.Counter(tuple(None if x == last else x for x in row) for row in out)


def found(df):
    return collections.Counter(
        (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()
    )


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, "x") for row in rows], "vec_id long, label int, vector array<long>, home long, tree string")


@pytest.mark.parametrize("tree_rows", [40, 8_192])
def test_clusters_ties_and_repeats(spark, monkeypatch, tree_rows):
    """Many small trees in several bundles and waves, a third of the rows equal, ids that repeat or are missing."""
    monkeypatch.setattr(negatives, "WAVE_ANCHORS", 7)
    monkeypatch.setattr(negatives, "BUNDLE_TREES", 2)
    random = np.random.default_rng(5)
    rows = [(i, int(random.integers(3)), random.integers(-9, 10, 6).tolist()) for i in range(250)]
    rows += [(1000 + i, i % 2, [4, 4, -4, 1, 0, 2]) for i in range(120)]
    rows += [(20, 1, [1, 2, 3, 4, 5, 6]), (20, 1, [1, 2, 3, 4, 5, 6]), (None, 1, [9] * 6), (None, 0, [8] * 6)]
    rows += [(2000, 0, [5, 5]), (2010, 0, [4, 4]), (2011, 1, [4, 3]), (2020, 2, []), (2030, 1, [])]
    df = table(spark, rows).repartition(6)
    trees_of = negatives.TREE_ROWS
    with monkeypatch.context() as inner:
        inner.setattr(negatives, "TREE_ROWS", tree_rows)
        inner.setattr(negatives, "LEAF_ROWS", 8)
        got = found(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert trees_of == 8_192
    assert got == brute(rows, lambda i: i is not None and i % 10 == 0)


def test_nulls_and_empty(spark):
    rows = [(0, 1, [1, 2]), (1, None, [1, 2]), (2, 1, None), (3, 1, [1, None]), (4, 1, [2, 2]), (5, 0, [1, 1]), (None, 0, [1, 1])]
    df = table(spark, rows)
    usable = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    assert found(negatives.hard_negatives(df, F.col("vec_id") == 0)) == brute(usable, lambda i: i == 0)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") == 99).count() == 0


def test_large_components_stay_exact(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 7]), (2, 1, [big, 8]), (3, 0, [big // 2 + 3, 1]), (4, 0, [big // 2 + 3, 2])]
    assert found(negatives.hard_negatives(table(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)


def test_bounds_hold():
    random = np.random.default_rng(1)
    vectors = random.integers(-50, 50, (700, 5))
    leaves = negatives.str_order(vectors, 32)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(700)) and max(map(len, leaves)) <= 32
    packed = vectors[np.concatenate(leaves)]
    nodes = negatives.RTree.build(packed, [len(x) for x in leaves])
    anchors = random.integers(-50, 50, (9, 5))
    low, high = negatives.bounds(anchors, nodes.low, nodes.high)
    scores = anchors @ packed.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (high[:, 0] >= scores.max(axis=1)).all()
    for node in np.flatnonzero(nodes.leaf):
        inside = scores[:, nodes.first[node] : nodes.past[node]]
        assert (low[:, node] <= inside.min(axis=1)).all() and (high[:, node] >= inside.max(axis=1)).all()


def test_query(spark):
    vectors = spark.read.parquet(f"{TABLES}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    rows = []
    for r in vectors:
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(int).tolist()))
    got = found(queries.QUERIES["op13_hard_negatives"](spark, TABLES))
    assert got == brute(rows, lambda i: i % 50 == 0) and got


def test_query_leaves_out_what_is_not_finite(spark, tmp_path):
    rows = [(50, 1, [0.5, 0.25]), (1, 1, [float("nan"), 1.0]), (2, 1, [1.0, None]), (3, None, [1.0, 1.0]), (4, 1, None)]
    rows += [(5, 1, [0.6, 0.2]), (9, 1, [0.4, 0.2]), (6, 0, [0.3, 0.3]), (7, 9, [0.3, 0.31]), (8, 0, [float("inf"), 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    assert {(r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in got} == {
        (50, 5, 1, 7), (50, 5, 2, 6), (50, 9, 1, 7), (50, 9, 2, 6)
    }
