"""Hard negatives: rows of another label that score a little less than a positive, found by R-trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch
from lakekit.session import stored

TREE_ROWS = 8_192
LEAF_ROWS = 128
FAN_OUT = 8
BUNDLE_TREES = 8
WAVE_ANCHORS = 32_768
STEP_ANCHORS = 1_024

# Wider than any score of 64 bits that counts; a row without an id comes last among ties.
_ALL = (-(1 << 62), 1 << 62)
_NO_ID = (1 << 63) - 1


def finite(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows with a label and a vector whose components are all there and finite."""
    values = F.col(embedding).cast("array<double>")
    whole = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))


def str_order(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> list[np.ndarray]:
    """Rows dealt over leaves by sort-tile-recursive packing: sorted by a coordinate, cut into slabs, each slab likewise.

    The next coordinate is the one that spreads most within the slab, so as many are used as there are levels.
    """
    tiles, leaves = [np.arange(len(vectors))], []
    while tiles:
        rows = tiles.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        part = vectors[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.shape[1] else 0
        order = np.argsort(part[:, axis], kind="stable") if part.shape[1] else np.arange(len(rows))
        slabs = min(FAN_OUT, -(-len(rows) // leaf))
        size = leaf * -(-len(rows) // (leaf * slabs))
        tiles += [rows[order[at : at + size]] for at in range(0, len(rows), size)][::-1]
    return leaves


@dataclass
class RTree:
    """Bounding boxes over packed rows: ``low, high`` per node, the root first, and each node's children or rows."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    past: np.ndarray
    leaf: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int]) -> RTree:
        """From rows in packed order and the sizes of their leaves."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        level = [(vectors[b:e].min(axis=0), vectors[b:e].max(axis=0), int(b), int(e), True) for b, e in zip(begins, ends)]
        levels = [level]
        while len(level) > 1:
            groups = [(at, min(at + FAN_OUT, len(level))) for at in range(0, len(level), FAN_OUT)]
            level = [
                (np.min([n[0] for n in level[b:e]], axis=0), np.max([n[1] for n in level[b:e]], axis=0), b, e, False)
                for b, e in groups
            ]
            levels.append(level)
        nodes, offset = [], 0
        for level in reversed(levels):
            offset += len(level)
            nodes += [(lo, hi, b if leaf else b + offset, e if leaf else e + offset, leaf) for lo, hi, b, e, leaf in level]
        low, high, first, past, leaf = zip(*nodes)
        return cls(np.stack(low), np.stack(high), np.array(first), np.array(past), np.array(leaf))


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with anything in each box, summed over coordinate intervals."""
    above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return above @ low.T + below @ high.T, above @ high.T + below @ low.T


def _exact(anchors: np.ndarray, others: np.ndarray) -> type:
    """Doubles where every inner product of the two is a whole number below 2**53, else 64-bit or unbounded integers."""
    if not anchors.size or not others.size:
        return np.float64
    largest = int(np.abs(anchors).max()) * int(np.abs(others).max()) * anchors.shape[1]
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object


@dataclass
class _Tree:
    """A stored tree, opened, with its vectors in a type in which their products with the anchors are exact."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    nodes: RTree

    @classmethod
    def opened(cls, row: dict, anchors: np.ndarray) -> _Tree:
        ids, labels = _longs(row["ids"]), _longs(row["labels"])
        vectors = _longs(row["vectors"]).reshape(len(ids), row["width"])
        return cls(row["tree"], ids, labels, vectors.astype(_exact(anchors, vectors)), RTree.build(vectors, _longs(row["sizes"]).tolist()))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = self.vectors.dtype
        return bounds(anchors.astype(kind), self.nodes.low.astype(kind), self.nodes.high.astype(kind))


def search(
    trees: list[_Tree],
    reach: list[tuple[np.ndarray, np.ndarray]],
    ask: dict,
    anchor: np.ndarray,
    same_label: bool,
    k: int,
) -> list[list[tuple[int, int]]]:
    """For each window of scores an anchor asks for, the first ``k`` rows in it: ``score, id``, ties by id.

    ``reach`` holds the least and the largest score of the anchor in each node of each tree. Nodes of all trees leave one
    queue by their largest score. A node is passed over if it lies outside every window or, in those it meets, strictly
    below the kth score found; one that ties with the kth is opened, as an id may still decide.
    """
    windows = list(zip(ask["least"], ask["most"]))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in windows]

    def floor(place: int) -> int:
        return -found[place][-1][0] if len(found[place]) == k else windows[place][0]

    def wanted(low, high) -> bool:
        return any(low <= most and high >= floor(place) for place, (_, most) in enumerate(windows))

    queue = [(-high[0], at, 0) for at, (low, high) in enumerate(reach) if wanted(low[0], high[0])]
    heapq.heapify(queue)
    while queue:
        _, at, node = heapq.heappop(queue)
        tree, (low, high) = trees[at], reach[at]
        if not wanted(low[node], high[node]):
            continue
        first, past = int(tree.nodes.first[node]), int(tree.nodes.past[node])
        if not tree.nodes.leaf[node]:
            for child in range(first, past):
                if wanted(low[child], high[child]):
                    heapq.heappush(queue, (-high[child], at, child))
            continue
        scores = tree.vectors[first:past] @ anchor.astype(tree.vectors.dtype)
        eligible = (tree.labels[first:past] == ask["label"]) == same_label
        if tree.number == ask["home"] and first <= ask["place"] < past:
            eligible[ask["place"] - first] = False
        for place, (_, most) in enumerate(windows):
            hits = np.flatnonzero(eligible & (scores >= floor(place)) & (scores <= most))
            if len(hits):
                rows = [(-int(scores[i]), int(tree.ids[first + i]), at, first + int(i)) for i in hits.tolist()]
                found[place] = heapq.nsmallest(k, found[place] + rows)
    return [[(-negated, i) for negated, i, *_ in best] for best in found]


_TREES = pa.schema(
    [
        ("tree", pa.int64()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
        ("labels", pa.binary()),
        ("anchors", pa.binary()),
        ("vectors", pa.binary()),
        ("sizes", pa.binary()),
    ]
)
_TREES_DDL = "tree long, width int, ids binary, labels binary, anchors binary, vectors binary, sizes binary"
_ASKS = "home long, place int, anchor_id long, label long, width int, vector binary, least array<long>, most array<long>"
_FOUND = pa.schema(
    [("home", pa.int64()), ("place", pa.int32()), ("window", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())]
)
_FOUND_DDL = "home long, place int, window int, other_id long, score long"


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut into runs of vectors of one length, each packed into an R-tree."""
    number = TaskContext.get().partitionId() << 32
    run: list[pa.RecordBatch] = []

    def tree() -> pa.RecordBatch:
        rows = pa.Table.from_batches(run).combine_chunks()
        width = rows["width"][0].as_py()
        flat = np.asarray(rows["vector"].combine_chunks().flatten(), dtype=np.int64).reshape(rows.num_rows, width)
        leaves = str_order(flat)
        order = np.concatenate(leaves)
        columns = {
            "tree": [number],
            "width": [width],
            "ids": [np.asarray(rows["vec_id"].fill_null(_NO_ID), dtype=np.int64)[order].tobytes()],
            "labels": [np.asarray(rows["label"], dtype=np.int64)[order].tobytes()],
            "anchors": [np.asarray(rows["is_anchor"].cast(pa.int8()), dtype=np.int8)[order].tobytes()],
            "vectors": [np.ascontiguousarray(flat[order]).tobytes()],
            "sizes": [np.array([len(x) for x in leaves], dtype=np.int64).tobytes()],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _TREES], schema=_TREES)

    size = 0
    for batch in batches:
        widths = np.asarray(batch.column("width"))
        turns = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
        for begin, end in zip(turns, turns[1:]):
            while begin < end:
                if run and (size == TREE_ROWS or run[-1].column("width")[0].as_py() != widths[begin]):
                    yield tree()
                    number, run, size = number + 1, [], 0
                part = batch.slice(begin, min(end - begin, TREE_ROWS - size))
                run.append(part)
                size, begin = size + part.num_rows, begin + part.num_rows
    if run:
        yield tree()


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each tree, each asking for all scores."""
    for batch in batches:
        for row in batch.to_pylist():
            places = np.flatnonzero(np.frombuffer(row["anchors"], dtype=np.int8))
            ids, labels = _longs(row["ids"]), _longs(row["labels"])
            vectors, n = _longs(row["vectors"]).reshape(len(ids), row["width"]), len(places)
            columns = [
                pa.array([row["tree"]] * n, pa.int64()),
                pa.array(places, pa.int32()),
                pa.array(ids[places], pa.int64()),
                pa.array(labels[places], pa.int64()),
                pa.array([row["width"]] * n, pa.int32()),
                pa.array([vectors[p].tobytes() for p in places], pa.binary()),
                pa.array([[_ALL[0]]] * n, pa.list_(pa.int64())),
                pa.array([[_ALL[1]]] * n, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["home", "place", "anchor_id", "label", "width", "vector", "least", "most"])


def _searched(at_home: bool, same_label: bool, k: int):
    def run(key: tuple, asked: pa.Table, stored_trees: pa.Table) -> pa.Table:
        asks, rows = asked.to_pylist(), stored_trees.to_pylist()
        hits: list[tuple] = []
        for width in sorted({row["width"] for row in rows} & {ask["width"] for ask in asks}):
            mine = [ask for ask in asks if ask["width"] == width]
            everyone = np.stack([_longs(ask["vector"]) for ask in mine])
            trees = [_Tree.opened(row, everyone) for row in rows if row["width"] == width]
            for begin in range(0, len(mine), STEP_ANCHORS):
                anchors = everyone[begin : begin + STEP_ANCHORS]
                reach = [tree.bounds(anchors) for tree in trees]
                for at, ask in enumerate(mine[begin : begin + STEP_ANCHORS]):
                    open_ = [i for i, tree in enumerate(trees) if at_home or tree.number != ask["home"]]
                    best = search(
                        [trees[i] for i in open_], [(reach[i][0][at], reach[i][1][at]) for i in open_], ask, anchors[at], same_label, k
                    )
                    for window, first in enumerate(best):
                        hits += [(ask["home"], ask["place"], window, other, score) for score, other in first]
        columns = zip(*hits) if hits else [[]] * len(_FOUND)
        return pa.Table.from_arrays([pa.array(values, f.type) for values, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _mined(asks: DataFrame, trees: DataFrame, n_trees: int, same_label: bool, k: int, work: Scratch) -> DataFrame:
    """``home, place, window, rank, other_id, score``: the first ``k`` rows in each window of each anchor, over all trees.

    An anchor's own tree is searched first. Where that fills a window, its kth score is the least that the other trees
    are still asked for. These meet the anchors in bundles and waves of a bounded size.
    """
    keys = ["home", "place", "window"]
    at_home = asks.groupBy("home").cogroup(trees.groupBy("tree")).applyInArrow(_searched(True, same_label, k), _FOUND_DDL)
    at_home = work.keep(at_home)
    full = at_home.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    kths = full.groupBy("home", "place").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kths"))
    raised = F.transform("least", lambda x, i: F.greatest(x, F.try_element_at("kths", i)))
    asked = asks.join(kths, ["home", "place"], "left")
    asked = asked.withColumn("least", F.when(F.col("kths").isNull(), F.col("least")).otherwise(raised)).drop("kths")
    asked = work.keep(asked)

    n_asked, bundles = asked.count(), -(-n_trees // BUNDLE_TREES)
    # Small tables still meet in as many groups as there are cores.
    spread = min(n_asked, -(-2 * asks.sparkSession.sparkContext.defaultParallelism // bundles))
    waves = max(-(-n_asked // WAVE_ANCHORS), spread)
    if n_trees < 2 or not waves:
        return _first(at_home, keys, k)
    wave, bundle = F.pmod(F.xxhash64("home", "place"), F.lit(waves)), F.pmod(F.xxhash64("tree"), F.lit(bundles))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = asked.select("*", wave.alias("wave"), each(bundles).alias("bundle"))
    right = trees.select("*", bundle.alias("bundle"), each(waves).alias("wave"))
    away = (
        left.groupBy("wave", "bundle")
        .cogroup(right.groupBy("wave", "bundle"))
        .applyInArrow(_searched(False, same_label, k), _FOUND_DDL)
    )
    return _first(at_home.union(away), keys, k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives, from ``vec_id, label, vector`` (whole numbers).

    A row's score is its inner product with the anchor; higher scores come first, ties by smaller ``vec_id``, rows
    without ``vec_id`` last. The positives are the anchor's first ``positives`` other rows of its label. Of the rows of
    other labels with ``low * positive_score <= 100 * score <= high * positive_score``, the first ``negatives`` are
    returned: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. If there are fewer, all are.

    Every row is packed into an R-tree by sort-tile-recursive order: slabs of equal counts by the first component, which
    rows are ranged over by the second, runs of 8,192, and within a run by the components that spread most. A box gives
    each coordinate an interval and thus a least and a largest inner product with an anchor; a best-first queue opens
    boxes by the largest and prunes those outside all score windows or strictly below the kth found. Anchors search
    their own tree first, which raises what they ask of the others; then waves of anchors meet bundles of trees. The
    work is anchors times rows, in blocks, less what the boxes prune; unclustered vectors of many components prune little.

    Vectors that are null, or hold a null, take no part, nor do rows without a label; vectors of different lengths do not
    meet. Repeated rows, and rows that share a ``vec_id``, are rows of their own, and each anchor row gets its result.
    Equal vectors are ranged by ``vec_id`` and hash, so any number of them spreads. Scores beyond 64 bits are an error.
    No anchors or no rows give none; other columns are not read.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Scratch(spark, "negatives") as work:
        taken = rows.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            F.col("vector").cast("array<long>").alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
            F.size("vector").alias("width"),
        )
        whole = F.forall("vector", lambda x: x.isNotNull())
        taken = work.keep(taken.filter(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))))
        n_rows = taken.count()
        if not n_rows:
            return spark.createDataFrame([], result)
        slabs = math.ceil(math.sqrt(n_rows / TREE_ROWS))
        component = [F.coalesce(F.try_element_at("vector", F.lit(i)), F.lit(0)) for i in (1, 2)]
        shares = [i / slabs for i in range(1, slabs)]
        cuts = taken.select(component[0].cast("double").alias("x")).approxQuantile("x", shares, 0.01) if shares else []
        slab = sum((F.when(component[0] > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
        order = ["width", "slab", "second", "vec_id", "label", "tie"]
        placed = taken.withColumns({"slab": slab, "second": component[1], "tie": F.xxhash64("vector", F.spark_partition_id())})
        parts = max(1, math.ceil(n_rows / (4 * TREE_ROWS)))
        placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        trees = work.keep(placed.select("vec_id", "label", "vector", "is_anchor", "width").mapInArrow(_packed, _TREES_DDL))
        asks = work.keep(trees.mapInArrow(_anchor_rows, _ASKS))
        n_trees = trees.count()

        place = ["home", "place"]
        good = _mined(asks, trees, n_trees, True, positives, work)
        good = work.keep(
            good.select(
                *place,
                (F.col("rank") - 1).alias("window"),
                F.col("other_id").alias("positive_id"),
                F.col("score").alias("positive_score"),
            )
        )
        p, hundredth = F.col("positive_score").cast("decimal(20,0)"), F.lit(Decimal("0.01"))
        least, most = F.ceil(p * low * hundredth).cast("long"), F.floor(p * high * hundredth).cast("long")
        window = F.struct("window", least.alias("least"), most.alias("most"))
        windows = good.groupBy(*place).agg(F.sort_array(F.collect_list(window)).alias("w"))
        narrowed = asks.drop("least", "most").join(windows, place)
        narrowed = work.keep(narrowed.withColumns({"least": F.col("w.least"), "most": F.col("w.most")}).drop("w"))
        bad = _mined(narrowed, trees, n_trees, False, negatives, work)
        named = asks.select(*place, "anchor_id")
        found = bad.join(good, [*place, "window"]).join(named, place)

        def known(column: str) -> Column:
            return F.when(F.col(column) != _NO_ID, F.col(column))

        found = found.select(
            known("anchor_id").alias("anchor_id"),
            known("positive_id").alias("positive_id"),
            "rank",
            known("other_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
        return stored(found, "negatives")

