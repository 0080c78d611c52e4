"""Nearest neighbours by a permutation index: pivots in order of nearness, pivot inverted files, footrule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch
from lakekit.session import stored

PIVOTS = 256
PREFIX = 32
SAMPLE_ROWS = 8_192
SAMPLE_QUERIES = 1_000
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024


@dataclass(frozen=True)
class Index:
    """What is fitted on a bounded sample: the pivots and the share of rows to rank again."""

    pivots: np.ndarray
    prefix: int
    share: float
    sample_recall: float


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first, by angle; ties to the smaller number."""
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (vectors / np.where(sizes == 0, 1, sizes)) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class InvertedFiles:
    """For each pivot the rows that have it among their nearest ones, with the rank it has there."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.rows, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row = (by_pivot // self.prefix).astype(np.int64)
        self.rank = (by_pivot % self.prefix).astype(np.int32)
        self.start = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """The distance of each row's order from this one; a pivot not among the nearest counts as just behind.

        Two orders without a common pivot are farthest; each common pivot brings them nearer, so only the posting
        lists of the query's pivots are walked.
        """
        distance = np.full(self.rows, self.prefix * (self.prefix + 1), dtype=np.int32)
        for place, pivot in enumerate(order.tolist()):
            part = slice(self.start[pivot], self.start[pivot + 1])
            rank = self.rank[part]
            # |i - j| instead of the two times that the pivot would be missing
            distance[self.row[part]] += np.abs(rank - place) - (self.prefix - place) - (self.prefix - rank)
        return distance


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        cut = np.partition(-scores, k - 1)[k - 1]
        chosen = np.flatnonzero(-scores <= cut)
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))[:k]]


def search_block(index: Index, ids, vectors, orders, query_ids, queries, query_orders, k: int):
    """The nearest ``k`` found in a block for each query: row numbers of queries, ids and scores."""
    files = InvertedFiles(orders, len(index.pivots))
    limit = min(len(ids), max(k + 1, int(np.ceil(index.share * len(ids)))))
    by_id = np.argsort(ids, kind="stable")
    rank_of_id = np.empty(len(ids), dtype=np.int64)
    rank_of_id[by_id] = np.arange(len(ids))
    out: tuple[list, list, list] = ([], [], [])
    for place in range(len(query_ids)):
        if limit < len(ids):
            far = files.footrule(query_orders[place]).astype(np.int64) * len(ids) + rank_of_id
            near = np.argpartition(far, limit - 1)[:limit]
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != query_ids[place]]
        scores = vectors[near] @ queries[place]
        best = _best(scores, ids[near], k)
        out[0].append(np.full(len(best), place))
        out[1].append(ids[near][best])
        out[2].append(scores[best])
    return tuple(np.concatenate(part) if part else np.empty(0) for part in out)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that can take part."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))


def _footrule_ranks(files: InvertedFiles, ids, vectors, orders, asked: np.ndarray, k: int) -> np.ndarray:
    """How many rows the footrule puts up to and with each of the true ``k`` nearest of each asked row."""
    by_id = np.empty(len(ids), dtype=np.int64)
    by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    found = []
    for row in asked:
        others = np.delete(np.arange(len(ids)), row)
        best = others[_best(vectors[others] @ vectors[row], ids[others], k)]
        far = files.footrule(orders[row]).astype(np.int64) * len(ids) + by_id
        found.append(np.searchsorted(np.sort(far), far[best]) + 1)
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def fit(rows: DataFrame, k: int, pivots: int = PIVOTS, prefix: int = PREFIX, target: float = 0.95) -> Index | None:
    """Pivots and share from at most ``SAMPLE_ROWS`` rows, the ones with the least hash of their id.

    The pivots are the first rows of the sample, at most half of it. Up to ``SAMPLE_QUERIES`` of the others, none of
    which is a pivot, are asked: the share of rows that the footrule passes on is the least at which it puts ``target``
    of their true neighbours among the sample's rows that far in front. Nearest neighbours within a sample lie farther
    off than in the whole, so this errs towards more. Null if there is no row.
    """
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    if taken.empty:
        return None
    width = taken["embedding"].map(len).mode().iloc[0]
    taken = taken[taken["embedding"].map(len) == width]
    sample, ids = np.stack(taken["embedding"].to_list()), taken["vec_id"].to_numpy()
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = unit[: max(1, min(pivots, len(unit) // 2))]
    prefix = min(prefix, len(chosen))
    orders = permutations(sample, chosen, prefix)
    asked = np.arange(len(chosen), min(len(sample), len(chosen) + SAMPLE_QUERIES))
    ranks = np.sort(_footrule_ranks(InvertedFiles(orders, len(chosen)), ids, sample, orders, asked, k))
    if not len(ranks):
        return Index(chosen, prefix, 1.0, 1.0)
    limit = int(ranks[int(np.ceil(target * len(ranks))) - 1])
    return Index(chosen, prefix, limit / len(sample), float((ranks <= limit).mean()))


def _ordered(index: Index):
    width = index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding")
            fits = np.asarray([len(v) == width for v in rows])
            batch = batch.filter(pa.array(fits))
            if not batch.num_rows:
                continue
            flat = np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(-1, width)
            orders = permutations(flat, index.pivots, index.prefix)
            yield pa.record_batch(
                [
                    batch.column("vec_id"),
                    pa.array([v.tobytes() for v in flat], pa.binary()),
                    pa.array([o.tobytes() for o in orders], pa.binary()),
                ],
                ["vec_id", "vector", "pivots"],
            )

    return run


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(b"".join(frame["vector"]), dtype=np.float64).reshape(len(frame), -1)
    orders = np.frombuffer(b"".join(frame["pivots"]), dtype=np.int16).reshape(len(frame), -1)
    return frame["vec_id"].to_numpy(), vectors, orders


def _searched(index: Index, k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        asked = _unpacked(queries)
        place, found, score = search_block(index, *_unpacked(rows), *asked, k)
        return pd.DataFrame({"query_id": asked[0][place.astype(int)], "vec_id": found.astype("int64"), "score": score})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, index: Index | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows found with the largest inner product, for every query row.

    ``vectors`` has ``vec_id`` and ``embedding``. Every row is indexed: it is represented by the order of its 32
    nearest of 256 pivots and posted in those pivots' inverted files. Rows are dealt over blocks of about 8,192 by
    a hash of their id and queries over blocks of about 1,024, so equal or clustered vectors spread evenly. A block
    of queries meets each block of rows: the posting lists of a query's pivots give the footrule distance of every
    row, the nearest share of them is ranked again by the exact inner product in double precision, and only the best
    ``k`` leave the block. The work is thus queries times rows, in blocks, with the costly part cut to the share
    that ``fit`` measured to be enough for the recall.

    Vectors that are null, of another length than the sample's most frequent one, zero, or with a null or non-finite
    component take no part; nor do rows without ``vec_id``. Ties go to the smaller ``vec_id``. A row is never its own
    neighbour; repeated rows of one ``vec_id`` count once. Other columns are not read. An empty table gives an empty
    result; fewer than ``k`` candidates give all of them.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    with Scratch(spark, "permutation") as work:
        rows = usable(vectors).dropDuplicates(["vec_id"])
        rows = work.keep(rows)
        index = index or fit(rows, k)
        if index is None:
            return spark.createDataFrame([], result)
        table = work.keep(rows.mapInArrow(_ordered(index), "vec_id long, vector binary, pivots binary"))
        asked = table.filter(is_query)
        n_rows, n_queries = (-(-table.count() // BLOCK_ROWS), -(-asked.count() // BLOCK_QUERIES))
        deal = F.xxhash64("vec_id")
        row_block, query_block = F.pmod(deal, F.lit(max(1, n_rows))), F.pmod(deal, F.lit(max(1, n_queries)))

        def every(count: int) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, count) - 1).cast("long")))

        left = asked.select("vec_id", "vector", "pivots", query_block.alias("q"), every(n_rows).alias("r"))
        right = table.select("vec_id", "vector", "pivots", row_block.alias("r"), every(n_queries).alias("q"))
        found = (
            left.groupBy("q", "r")
            .cogroup(right.groupBy("q", "r"))
            .applyInPandas(_searched(index, k), "query_id long, vec_id long, score double")
        )
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return stored(ranked.select("query_id", "rank", "vec_id", "score"), "permutation")
