"""Best-fit packing of pieces into sequences, each partition's count certified by a lower bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch
from lakekit.llm.tokens import PIECES, pieces
from lakekit.session import stored
from lakekit.sources.tables import spread

PART_PIECES = 50_000
ROUNDS = 3

_PACKED = f"{PIECES}, part long, bin long, offset long, fill long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place within it for each length: longest first, each to the fullest bin that has room.

    Bins are kept by the room they have left and the rooms in use as bits of one number, so a step costs the
    same however many bins are open.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for place, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            box = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, box = capacity, opened
            opened += 1
        bins[place], offsets[place] = box, capacity - room
        left = room - length
        if left:
            by_room[left].append(box)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that a family of dual feasible functions proves necessary.

    Two kinds: those that round lengths above ``capacity - t`` up to a whole bin and those below ``t`` down to
    nothing, for every ``t`` up to half a bin; and those that round to multiples of a ``k``-th of a bin.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sums = np.cumsum(counts * np.arange(capacity + 1))
    numbers = np.cumsum(counts)
    t = np.arange(1, capacity // 2 + 1)
    whole = numbers[-1] - numbers[capacity - t]
    between = sums[capacity - t] - sums[t - 1]
    best = max(-(-int(sums[-1]) // capacity), int((whole + -(-between // capacity)).max(initial=0)))
    sizes = np.arange(capacity + 1)
    for k in range(1, 20):
        parts, rest = np.divmod((k + 1) * sizes, capacity)
        value = np.where(rest == 0, sizes * k, parts * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return group.assign(bin=bins, offset=offsets, fill=fill[bins])

    return run


def _gaps(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = np.repeat(group["length"].to_numpy(), group["n"].to_numpy())
        bound = lower_bound(lengths, capacity)
        return pd.DataFrame({"part": group["part"].iloc[:1], "bound": [bound]})

    return run


def certify(packed: DataFrame, capacity: int) -> DataFrame:
    """``part, bins, bound, gap`` of each partition; the bound needs only how often each length occurs."""
    lengths = packed.groupBy("part", "length").agg(F.count("*").alias("n"))
    bounds = lengths.groupBy("part").applyInPandas(_gaps(capacity), "part long, bound long")
    bins = packed.filter("offset = 0").groupBy("part").agg(F.count("*").alias("bins"))
    return bins.join(bounds, "part").withColumn("gap", F.col("bins") - F.col("bound"))


def pack(rows: DataFrame, capacity: int, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``. ``rows``: ``doc_id, piece, start, length, ids_crc32``.

    Pieces of full length are sequences of their own. The others are dealt over partitions of about
    ``part_pieces`` by a hash of the piece, so that none grows with the input or with one document, and each is
    packed best-fit decreasing. A partition whose bins are as few as the bound proves necessary is done. The
    others, while they are several, exchange what lies in their emptier half of bins, dealt anew between them, and
    are packed again, ``rounds`` times at most or until no gap is left. Only gaps, a row per open partition, are
    summed; no piece is ever dropped.
    """
    with Scratch(rows.sparkSession, "packing") as work:
        rows = work.keep(rows)
        short = rows.filter(F.col("length") < capacity)
        parts = -(-short.count() // part_pieces) or 1
        deal = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
        empty = {name: F.lit(0).cast("long") for name in ("bin", "offset", "fill")}
        todo = short.withColumn("part", F.pmod(deal, F.lit(parts))).withColumns(empty)
        done = None
        for turn in range(rounds + 1):
            packed = work.keep(todo.groupBy("part").applyInPandas(_pack(capacity), _PACKED))
            gaps = certify(packed, capacity).filter("gap > 0").select("part")
            gaps = work.keep(gaps)
            open_parts = gaps.count()
            if turn == rounds or open_parts < 2:
                done = packed if done is None else done.unionByName(packed)
                break
            loose = packed.join(gaps, "part", "left_semi")
            middle = loose.groupBy("part").agg(F.expr("percentile_approx(fill, 0.5, 100)").alias("middle"))
            marked = packed.join(middle, "part", "left").withColumn("stays", F.coalesce(F.col("fill") > F.col("middle"), F.lit(True)))
            marked = work.keep(marked.drop("middle"))
            settled = marked.filter("stays").drop("stays")
            done = settled if done is None else done.unionByName(settled)
            first = (turn + 1) * (1 << 24)
            again = F.pmod(F.xxhash64(deal, F.lit(turn)), F.lit(max(1, open_parts // 2))) + first
            todo = marked.filter("not stays").drop("stays").withColumn("part", again)
        full = rows.filter(F.col("length") >= capacity).withColumns(
            {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
        )
        shared = done.withColumn("sequence_id", F.col("part") * (1 << 24) + F.col("bin"))
        wanted = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        return stored(shared.select(*wanted).unionByName(full.select(*wanted)), "packing")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Sequences of at most ``capacity`` ids from every text of ``docs`` (``doc_id``, ``text``).

    A document is its ids and an end id; only one longer than a sequence is cut, into full pieces and a rest.
    A null or empty text is its end id alone. Rows are packed as they are: repeated rows and a null ``doc_id``
    give pieces like any other. Other columns are not read. An empty table gives an empty result.
    """
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return pack(texts.mapInArrow(pieces(tokenizer, end_id, capacity), PIECES), capacity)
