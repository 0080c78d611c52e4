"""Near-duplicate documents by b-bit MinHash: bands, bit-count estimates, confirmation on whole sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.llm.components import components
from lakekit.llm.hashing import byte_rows, lower_ascii, mix, shingles
from lakekit.llm.scratch import Scratch
from lakekit.session import stored
from lakekit.sources.tables import spread

BANDS = 32
ROWS = 4
BITS = 4
PAIRED_MEMBERS = 16
SLOTS = 1024
_MINIMA = BANDS * ROWS
_PER_LONG = 64 // BITS
_SEEDS = mix(np.arange(1, _MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)
_BLOCK = 2048

_SIGNED = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, signature array<long>"


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest of each of the hash functions over a set, in blocks so that memory does not follow the set."""
    least = np.full(_MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), _BLOCK):
        block = (values[at : at + _BLOCK, None] ^ _SEEDS) * _ODD
        np.minimum(least, block.min(axis=0), out=least)
    return mix(least)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, several to a 64-bit value."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, _PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One value per band, made of its minima and its number."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, bands, signature = [], [], [], []
            for data in byte_rows(batch.column("text")):
                values = shingles(lower_ascii(data), words)
                size.append(len(values))
                if len(values):
                    digest.append(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64))
                    least = minima(values)
                    bands.append(band_keys(least).view(np.int64))
                    signature.append(packed(least).view(np.int64))
                else:
                    digest.append((None, None))
                    bands.append(None)
                    signature.append(None)
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_key"),
                    pa.array(size, pa.int64()),
                    pa.array([d[0] for d in digest], pa.int64()),
                    pa.array([d[1] for d in digest], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signature, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "signature"],
            )

    return run


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Each row's set size, a 128-bit digest of its set, its band keys and its packed signature."""
    return spread(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))).mapInArrow(_sign(words), _SIGNED)


def estimate(one: Column, other: Column) -> Column:
    """Similarity by counting equal b-bit fields of two packed signatures, corrected for chance agreement."""
    ones = sum(1 << (BITS * k) for k in range(_PER_LONG))
    differing = F.lit(0)
    for place in range(_MINIMA // _PER_LONG):
        unlike = one[place].bitwiseXOR(other[place])
        folded = unlike
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(unlike, shift))
        differing = differing + F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))
    chance = 2.0**-BITS
    return ((1 - differing / F.lit(float(_MINIMA))) - chance) / (1 - chance)


def _margin(similarity: float) -> float:
    """Six standard deviations of the estimate at the threshold: what is dropped below could not be a link."""
    chance = 2.0**-BITS
    agree = similarity + (1 - similarity) * chance
    return 6 * sqrt(agree * (1 - agree) / _MINIMA) / (1 - chance)


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            last, first = None, None
            for one, other in zip(byte_rows(batch.column("text_a")), byte_rows(batch.column("text_b"))):
                if last is None or len(one) != len(last) or not np.array_equal(one, last):
                    last, first = one, shingles(lower_ascii(one), words)
                second = shingles(lower_ascii(other), words)
                common = len(np.intersect1d(first, second, assume_unique=True))
                good.append(100 * common >= percent * (len(first) + len(second) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return run


def against_hub(hub: np.ndarray, values: np.ndarray, percent: int) -> tuple[bool, np.ndarray, int, int]:
    """A set as its difference from a hub's: linked or not, the differing values, its share of a need and its lack.

    With ``R`` removed from the hub ``h`` and ``A`` added, two sets share ``|h| - |Rx| - |Ry|`` values and those that
    are in both ``R`` or both ``A``. So a link of x and y takes ``lack(y) + need(x)`` differing values in common, where
    ``need`` is ``(100 |R| + percent |A|) / (100 + percent)`` and ``lack`` is what y is short of a link with the hub,
    more than 0 if it is not linked. Two sets that have ``k`` values in common have one among all but the last
    ``k - 1`` of either, in any one order.
    """
    added = np.setdiff1d(values, hub, assume_unique=True)
    removed = np.setdiff1d(hub, values, assume_unique=True)
    both = 100 + percent
    lack = percent * (len(hub) + len(values)) - both * (len(hub) - len(removed))
    unlike = np.concatenate([added, mix(removed ^ np.uint64(0xD6E8FEB86659FD93))])
    return lack <= 0, unlike, (100 * len(removed) + percent * len(added)) // both, -(-lack // both)


_RELATIVE = "a long, b long, linked boolean, unlike array<long>, need int, lack int"


def _relative(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, first, rows = None, None, []
            for one, other in zip(byte_rows(batch.column("text_a")), byte_rows(batch.column("text_b"))):
                if last is None or len(one) != len(last) or not np.array_equal(one, last):
                    last, first = one, shingles(lower_ascii(one), words)
                rows.append(against_hub(first, shingles(lower_ascii(other), words), percent))
            linked, unlike, need, lack = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch(
                [
                    batch.column("a"),
                    batch.column("b"),
                    pa.array(linked, pa.bool_()),
                    pa.array([values.view(np.int64) for values in unlike], pa.list_(pa.int64())),
                    pa.array(need, pa.int32()),
                    pa.array(lack, pa.int32()),
                ],
                ["a", "b", "linked", "unlike", "need", "lack"],
            )

    return run


_RANKED = f"{_RELATIVE}, c long"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for unlike, often in zip(batch.column("unlike"), batch.column("often")):
            values = unlike.values.to_numpy()
            held = np.zeros(SLOTS, dtype=np.int64)
            held[often.values.field("slot").to_numpy()] = often.values.field("held").to_numpy()
            rows.append(values[np.lexsort((values, held[values % SLOTS]))])
        place = batch.schema.get_field_index("unlike")
        yield batch.set_column(place, "unlike", pa.array(rows, pa.list_(pa.int64()))).drop_columns(["often"])


_OFTEN = "a long, often array<struct<slot:int,held:long>>"
_OFTEN_ARROW = pa.schema([("a", pa.int64()), ("often", pa.list_(pa.struct([("slot", pa.int32()), ("held", pa.int64())])))])
_HUBS = 1_024


def _often(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = []
    for held in counts.values():
        slots = np.flatnonzero(held)
        rows.append([{"slot": slot, "held": n} for slot, n in zip(slots.tolist(), held[slots].tolist())])
    return pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(rows, _OFTEN_ARROW.field("often").type)], _OFTEN_ARROW)


def _slots_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each slot is held by a hub's rows in this task: at most ``SLOTS`` counts for each of its hubs."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for hub, unlike in zip(batch.column("a").to_pylist(), batch.column("unlike")):
            if hub not in counts:
                if len(counts) == _HUBS:
                    yield _often(counts)
                    counts = {}
                counts[hub] = np.zeros(SLOTS, dtype=np.int64)
            counts[hub] += np.bincount(unlike.values.to_numpy() % SLOTS, minlength=SLOTS)
    if counts:
        yield _often(counts)


def _held_by_all(key: tuple, rows: pa.Table) -> pa.Table:
    held = np.zeros(SLOTS, dtype=np.int64)
    for often in rows["often"]:
        held[often.values.field("slot").to_numpy()] += often.values.field("held").to_numpy()
    return pa.Table.from_batches([_often({key[0].as_py(): held})])


def _rare_first(relative: DataFrame, work: Scratch) -> DataFrame:
    """Each row's differing values in one order per hub, those that few of the hub's rows hold first.

    How often is counted per slot of values, a fixed number of slots per hub. Any order gives the same links; this
    one makes few candidates, because what most rows lack of the hub comes last. Each task counts for itself, so values
    are not shuffled. The counts are written, so that the join on a hub of many rows meets no aggregation and Spark can split it.
    """
    partial = relative.select("a", "unlike").mapInArrow(_slots_held, _OFTEN)
    often = work.keep(partial.groupBy("a").applyInArrow(_held_by_all, _OFTEN))
    return relative.join(often, "a").select("a", "b", "linked", "unlike", "need", "lack", "c", "often").mapInArrow(_ranked, _RANKED)


def _sharing(ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that differ from a hub alike often enough to be linked, y not linked to it.

    What two rows must have in common is the same whichever is y, so y is the one that lacks more, by id if both lack
    the same. Then x has to share what it needs and lacks itself, at least. And x has values to share only if what it
    does not need covers the lack of y, so its need is ``percent`` hundredths of that lack or more.
    """
    size = F.size("unlike")
    least_need = F.floor((F.col("lack") - 1) * percent / 100).cast("int")
    ask = ranked.filter("not linked").select(
        "a", F.col("b").alias("y"), F.col("c").alias("cy"), "lack", (size - F.col("lack")).alias("upto_y"),
        F.posexplode(
            F.slice("unlike", F.lit(1), F.greatest(size - F.col("lack") - least_need + 1, F.lit(0)))
        ).alias("at_y", "value"),
    )
    have = ranked.select(
        "a", F.col("b").alias("x"), F.col("c").alias("cx"), "need", "lack", (size - F.col("need")).alias("upto_x"),
        F.posexplode(
            F.slice("unlike", F.lit(1), F.greatest(size - F.col("need") - F.greatest("lack", F.lit(1)) + 1, F.lit(0)))
        ).alias("at_x", "value"),
    )
    ask, have = ask.alias("p"), have.alias("q")
    same = (F.col("p.a") == F.col("q.a")) & (F.col("p.value") == F.col("q.value")) & (F.col("cx") != F.col("cy"))
    early = (F.col("at_x") <= F.col("upto_x") - F.col("p.lack")) & (F.col("at_y") <= F.col("upto_y") - F.col("need"))
    less = (F.col("q.lack") < F.col("p.lack")) | ((F.col("q.lack") == F.col("p.lack")) & (F.col("x") < F.col("y")))
    pairs = ask.join(have, same & early & less)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b")


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs that the estimate does not rule out and whose whole sets are similar enough."""
    sides = [nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"]
    likely = pairs.join(sides[0], "a").join(sides[1], "b").filter(_possible("n_a", "n_b", "sig_a", "sig_b", percent))
    both = _with_texts(likely.select("a", "b"), texts)
    return both.mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def _possible(n_a: str, n_b: str, sig_a: str, sig_b: str, percent: int) -> Column:
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & (estimate(F.col(sig_a), F.col(sig_b)) >= percent / 100 - _margin(percent / 100))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of distinct shingles of
    ``words`` words, ASCII letters in lower case. The steps:

    1. Rows with the same set are one node; only nodes go on. Rows of one ``doc_id`` with different sets are different
       nodes, each with its own links, and join in the end.
    2. A node is posted under 32 band keys of 4 minima each. At a similarity of 0.85 the odds that a pair shares
       no band are 6e-11, at 0.8 they are 5e-8.
    3. Each node is compared with the one smallest node it shares most bands with. Most groups are joined by that.
    4. In buckets that still hold several components, pairs across components are candidates; pairs inside one are
       never made. A bucket of more than 16 nodes does not pair its members. They are compared with its hub, the one
       with most links so far, and those not linked to it look up others by the values in which both differ from the
       hub in the same way, of which a link takes a known number (``against_hub``), rare ones first. Nothing is lost.
    5. Candidates pass the bit-count estimate, six standard deviations wide, then the test on whole sets.

    No step has a cap on partners. Hot keys are counted before they are shuffled, joins on them are left to
    Spark's splitting of skewed partitions.

    Null or empty text, or only white space: an empty set, linked with nothing, ``component_id = doc_id``. A null
    ``doc_id``: linked with nothing, ``component_id`` null, kept. Rows with the same ``doc_id`` count as one
    document, linked by any of their texts, and stay or go together. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark, "minhash") as work:
        rows = work.keep(signatures(docs, words))
        filled = rows.filter("doc_id is not null and n_shingles > 0")
        sets = ["set_a", "set_b"]
        classes = filled.groupBy(*sets).agg(F.min("doc_id").alias("head"))
        # Numbered by doc_id: what came first is more often the original, which makes the better hub of its copies.
        classes = classes.orderBy("head", *sets).withColumn("node", F.monotonically_increasing_id())
        classes = work.keep(classes)
        placed = rows.drop("bands", "signature", "text_key").join(classes, sets, "left").drop(*sets)
        placed = work.keep(placed)
        nodes = work.keep(
            filled.withColumnRenamed("doc_id", "head")
            .join(classes, ["head", *sets])
            .select("node", "head", "text_key", F.col("n_shingles").alias("n"), F.col("signature").alias("sig"), "bands")
            .dropDuplicates(["node"])
        )
        posted = nodes.select("node", F.explode("bands").alias("key"))
        shared = posted.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).filter("m > 1").drop("m")
        members = work.keep(posted.join(shared, "key"))
        involved = nodes.select("node", "head", "text_key").join(members.select("node").distinct(), "node", "left_semi")
        texts = docs.select(F.col("doc_id").cast("long").alias("head"), F.xxhash64("text").alias("text_key"), "text")
        texts = work.keep(texts.join(involved, ["head", "text_key"]).select("node", "text").dropDuplicates(["node"]))

        chosen = F.max_by("hub", F.struct(F.col("bands_shared"), -F.col("hub")))
        stars = (
            members.filter("node != hub")
            .groupBy("node", "hub")
            .agg(F.count("*").alias("bands_shared"))
            .groupBy("node")
            .agg(chosen.alias("a"))
            .select("a", F.col("node").alias("b"))
        )
        stars = work.keep(stars)
        links = work.keep(_confirmed(stars, nodes, texts, words, percent))
        joined = components(links, work)

        labelled = members.drop("hub").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
        degree = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"))
        labelled = work.keep(labelled.join(degree, "node", "left").select("key", "node", "c", F.coalesce("d", F.lit(0)).alias("d")))
        buckets = labelled.groupBy("key").agg(
            F.count("*").alias("m"),
            F.min("c").alias("low"),
            F.max("c").alias("high"),
            F.max_by("node", F.struct(F.col("d"), -F.col("node"))).alias("hub"),
        )
        buckets = buckets.filter("low != high").drop("low", "high")
        open_rows = work.keep(labelled.drop("d").join(buckets, "key"))

        small = open_rows.filter(F.col("m") <= PAIRED_MEMBERS).join(nodes.drop("bands"), "node")
        one, other = small.alias("x"), small.alias("y")
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.node") < F.col("y.node"))
        pairs = one.join(other, apart & _possible("x.n", "y.n", "x.sig", "y.sig", percent))
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

        large = open_rows.filter(F.col("m") > PAIRED_MEMBERS).filter("node != hub")
        large = large.select(F.col("hub").alias("a"), F.col("node").alias("b"), "c").distinct()
        large = work.keep(large)
        relative = _with_texts(large.select("a", "b"), texts).mapInArrow(_relative(words, percent), _RELATIVE)
        relative = work.keep(relative.join(large, ["a", "b"]))
        sharing = _sharing(work.keep(_rare_first(relative, work)), percent)
        by_hub = relative.filter("linked").select("a", "b")

        pairs = work.keep(pairs.union(sharing).distinct().join(stars, ["a", "b"], "left_anti"))
        more = work.keep(_confirmed(pairs, nodes, texts, words, percent).union(by_hub))
        names = nodes.select("node", "head")
        found = links.union(more)
        for side in "ab":
            found = found.join(names.withColumnsRenamed({"node": side, "head": f"head_{side}"}), side)
        # rows of one doc_id are one document, whichever sets they have
        several = placed.filter("head is not null").groupBy("doc_id").agg(F.min("head").alias("low"), F.max("head").alias("high"))
        same = placed.join(several.filter("low != high").select("doc_id"), "doc_id").filter("head is not null")
        joins = found.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
        joins = joins.union(same.select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct())
        final = components(joins, work).withColumnRenamed("node", "head")
        found = placed.join(final, "head", "left").select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "head", "doc_id").alias("component_id"),
        )
        return stored(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "minhash")
