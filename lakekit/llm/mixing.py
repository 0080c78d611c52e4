"""Mixing sources by temperature: exponents found by bisection, weights realised as block permutations."""

from __future__ import annotations

import warnings
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekit.llm.quality import words_of
from lakekit.llm.scratch import Scratch
from lakekit.operators.matching import fits_broadcast
from lakekit.session import stored

BLOCK_TOKENS = 1_000_000
STEPS = 24
MAX_EXPONENT = 64.0


def tokens(text: Column) -> Column:
    """White-space words: a count that needs no tokenizer, and so no Python."""
    return F.size(words_of(text)).cast("long")


def entropy(sources: DataFrame, exponent: float) -> float:
    """Of the weights ``tokens ** exponent``, in nats. Only two sums reach the driver."""
    share = F.log(F.col("tokens") / F.col("all_tokens"))
    weight = F.exp(F.lit(exponent) * share)
    row = sources.agg(F.sum(weight).alias("z"), F.sum(weight * share).alias("s")).first()
    return log(row.z) - exponent * row.s / row.z


def repetition(sources: DataFrame, exponent: float) -> float:
    """How often the most repeated source is passed over when the least repeated one is passed over once."""
    ratio = F.log(F.col("tokens") / F.col("all_tokens"))
    row = sources.agg(F.max((exponent - 1) * ratio).alias("most"), F.min((exponent - 1) * ratio).alias("least")).first()
    return float(2.718281828459045 ** (row.most - row.least))


def bisect(fine, steps: int = STEPS) -> float | None:
    """The least exponent from which on ``fine`` holds, to within ``2 ** -steps`` of the range it lies in.

    Exponents over 1 favour large sources more than their own size does. Null if none up to ``MAX_EXPONENT`` will do,
    beyond which weights hardly change.
    """
    if fine(0.0):
        return 0.0
    low, high = 0.0, 1.0
    while not fine(high):
        if high >= MAX_EXPONENT:
            return None
        low, high = high, 2 * high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fine(middle) else (middle, high)
    return high


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent that meets the target entropy, a share of the greatest one there can be, from above, as far as it
    keeps to the repetition limit; with a limit alone the least that keeps to it. Without either, 1: the sources as they are.

    A target below what the sources have by nature takes an exponent over 1. Where several sources are equally
    large it may be out of reach: then the sources stay as they are, with a warning.
    """
    exponent = 0.0 if target_entropy is not None or max_repeats is not None else 1.0
    if target_entropy is not None:
        goal = target_entropy * log(max(1, sources.count()))
        if entropy(sources, 0.0) > goal:
            exponent = bisect(lambda a: entropy(sources, a) <= goal + 1e-12)
        if exponent is None:
            warnings.warn(f"no exponent up to {MAX_EXPONENT:g} brings the entropy down to {goal:.4f}; sources stay as they are")
            exponent = 1.0
    if max_repeats is not None and repetition(sources, exponent) > max_repeats:
        if exponent > 1:
            exponent -= bisect(lambda less: repetition(sources, max(1.0, exponent - less)) <= max_repeats)
        else:
            exponent = bisect(lambda a: repetition(sources, a) <= max_repeats)
    return exponent


def _deal(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def plan(
    docs: DataFrame,
    work: Scratch,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """A row per source: ``tokens, weight, budget, passes`` (whole ones), and where the last, partial pass ends.

    ``docs`` needs ``doc_id``, ``source`` and ``text``. A source is cut into blocks of about ``block_tokens`` by a
    hash of the document. A pass takes blocks in the order of a hash of the pass, so it is a permutation of blocks
    that needs no sort; the partial pass ends in one block, and in it at one document in the order of its hash.
    """
    light = work.keep(
        docs.select("source", tokens(F.col("text")).alias("n"), _deal(seed, "doc_id", "text").alias("place"))
    )
    sizes = light.groupBy("source").agg(F.sum("n").alias("tokens"))
    total = sizes.agg(F.sum("tokens").alias("n")).first().n or 0
    sources = work.keep(sizes.filter("tokens > 0").withColumn("all_tokens", F.lit(total)))
    if not total:
        exponent, norm, reach = 1.0, 1.0, 0.0
    else:
        exponent = find_exponent(sources, target_entropy, max_repeats)
        raw = F.exp(exponent * F.log(F.col("tokens") / F.col("all_tokens")))
        sums = sources.agg(F.sum(raw).alias("z"), F.max(F.col("tokens") / raw).alias("most")).first()
        norm = sums.z
        reach = float(budget) if budget is not None else sums.most * norm
    share = F.exp(exponent * F.log(F.col("tokens") / F.col("all_tokens"))) / norm
    planned = (
        sources.withColumn("weight", share)
        .withColumn("budget", F.round(F.col("weight") * reach).cast("long"))
        .withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long"))
    )
    planned = work.keep(planned.drop("all_tokens"))
    placed = _placed(light, planned, seed)
    blocks = placed.groupBy("source", "rest", "turn").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        blocks.withColumn("upto", F.sum("n").over(run))
        .filter("upto > rest")
        .groupBy("source")
        .agg(F.min("turn").alias("end_turn"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "turn").alias("left"))
    )
    ends = work.keep(ends)
    inside = placed.join(ends, placed.source.eqNullSafe(ends.source) & (placed.turn == ends.end_turn))
    inside = inside.select(placed.source, "place", "n", "left")
    within = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        inside.withColumn("upto", F.sum("n").over(within)).filter("upto <= left").groupBy("source").agg(F.max("place").alias("end_place"))
    )
    found = planned.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    found = found.join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    return work.keep(
        found.select("p.*", "e.end_turn", "l.end_place", F.lit(exponent).alias("exponent"))
    )


def _placed(light: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    small = F.broadcast(planned) if fits_broadcast(planned) else planned
    rows = light.alias("d").join(small.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("d.source", "d.n", "d.place", "p.rest", "p.passes", "p.blocks")
    rows = rows.withColumn("block", F.pmod("place", "blocks"))
    return rows.withColumn("turn", _deal(seed + 1, "source", "passes", "block"))


def mixed(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """Every row of ``docs``, all its columns, as often as the mixture wants it.

    Weights are the sources' shares of tokens to the power of an exponent, found by bisection for a target entropy
    (0..1 of an even mixture's) or a limit on repeats. Without a ``budget`` in tokens, the mixture is the smallest
    that passes over every source at least once, so it drops nothing; with one, sources whose weight asks for less
    than they have are cut where their permutation reaches their budget, which is what the operator is for.

    Documents meet the plan of their source, a row each, inside a scan; texts are not shuffled, and one source may
    hold any share of the rows. A null source is a source. Documents without words cost nothing and go with their
    block; a source of only such documents is passed over once. Ties in the order stay or go together. An empty table
    gives an empty result. Extra columns may have any name.
    """
    with Scratch(docs.sparkSession, "mixing") as work:
        planned = stored(plan(docs, work, target_entropy, max_repeats, budget, block_tokens, seed), "mixing-plan")
    return apply_plan(docs, planned, seed)


def apply_plan(docs: DataFrame, planned: DataFrame, seed: int = 0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``docs`` repeated by a plan; ``extra`` adds columns of the plan ``p`` and of ``pass``."""
    small = F.broadcast(planned) if fits_broadcast(planned) else planned
    kept = [F.col(f"d.`{c}`") for c in docs.columns]
    rows = docs.alias("d").join(small.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left")
    place = F.xxhash64(F.lit(seed), F.col("d.doc_id"), F.col("d.text"))
    block = F.pmod(place, F.col("p.blocks"))
    turn = F.xxhash64(F.lit(seed + 1), F.col("d.source"), F.col("p.passes"), block)
    before = (turn < F.col("p.end_turn")) | F.col("p.end_turn").isNull()
    inside = (turn == F.col("p.end_turn")) & F.coalesce(place <= F.col("p.end_place"), F.lit(False))
    more = F.when((F.col("p.rest") > 0) & (before | inside), 1).otherwise(0)
    times = F.coalesce(F.col("p.passes") + more, F.lit(1))
    number = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    named = [value.alias(name) for name, value in (extra or {}).items()]
    if extra is not None:
        return rows.select(*kept, *named, number.alias("pass"))
    many = F.when(times > 0, F.array_repeat(F.struct(*kept), times)).otherwise(F.array_repeat(F.struct(*kept), F.lit(0)))
    return rows.select(F.inline(many))


def mixture(docs: DataFrame, seed: int = 0, **wanted) -> DataFrame:
    """``doc_id, source, pass, block, turn``: which document is taken in which pass, and its block's place in it."""
    with Scratch(docs.sparkSession, "mixing") as work:
        planned = stored(plan(docs, work, seed=seed, **wanted), "mixing-plan")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("d.doc_id"), F.col("d.text")), F.col("p.blocks"))
    taken = apply_plan(docs.select("doc_id", "source", "text"), planned, seed, {"block": block, "weight": F.col("p.weight")})
    turn = F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("pass") - 1, F.col("block"))
    return taken.select("doc_id", "source", "pass", "block", turn.alias("turn"), "weight")
