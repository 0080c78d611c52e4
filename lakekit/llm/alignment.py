"""Where the tokens of two tokenizers overlap, and how common each pair of ids is in the corpus."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.hashing import mix
from lakekit.llm.scratch import Scratch
from lakekit.session import stored

BLOCK_BYTES = 1 << 24
STEP_BYTES = 1 << 20
ROW_BYTES = 64
SHARDS = 64
FAN_IN = 32

# Texts of these characters only, whose classes all versions of Unicode agree on, and without very long runs, may take
# the quicker of the two libraries that know the byte-level vocabulary.
_DISPUTED = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧€]")
_LONG_RUN = 400


def _byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {chr(b): b for b in plain}
    shown.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return shown


@dataclass(frozen=True)
class Sizes:
    """How many bytes each id of both vocabularies stands for. Alignment needs no more, so tasks need no tokenizer."""

    a: np.ndarray
    b: np.ndarray

    @property
    def ids(self) -> np.dtype:
        """The type that ids are packed in."""
        return np.dtype("<u2" if max(len(self.a), len(self.b)) <= 1 << 16 else "<u4")

    @cached_property
    def names(self) -> list[str]:
        """Each id as text with each mark that may follow it: within a side, between sides, after a group, at the end."""
        return [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(max(len(self.a), len(self.b)))]


class Vocabularies:
    """Both tokenizers of a worker with the bytes of each id.

    ``byte_file`` is a byte-level vocabulary of the tokenizers library (A), ``piece_file`` a model of sentencepiece (B).
    ``rank_file`` may name the ranks of the same vocabulary as A and ``pattern`` its split pattern; they are used where
    they give the same ids sooner.
    """

    def __init__(self, byte_file: str, piece_file: str, rank_file: str | None = None, pattern: str | None = None):
        import sentencepiece

        self.byte_file = byte_file
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        with open(byte_file, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"] | {token["content"]: token["id"] for token in content["added_tokens"]}
        shown = _byte_characters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in shown for c in token)
            self.a_bytes[i] = bytes(shown[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
        self.b_bytes = [
            bytes([int(byte[1], 16)]) if (byte := as_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.sizes = Sizes(*(np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)))
        self.quick = None
        if rank_file and pattern:
            import tiktoken

            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            if all(self.a_bytes[rank] == token for token, rank in ranks.items()):
                self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.byte_file)
        made.encode_special_tokens = True
        made.no_padding()
        made.no_truncation()
        return made

    def encode_a(self, text: str) -> list[int]:
        if self.quick and (text.isascii() or not _DISPUTED.search(text)):
            words = text.split()
            longest, letters = max(map(len, words), default=0), sum(map(len, words))
            if longest <= _LONG_RUN and len(text) - letters <= 2 * len(words) + _LONG_RUN:
                return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text by A and of the text by B; none if their bytes are not those."""
        none, kind = np.empty(0, self.sizes.ids), self.sizes.ids
        if not text:
            return none, none
        a, b = self.encode_a(" " + text), self.b.encode(text)
        data = b" " + text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
        return (np.array(a, kind), np.array(b, kind)) if same else (none, none)


_vocabularies: dict[tuple, Vocabularies] = {}


def _vocabularies_of(files: tuple) -> Vocabularies:
    if files not in _vocabularies:
        _vocabularies[files] = Vocabularies(*files)
    return _vocabularies[files]


class Aligned:
    """Documents aligned side by side: each stretch between neighbouring token ends is one link of an A and a B token."""

    def __init__(self, sizes: Sizes, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.sizes, self.n_a, self.n_b = sizes, n_a, n_b
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        a_ends, b_ends = np.cumsum(sizes.a[self.a]), np.cumsum(sizes.b[self.b])
        size = int(a_ends[-1]) + 1 if len(a_ends) else 1
        ends_a, ends_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        ends_a[a_ends], ends_b[b_ends] = True, True
        cuts = np.flatnonzero(ends_a | ends_b)
        at_a = (np.cumsum(ends_a) - ends_a)[cuts]
        at_b = (np.cumsum(ends_b) - ends_b)[cuts]
        self.pairs = self.a[at_a] * len(sizes.b) + self.b[at_b]
        both = ends_a & ends_b
        before = np.cumsum(both) - both
        self.a_group, self.b_group = before[a_ends], before[b_ends]
        doc_ends = np.concatenate(([0], a_ends))[np.cumsum(n_a)]
        self.link_ends = np.searchsorted(cuts, doc_ends, side="right")
        self.doc_groups = np.diff(np.searchsorted(np.flatnonzero(both), doc_ends, side="right"), prepend=0)

    def doc_of_link(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.link_ends)), np.diff(self.link_ends, prepend=0))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs and how many of these documents hold each."""
        bits = (len(self.sizes.a) * len(self.sizes.b)).bit_length()
        in_doc = np.unique(self.doc_of_link() << bits | self.pairs)
        return np.unique(in_doc & ((1 << bits) - 1), return_counts=True)

    def groups(self) -> list[str]:
        """For each document its groups as ``a1,a2|b1;a3|b2,b3``."""
        ids = np.concatenate((self.a, self.b))
        key = np.concatenate((2 * self.a_group, 2 * self.b_group + 1))
        order = np.argsort(key, kind="stable")
        ids, key = ids[order], key[order]
        mark = np.full(len(ids), 3)
        mark[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
        ends = np.cumsum(self.n_a + self.n_b)
        mark[ends[ends > 0] - 1] = 3
        codes = mark * (len(self.sizes.names) // 4) + ids
        name, begins = self.sizes.names.__getitem__, [0, *ends.tolist()]
        return ["".join(map(name, codes[x:y].tolist())) for x, y in zip(begins, begins[1:])]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, a key's bit at the first level it has to itself.

    A key's index is the number of bits set before its own, so ``n`` keys fill 0 to n - 1. Keys that were not given may
    get any index or none; whoever asks compares the key kept at that index.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.concatenate(([0], np.cumsum([int(bits.sum()) for bits in levels], dtype=np.int64)))
        self.ranks = [np.cumsum(bits) - bits for bits in levels]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = mix(keys.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        return (salted % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(64, 2 * len(keys))
            place = cls._place(keys, len(levels), size)
            bits = np.bincount(place, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[place]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        found, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = self._place(keys[open_], level, len(bits))
            hit = bits[place]
            found[open_[hit]] = self.before[level] + self.ranks[level][place[hit]]
            open_ = open_[~hit]
        return found

    def packed(self) -> list[bytes]:
        return [len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes() for bits in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls(
            [
                np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool)
                for x in levels
            ]
        )


_ENCODED = "kind int, block long, shard int, doc_ids array<long>, n_a array<int>, n_b array<int>, a binary, b binary"
_ENCODED_ARROW = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64()))]
    + [("n_a", pa.list_(pa.int32())), ("n_b", pa.list_(pa.int32())), ("a", pa.binary()), ("b", pa.binary())]
)
_TEXTS, _PAIRS = 0, 1


def _shard_of(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % SHARDS


def _packed(ids: np.ndarray) -> bytes:
    """Ids by bytes, all first ones and then all second ones, which compress better, by zstandard."""
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, ids.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


class _Block:
    """About 16 MB of ids: rows of documents of about 1 MB each, and the block's distinct pairs with their documents."""

    def __init__(self, number: int, sizes: Sizes):
        self.number, self.sizes, self.size = number, sizes, 0
        self.open: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        self.open_size = 0
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        self.open.append((doc_id, a, b))
        size = a.nbytes + b.nbytes + ROW_BYTES
        self.size, self.open_size = self.size + size, self.open_size + size
        return self.step() if self.open_size >= STEP_BYTES else None

    def step(self) -> pa.RecordBatch | None:
        if not self.open:
            return None
        ids, a, b = zip(*self.open)
        n_a, n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs, counts = Aligned(self.sizes, a, b, n_a, n_b).distinct()
            self.pairs.append(pairs)
            self.counts.append(counts)
        self.open, self.open_size = [], 0
        row = [_TEXTS, self.number, None, list(ids), n_a, n_b, _packed(a), _packed(b)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ENCODED_ARROW)], schema=_ENCODED_ARROW)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if (row := self.step()) is not None:
            yield row
        if not self.pairs:
            return
        pairs, counts = _merged(self.pairs, self.counts)
        shard = _shard_of(pairs)
        order = np.argsort(shard, kind="stable")
        pairs, counts, shard = pairs[order], counts[order], shard[order]
        names, begins = np.unique(shard, return_index=True)
        parts = [slice(x, y) for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(shard)])]
        n = len(names)
        columns = {
            "kind": [_PAIRS] * n,
            "block": [self.number] * n,
            "shard": names,
            "a": [pairs[p].astype("<i8").tobytes() for p in parts],
            "b": [counts[p].astype("<i8").tobytes() for p in parts],
        }
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ENCODED_ARROW]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ENCODED_ARROW)


def _encoded(files: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = _vocabularies_of(files), TaskContext.get().partitionId() << 32
        block = _Block(first, known.sizes)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                row = block.add(doc_id, *known.encode(text.as_py()))
                if row is not None:
                    yield row
                if block.size >= BLOCK_BYTES:
                    yield from block.rest()
                    block = _Block(block.number + 1, known.sizes)
        yield from block.rest()

    return run


def _longs(data: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i8") for x in data]


def _table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_KEYS = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("pairs", pa.binary())])
_INDEX = pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.binary())), ("pairs", pa.binary())])
_VECTORS = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("totals", pa.binary())])
_REPLIES = pa.schema([("block", pa.int64()), ("pairs", pa.binary()), ("totals", pa.binary())])


def _union(key: tuple, rows: pa.Table) -> pa.Table:
    pairs = np.unique(np.concatenate(_longs(rows["pairs"].to_pylist())))
    return _table(_KEYS, shard=[key[0].as_py()], part=[key[1].as_py()], pairs=[pairs.tobytes()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A perfect hash of each shard's pairs, and the pairs in the order of their index, which verifies them."""
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("pairs").to_pylist()):
            pairs = np.frombuffer(data, "<i8")
            found = PerfectHash.build(pairs)
            ordered = np.empty_like(pairs)
            ordered[found.index(pairs)] = pairs
            yield from _table(_INDEX, shard=[shard], levels=[found.packed()], pairs=[ordered.tobytes()]).to_batches()


def _places(pairs: np.ndarray, known: PerfectHash, kept: np.ndarray) -> np.ndarray:
    place = known.index(pairs)
    if (place < 0).any() or not np.array_equal(kept[place], pairs):
        raise ValueError("a pair is not the one its index was made for")
    return place


def _opened(index: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    return PerfectHash.unpacked(index["levels"][0].as_py()), np.frombuffer(index["pairs"][0].as_py(), "<i8")


def _counted(key: tuple, parts: pa.Table, index: pa.Table) -> pa.Table:
    """The counts of some blocks as one dense vector over the shard's index."""
    if not parts.num_rows:
        return _VECTORS.empty_table()
    known, kept = _opened(index)
    totals = np.zeros(len(kept), dtype=np.int64)
    for pairs, counts in zip(_longs(parts["pairs"].to_pylist()), _longs(parts["counts"].to_pylist())):
        totals[_places(pairs, known, kept)] += counts
    return _table(_VECTORS, shard=[key[0].as_py()], part=[key[1].as_py()], totals=[totals.tobytes()])


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    totals = sum(_longs(rows["totals"].to_pylist()))
    return _table(_VECTORS, shard=[key[0].as_py()], part=[key[1].as_py()], totals=[totals.tobytes()])


def _answered(key: tuple, parts: pa.Table, index: pa.Table) -> pa.Table:
    """For each block its own pairs with their corpus counts."""
    if not parts.num_rows:
        return _REPLIES.empty_table()
    known, kept = _opened(index)
    totals = np.frombuffer(index["totals"][0].as_py(), "<i8")
    data = parts["pairs"].to_pylist()
    found = [totals[_places(pairs, known, kept)].tobytes() for pairs in _longs(data)]
    return _table(_REPLIES, block=parts["block"].to_pylist(), pairs=data, totals=found)


def _best_of_shard(n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, totals in zip(_longs(batch.column("pairs").to_pylist()), _longs(batch.column("totals").to_pylist())):
                a = pairs // n_b
                order = np.lexsort((totals, a))
                last = np.flatnonzero(np.diff(a[order], append=-1))
                yield pa.record_batch([pa.array(a[order][last]), pa.array(totals[order][last])], ["a", "best"])

    return run


_RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups", pa.string())]
)


def _digested(sizes: Sizes, best: np.ndarray):
    def part(row: dict, pairs: np.ndarray, totals: np.ndarray) -> pa.Table:
        a, b = (_unpacked(row[side], sizes.ids) for side in ("a", "b"))
        aligned = Aligned(sizes, a, b, np.array(row["n_a"], dtype=np.int64), np.array(row["n_b"], dtype=np.int64))
        counts = totals[np.searchsorted(pairs, aligned.pairs)] if len(aligned.pairs) else np.zeros(0, dtype=np.int64)
        is_best = counts == best[aligned.pairs // len(sizes.b)]
        ends = aligned.link_ends
        sums, bests = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(is_best)))
        return _table(
            _RESULT,
            doc_id=row["doc_ids"],
            n_a=aligned.n_a,
            n_b=aligned.n_b,
            n_groups=aligned.doc_groups,
            n_links=np.diff(ends, prepend=0),
            n_best=np.diff(bests[ends], prepend=0),
            count_sum=np.diff(sums[ends], prepend=0),
            groups=aligned.groups(),
        )

    def run(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        pairs = totals = np.zeros(0, dtype=np.int64)
        if replies.num_rows:
            pairs = np.concatenate(_longs(replies["pairs"].to_pylist()))
            totals = np.concatenate(_longs(replies["totals"].to_pylist()))
            order = np.argsort(pairs)
            pairs, totals = pairs[order], totals[order]
        parts = [part(row, pairs, totals) for row in texts.to_pylist()]
        return pa.concat_tables(parts) if parts else _RESULT.empty_table()

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<binary>')}" for f in schema)


def _tree(rows: DataFrame, parts: int, combine, schema: pa.Schema) -> DataFrame:
    """Rows of ``shard, part`` combined, ``FAN_IN`` parts at a time, until each shard is one row."""
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("shard", "part").applyInArrow(combine, _ddl(schema))
    return rows


def align(
    docs: DataFrame,
    byte_file: str,
    piece_file: str,
    rank_file: str | None = None,
    pattern: str | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """How the tokens of tokenizer A and B cover each text of ``doc_id, text``, and how common their links are.

    A encodes a space and the text, B the text, to which it adds that space, both without special tokens. The bytes of
    both are the same, so offsets where both end cut the tokens into groups; tokens whose byte ranges overlap are
    linked. Returned per row: ``doc_id, n_a, n_b, n_groups, n_links``, ``count_sum`` (over links, the number of documents
    corpus-wide that hold the link's pair of ids linked), ``n_best`` (links whose count is the highest that their A id
    has in the corpus, ties included) and ``groups``, the ids as ``a1,a2|b1;a3|b2,b3``.

    First pass: texts are encoded and aligned in blocks of about 16 MB of ids, which are written with each block's
    distinct pairs, split over shards by a hash. A tree of unions gives each shard's distinct pairs and their minimal
    perfect hash; the blocks' counts become dense vectors over that index, the pairs kept beside it verify every
    look-up, and a tree sums the vectors. Second pass: each block is aligned again from its ids and looks up the counts
    of its own pairs. No task holds more than a block, one shard (at most a 64th of all pairs of ids, 200 MB for two
    vocabularies of 50,000 and 32,000) or ``FAN_IN`` partial ones; no pair is a row of its own. Only the highest count
    of each A id passes the driver, at most one number per id of A's vocabulary.

    Null and empty texts, and texts of which A's or B's bytes are not a space and the text (B may rewrite characters),
    have no tokens: zeros and empty groups. Rows that repeat, or share a ``doc_id``, are documents of their own, also in
    the counts; a null ``doc_id`` stays null. Other columns are not read, whatever they are called. No rows give none.
    A text is aligned whole, which takes some 100 bytes of memory per byte of it. The result is stored; ``derive`` is
    applied before, for callers who want something shorter than the texts of the groups.
    """
    files = (byte_file, piece_file, rank_file, pattern)
    spark = docs.sparkSession
    sizes = _vocabularies_of(files).sizes
    with Scratch(spark, "alignment") as work:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        encoded = work.keep(rows.mapInArrow(_encoded(files), _ENCODED), partition_by="kind")
        texts = encoded.filter(F.col("kind") == _TEXTS).select("block", "doc_ids", "n_a", "n_b", "a", "b")
        parts = encoded.filter(F.col("kind") == _PAIRS).select(
            "shard", "block", F.col("a").alias("pairs"), F.col("b").alias("counts")
        )
        blocks = parts.agg(F.count_distinct("block")).first()[0]
        dealt = parts.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(max(1, blocks))))
        keys = _tree(dealt.select("shard", "part", "pairs"), max(2, blocks), _union, _KEYS)
        index = work.keep(keys.mapInArrow(_hashed, _ddl(_INDEX)))

        wide = -(-blocks // FAN_IN) or 1
        bundled = dealt.withColumn("part", F.pmod("part", F.lit(wide)))
        asked = work.keep(bundled.select("shard", "part").distinct())
        vectors = (
            bundled.groupBy("shard", "part")
            .cogroup(index.join(asked, "shard").groupBy("shard", "part"))
            .applyInArrow(_counted, _ddl(_VECTORS))
        )
        totals = _tree(vectors, wide, _summed, _VECTORS)
        index = work.keep(index.join(totals.select("shard", "totals"), "shard"))
        highest = index.mapInArrow(_best_of_shard(len(sizes.b)), "a long, best long").groupBy("a").agg(F.max("best").alias("best"))
        best = np.zeros(len(sizes.a), dtype=np.int64)
        for row in highest.collect():
            best[row.a] = row.best
        replies = (
            bundled.groupBy("shard", "part")
            .cogroup(index.join(asked, "shard").groupBy("shard", "part"))
            .applyInArrow(_answered, _ddl(_REPLIES))
        )
        found = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_digested(sizes, best), _ddl(_RESULT))
        return stored(derive(found) if derive else found, "alignment")
