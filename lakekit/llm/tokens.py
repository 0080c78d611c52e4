"""Token ids of texts, and a binary format that keeps them in planes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekit.llm.hashing import byte_rows

BLOCK_IDS = 16_384
SEGMENT_IDS = 1 << 20
_CACHED_CHUNKS = 600_000
_KEPT_CHUNKS = 300_000
_JOINED_CHUNKS = 128
_BYTES_AT_ONCE = 1 << 20

# The bytes of the ASCII and Latin-1 letters in UTF-8, which are lower-cased one by one and never joined to others,
# and the ASCII marks.
_LETTERS = bytes(c for c in [*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)] if c not in (0x97, 0xB7))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a tokenizer file of the tokenizers library.

    Where the tokenizer drops white space and never looks across it, a text's ids are those of its chunks between
    ASCII spaces, in order. Chunks recur, so those known are kept, also for a worker's next tasks; fresh ones are encoded
    many at a time. The memory for them is bounded, more closely between tasks than in one. Whether the above holds is
    tried on the tokenizer; if not, texts are encoded as they are.

    Where the tokenizer is moreover of the kind that lower-cases, keeps runs of letters and of marks apart and ends each
    by a suffix, a chunk of plain letters is one word to its model, marks after it are another, and its case does not
    matter. Such words go to the model without the steps before it; all other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        alone = [self._ids(text) for text in ("ab", "cd", "!?")]
        self.by_chunk = self._ids(" ab\tcd\n\n !? ") == sum(alone, [])
        self.words = _word_tokenizer(self.tokenizer) if self.by_chunk else None
        if self.words:
            vocabulary, suffix = self.words.get_vocab(), self.words.model.end_of_word_suffix
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
            self.special = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), _JOINED_CHUNKS):
            keys = chunks[at : at + _JOINED_CHUNKS]
            part = [key.decode("utf-8", "replace") for key in keys]
            encoded = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            places = np.fromiter((place for place, _ in encoded.offsets), dtype=np.int64, count=len(encoded.ids))
            begins = np.cumsum([0] + [len(chunk) + 1 for chunk in part])
            self._store(keys, encoded.ids, np.searchsorted(places, begins))

    def _learn_words(self, words: list[bytes]) -> None:
        for at in range(0, len(words), _JOINED_CHUNKS):
            keys = words[at : at + _JOINED_CHUNKS]
            ids = self.words.encode(b" ".join(keys).decode().lower(), add_special_tokens=False).ids
            cuts = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
            if len(cuts) == len(keys) + 1:
                self._store(keys, ids, cuts)
            else:
                self._learn(keys)

    def _store(self, keys: list[bytes], ids: list[int], cuts: np.ndarray) -> None:
        data, cuts = np.asarray(ids, dtype="<u4").tobytes(), (4 * cuts).tolist()
        for key, begin, end in zip(keys, cuts, cuts[1:]):
            self.chunks[key] = data[begin:end]

    def _learn_all(self, fresh: set[bytes]) -> None:
        """Ids of chunks that are not known, by words where they are made of such."""
        for chunk in [chunk for chunk in fresh if chunk in self.older]:
            self.chunks[chunk] = self.older[chunk]
            fresh.discard(chunk)
        if not self.words or not _is_text(b" ".join(fresh)):
            return self._learn(list(fresh))
        words, others, pairs = set(), set(), []
        for chunk in fresh:
            word, marks = _word_and_marks(chunk)
            if not word:
                others.add(chunk)
                continue
            words.add(word)
            if marks:
                others.add(marks)
                pairs.append((chunk, word, marks))
        self._learn([chunk for chunk in others if chunk not in self.chunks])
        self._learn_words([word for word in words if word not in self.chunks])
        for chunk, word, marks in pairs:
            self.chunks[chunk] = self.chunks[word] + self.chunks[marks]

    def _chunks(self, text: bytes) -> list[bytes]:
        """The chunks of a text, A-Z lower-cased if the tokenizer does so and neither accents nor special tokens differ."""
        if self.words and b"\xcc" not in text and b"\xcd" not in text:
            low = text.lower()
            if not any(token in low for token in self.special):
                return low.split()
        return text.split()

    def _encode_some(self, texts: list[bytes]) -> Iterator[bytes]:
        if len(self.chunks) > _CACHED_CHUNKS:
            # what is still in use moves on from the older half, the rest of it is forgotten
            self.older, self.chunks = self.chunks, {}
        split, fresh = [], set()
        for text in texts:
            chunks = self._chunks(text)
            ids = list(map(self.chunks.get, chunks))
            gaps = [place for place, known in enumerate(ids) if known is None]
            fresh.update([chunks[place] for place in gaps])
            split.append((ids, gaps, [chunks[place] for place in gaps]))
        self._learn_all(fresh)
        for ids, gaps, chunks in split:
            for place, chunk in zip(gaps, chunks):
                ids[place] = self.chunks[chunk]
            yield b"".join(ids)

    def rest(self) -> None:
        """After a task. The worker's next ones may be others, so only chunks met early stay, the frequent among them."""
        if self.older or len(self.chunks) > _KEPT_CHUNKS:
            known = chain(self.chunks.items(), self.older.items())
            self.chunks, self.older = dict(islice(known, _KEPT_CHUNKS)), {}

    def encode(self, texts: Iterator[np.ndarray]) -> Iterator[bytes]:
        """Ids of each text, given as UTF-8 bytes."""
        some, size = [], 0
        for data in texts:
            text = data.tobytes()
            if not self.by_chunk:
                yield np.asarray(self._ids(text.decode("utf-8", "replace")), dtype="<u4").tobytes()
                continue
            some.append(text)
            size += len(text)
            if size >= _BYTES_AT_ONCE:
                yield from self._encode_some(some)
                some, size = [], 0
        yield from self._encode_some(some)


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _word_and_marks(chunk: bytes) -> tuple[bytes, bytes]:
    """The plain letters a chunk begins with and the marks after them, if it is nothing else; else two empty strings."""
    marks = chunk.translate(None, _LETTERS)
    if marks.translate(None, _MARKS) or not chunk.endswith(marks):
        return b"", b""
    return chunk[: len(chunk) - len(marks)], marks


def _word_tokenizer(tokenizer):
    """The model alone over words between spaces, if the steps before it do no more to plain letters; else None."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    steps = [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
    cuts = [pre_tokenizers.Split(Regex(words), "removed", invert=True), as_bytes]
    wanted = normalizers.Sequence(steps).__getstate__(), pre_tokenizers.Sequence(cuts).__getstate__()
    found = [step and step.__getstate__() for step in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    model = tokenizer.model
    if tuple(found) != wanted or not isinstance(model, models.BPE) or not model.end_of_word_suffix:
        return None
    if model.dropout or model.continuing_subword_prefix or model.unk_token or model.ignore_merges or tokenizer.post_processor:
        return None
    added = [token.content.encode() for token in tokenizer.get_added_tokens_decoder().values()]
    if any(token in (b"".join(_word_and_marks(token)), token.translate(None, _LETTERS)) for token in added):
        return None  # such a token may stand inside a word or its marks
    alone = Tokenizer(model)
    alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
    return alone


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder, kept for its next tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with its rows' ids, the end id included. A null text has only that."""
    encoder, end = encoder_of(path), np.asarray([end_id], dtype="<u4").tobytes()
    for batch in batches:
        yield batch, [ids + end for ids in encoder.encode(byte_rows(batch.column("text")))]
    encoder.rest()


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """A block of ids turned on its side: all first bytes, all second bytes and so on, or the same by bits."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    rows = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [np.ascontiguousarray(plane).tobytes() for plane in rows.T]
    planes = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(plane, bitorder="little").tobytes() for plane in planes.T]


def from_planes(planes: list[bytes], count: int, bits: bool = False) -> np.ndarray:
    if bits:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in planes], axis=1)
        data = np.packbits(rows, axis=1, bitorder="little")
    else:
        data = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(data).view(f"<u{data.shape[1]}").ravel().astype("<u4")


_FILE = (
    "shard int, segment int, start long, n_ids long, bits boolean, "
    "chunks array<struct<n_ids int, offset long, planes array<int>>>, "
    "docs array<struct<doc_id long, offset long, n_tokens long>>, data binary"
)


class _Segment:
    """Whole documents up to about a million ids; the ids in fixed-size blocks, each block in compressed planes."""

    def __init__(self, bits: bool):
        self.bits, self.packer = bits, zstandard.ZstdCompressor(level=3)
        self.parts: list[bytes] = []
        self.docs: list[dict] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append({"doc_id": doc_id, "offset": self.size, "n_tokens": len(ids) // 4})
        self.parts.append(ids)
        self.size += len(ids) // 4

    def row(self, shard: int, segment: int, start: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(self.parts), dtype="<u4")
        chunks, data, offset = [], [], 0
        for at in range(0, len(ids), BLOCK_IDS):
            block = ids[at : at + BLOCK_IDS]
            planes = [self.packer.compress(plane) for plane in to_planes(block, self.bits)]
            chunks.append({"n_ids": len(block), "offset": offset, "planes": [len(p) for p in planes]})
            data += planes
            offset += sum(map(len, planes))
        row = {
            "shard": shard,
            "segment": segment,
            "start": start,
            "n_ids": len(ids),
            "bits": self.bits,
            "chunks": chunks,
            "docs": self.docs,
            "data": b"".join(data),
        }
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("bits", pa.bool_()),
        ("chunks", pa.list_(pa.struct([("n_ids", pa.int32()), ("offset", pa.int64()), ("planes", pa.list_(pa.int32()))]))),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))),
        ("data", pa.binary()),
    ]
)


def _write(path: str, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        segment, number, start = _Segment(bits), 0, 0
        for batch, rows in encoded_batches(batches, path, end_id):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), rows):
                segment.add(doc_id, ids)
                if segment.size >= SEGMENT_IDS:
                    yield segment.row(shard, number, start)
                    start += segment.size
                    segment, number = _Segment(bits), number + 1
        if segment.docs:
            yield segment.row(shard, number, start)

    return run


def write_ids(docs: DataFrame, target: str, tokenizer: str, end_id: int, bits: bool = False) -> None:
    """Write the ids of every text in ascending ``doc_id`` order, an end id after each document.

    The target is a folder of Parquet files that serve as containers. Files are shards in order, by range of
    ``doc_id``; a row is a segment of whole documents with its binary data, the index of its chunks (ids, place
    and length of each compressed plane) and that of its documents. Spark's writers commit it, so repeated tasks
    leave nothing behind, and any store that Spark writes to will do. Null ids come first, equal ids by a hash of
    their text, so that rows of one id, or without one, are ranged over as many shards as they need.

    Null and empty texts are documents of the end id alone; rows that repeat are documents of their own. Other
    columns are not read, whatever they are called. No rows give no documents.
    """
    turn = F.xxhash64("text").alias("turn")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", turn, F.spark_partition_id().alias("part"))
    order = ["doc_id", "turn", "text", "part"]
    ordered = ordered.repartitionByRange("doc_id", "turn", "part").sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer, end_id, bits), _FILE).write.option("compression", "none").parquet(target)


def segment_ids(chunks: list[dict], data: bytes, bits: bool) -> np.ndarray:
    """The ids of a segment, from its chunk index and its data."""
    reader = zstandard.ZstdDecompressor()
    parts = [np.empty(0, dtype="<u4")]
    for chunk in chunks:
        at, planes = chunk["offset"], []
        for size in chunk["planes"]:
            planes.append(reader.decompress(data[at : at + size]))
            at += size
        parts.append(from_planes(planes, chunk["n_ids"], bits))
    return np.concatenate(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place in range(batch.num_rows):
            row = batch.slice(place, 1).to_pylist()[0]
            ids = segment_ids(row["chunks"], row["data"], row["bits"])
            docs = row["docs"]
            parts = [ids[d["offset"] : d["offset"] + d["n_tokens"]] for d in docs]
            yield pa.record_batch(
                [
                    pa.array([row["shard"]] * len(docs), pa.int32()),
                    pa.array([d["doc_id"] for d in docs], pa.int64()),
                    pa.array([row["start"] + d["offset"] for d in docs], pa.int64()),
                    pa.array([d["n_tokens"] for d in docs], pa.int64()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ],
                ["shard", "doc_id", "within", "n_tokens", "ids", "ids_crc32"],
            )


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids, ids_crc32`` of every document in the files; ``ids`` are little-endian 32-bit.

    Documents never cross a segment, so segments are read by whatever task has them. Only the ids counted per
    shard, a row each, are summed in order.
    """
    files = spark.read.parquet(source)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    schema = "shard int, doc_id long, within long, n_tokens long, ids binary, ids_crc32 long"
    docs = files.mapInArrow(_read, schema)
    start = (F.col("before") + F.col("within")).alias("start")
    return docs.join(shards, "shard").select("doc_id", start, "n_tokens", "ids", "ids_crc32")


PieceMaker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def pieces(tokenizer: str, end_id: int, capacity: int) -> PieceMaker:
    """Documents as pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in encoded_batches(batches, tokenizer, end_id):
            out: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), rows):
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(column, kind) for column, kind in zip(out, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
