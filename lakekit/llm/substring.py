"""Repeated passages by level-wise doubling of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekit.llm.hashing import byte_rows, mix, window_hashes, word_hashes, word_spans
from lakekit.llm.scratch import Scratch
from lakekit.session import stored
from lakekit.sources.tables import spread

# A document of a table is known by its id and a digest of its text; equal rows share both, and their answers.
_KEY = ["doc_id", "twin"]
_SEEN = "hash_a long, hash_b int, doc_id long, twin int, at int, places array<int>"
_BATCH_WINDOWS = 1 << 20


def least_of(values: np.ndarray, reach: int) -> np.ndarray:
    """For every stretch of ``reach`` neighbouring values the place of its least one, the first of equal ones.

    The choice depends on the values alone, so equal stretches choose alike wherever they stand.
    """
    if len(values) < reach:
        return np.empty(0, dtype=np.int64)
    view = sliding_window_view(values, reach)
    return view.argmin(axis=1) + np.arange(len(view))


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending whole numbers as stretches: first and last of each."""
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]]


def spelled(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The whole numbers of stretches."""
    sizes = last - first + 1
    return np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(first) else first


class _Sightings:
    """Windows of a batch of documents, one row for each distinct one.

    A window seen twice here needs no answer: it is repeated, and its places are told at once, a row per document
    under a key of its own. It is still posted once, without a document, for those who have it elsewhere. So a
    frequent window costs one posting per batch, not one per occurrence, and no key is frequent in the shuffle.
    """

    def __init__(self):
        self.parts: list[tuple] = []
        self.docs: list[tuple[int | None, int]] = []
        self.size = 0

    def add(self, hash_a: np.ndarray, hash_b: np.ndarray, doc_id: int | None, twin: int, at: np.ndarray) -> None:
        if len(at):
            self.parts.append((hash_a, hash_b, np.full(len(at), len(self.docs)), at))
            self.docs.append((doc_id, twin))
            self.size += len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        a, b, doc, at = (np.concatenate(column) for column in zip(*self.parts))
        docs = self.docs
        self.parts, self.docs, self.size = [], [], 0
        order = np.lexsort((b, a))
        a, b, doc, at = a[order], b[order], doc[order], at[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        several = ~fresh | ~np.r_[fresh[1:], True]
        heads, told = np.flatnonzero(fresh), np.flatnonzero(several)
        # in the order of documents, so that neighbouring rows of a shuffled block compress well
        heads = heads[np.lexsort((at[heads], doc[heads]))]
        told = told[np.argsort(doc[told], kind="stable")]
        owners, cuts = np.unique(doc[told], return_index=True)
        places = np.split(at[told], cuts[1:]) if len(owners) else []
        ids = np.array([doc_id or 0 for doc_id, _ in docs])
        known = np.array([doc_id is not None for doc_id, _ in docs])
        twins = np.array([twin for _, twin in docs], dtype=np.int32)
        post = several[heads]
        own = doc[heads]
        n, m = len(heads), len(owners)
        yield pa.record_batch(
            [
                pa.array(np.r_[a[heads], mix(ids[owners].astype(np.uint64) + a[0])].view(np.int64)),
                pa.array(np.r_[b[heads], mix(cuts.astype(np.uint64) + b[0])].astype(np.uint32).view(np.int32)),
                pa.array(np.r_[ids[own], ids[owners]], pa.int64(), mask=np.r_[post | ~known[own], ~known[owners]]),
                pa.array(np.r_[twins[own], twins[owners]], pa.int32(), mask=np.r_[post, np.zeros(m, dtype=bool)]),
                pa.array(np.r_[at[heads], np.zeros(m, dtype=np.int64)], pa.int32(), mask=np.r_[post, np.ones(m, dtype=bool)]),
                pa.array([None] * n + places, pa.list_(pa.int32())),
            ],
            ["hash_a", "hash_b", "doc_id", "twin", "at", "places"],
        )


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(data)
    return word_hashes(data, starts, ends), word_hashes(data, starts, ends, 1)


def _places(first: list[int] | None, last: list[int] | None) -> np.ndarray:
    return spelled(np.asarray(first or [], dtype=np.int64), np.asarray(last or [], dtype=np.int64))


def _first_level(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Sightings()
        for batch in batches:
            ids, twins = batch.column("doc_id"), batch.column("twin").to_pylist()
            for row, data in enumerate(byte_rows(batch.column("text"))):
                one, two = _words(data)
                values = window_hashes(one, length)
                at = np.unique(least_of(values, reach))
                doc_id = ids[row].as_py()
                seen.add(values[at], window_hashes(two, length, 1)[at], doc_id, twins[row], at)
                if seen.size >= _BATCH_WINDOWS:
                    yield from seen.flush()
        yield from seen.flush()

    return run


def marked(places: np.ndarray, count: int) -> np.ndarray:
    marks = np.zeros(count, dtype=bool)
    marks[places] = True
    return marks


def from_anchors(places: np.ndarray, values: np.ndarray, reach: int) -> np.ndarray:
    """Starts of windows of the full length whose own anchor, the least of the ``reach`` windows inside, is repeated."""
    return np.flatnonzero(marked(places, len(values))[least_of(values, reach)])


def from_windows(places: np.ndarray, count: int, length: int, to: int) -> np.ndarray:
    """Starts of windows of the greater length in which every window of the lesser one is repeated."""
    good = np.r_[0, np.cumsum(marked(places, count))]
    starts = np.arange(max(0, count + length - to))
    inside = to - length + 1
    return starts[good[starts + inside] - good[starts] == inside]


def _next_level(length: int, to: int, reach: int | None):
    """``reach``: of how many windows an anchor was chosen at the level before; None if all were looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Sightings()
        for batch in batches:
            ids, twins = batch.column("doc_id"), batch.column("twin").to_pylist()
            firsts, lasts = batch.column("first").to_pylist(), batch.column("last").to_pylist()
            for row, data in enumerate(byte_rows(batch.column("text"))):
                one, two = _words(data)
                count = len(one) - length + 1
                places = _places(firsts[row], lasts[row])
                if count <= 0 or not len(places):
                    continue
                if reach is None:
                    at = from_windows(places, count, length, to)
                else:
                    at = from_anchors(places, window_hashes(one, length), reach)
                doc_id = ids[row].as_py()
                wide = window_hashes(one, to)[at], window_hashes(two, to, 1)[at]
                seen.add(*wide, doc_id, twins[row], at)
                if seen.size >= _BATCH_WINDOWS:
                    yield from seen.flush()
        yield from seen.flush()

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [runs(np.unique(np.asarray(places, dtype=np.int64))) for places in batch.column("places").to_pylist()]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("twin"),
                pa.array([first for first, _ in pairs], pa.list_(pa.int32())),
                pa.array([last for _, last in pairs], pa.list_(pa.int32())),
            ],
            ["doc_id", "twin", "first", "last"],
        )


def _answers(sightings: DataFrame) -> DataFrame:
    """Per document the stretches of places whose window was seen more than once."""
    alike = Window.partitionBy("hash_a", "hash_b")
    counted = sightings.withColumn("n", F.count(F.lit(1)).over(alike))
    repeated = counted.filter("places is not null or (n > 1 and at is not null)")
    gathered = repeated.groupBy(*_KEY).agg(
        F.concat(F.collect_list("at"), F.flatten(F.collect_list("places"))).alias("places")
    )
    return gathered.mapInArrow(_stretches, "doc_id long, twin int, first array<int>, last array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``own_id``, their ``doc_id``, and a key of 96 bits of it and the text: ``doc_id`` and ``twin``."""
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("own_id"), F.xxhash64(own, "text").alias("doc_id"), "text", F.hash("text").alias("twin"))


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    same = (docs["doc_id"] == places["doc_id"]) & (docs["twin"] == places["twin"])
    return docs.join(places, same, how).select(*[docs[c] for c in docs.columns], places["first"], places["last"])


def repeated_windows(docs: DataFrame, window: int, work: Scratch, longest: int | None = None) -> DataFrame:
    """``doc_id, twin, length, first, last``: stretches of places at which a window of ``length`` words starts whose
    word sequence also starts elsewhere in ``docs``, in the same document or another.

    The first level is half the window. Of its windows only anchors are looked up, about one in ten: each window of
    the full length has one of its own, chosen by its content, which is repeated if the window is. Only windows
    made of repeated ones are looked up at the next level, which is twice as long, up to ``longest`` (the window
    itself, if not given) or until none is left. Each level looks up 96 bits of all its candidates.

    Without ``longest`` the last level is left to the query that uses it: where that joins the same rows by the same
    key again, Spark shuffles them once for both joins.
    """
    return _levels(keyed(docs), window, work.keep, longest)


def _levels(rows: DataFrame, window: int, keep: Callable[[DataFrame], DataFrame], longest: int | None = None) -> DataFrame:
    """``repeated_windows`` of rows that have their key. All their columns go through the joins, so that a later join
    of the same rows finds the shuffle it needs."""
    half = (window + 1) // 2
    reach = window - half + 1
    found = keep(_answers(spread(rows.select(*_KEY, "text")).mapInArrow(_first_level(half, reach), _SEEN)))
    length, how, levels = half, reach, []
    while length < (longest or window):
        to = min(2 * length, window) if length < window else 2 * length
        candidates = with_places(rows, found, "inner")
        found = _answers(candidates.mapInArrow(_next_level(length, to, how), _SEEN))
        if longest or to < window:
            found = keep(found)
        length, how = to, None
        if length >= window:
            levels.append(found.select(*_KEY, F.lit(length).alias("length"), "first", "last"))
            if longest and found.isEmpty():
                break
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.union(level)
    return whole


def covered(count: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of ``count`` words lie in a window that starts in one of the stretches."""
    steps = np.zeros(count + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(last + window, count), -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept_texts, begins, finishes = [], [], [], [], [], []
            firsts, lasts = batch.column("first").to_pylist(), batch.column("last").to_pylist()
            for row, data in enumerate(byte_rows(batch.column("text"))):
                starts, ends = word_spans(data)
                first, last = (np.asarray(side[row] or [], dtype=np.int64) for side in (firsts, lasts))
                out = covered(len(starts), first, last, window)
                kept = np.flatnonzero(~out)
                raw = data.tobytes()
                words = [raw[starts[w] : ends[w]] for w in kept]
                total.append(len(starts))
                gone.append(int(out.sum()))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if gone[-1]:
                    pieces = [raw[starts[a] : ends[b]] for a, b in zip(*runs(kept))]
                    kept_texts.append(b" ".join(pieces).decode("utf-8", "replace"))
                else:
                    kept_texts.append(None)
                cut_first, cut_last = runs(np.flatnonzero(out))
                begins.append(cut_first)
                finishes.append(cut_last + 1)
            yield pa.record_batch(
                [
                    batch.column("own_id"),
                    batch.column("twin"),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(kept_texts, pa.string()),
                    pa.array(begins, pa.list_(pa.int32())),
                    pa.array(finishes, pa.list_(pa.int32())),
                ],
                ["doc_id", "twin", "n_words", "n_removed", "kept_sha256", "kept_text", "cut_from", "cut_to"],
            )

    return run


_CUT = (
    "doc_id long, twin int, n_words long, n_removed long, kept_sha256 string, kept_text string, "
    "cut_from array<int>, cut_to array<int>"
)


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): ``doc_id, twin, n_words, n_removed, kept_sha256,
    kept_text, cut_from, cut_to``.

    Removed is each word covered by a window of ``window`` words whose word sequence also starts anywhere else, in
    the same document or another, on the input; all copies lose it. Words are runs of anything but ASCII white
    space, unchanged. ``kept_text`` is null where nothing was removed, else the parts left, joined by a space;
    ``cut_from`` and ``cut_to`` are word places. ``twin`` is a digest of the text that tells rows with one
    ``doc_id`` apart.

    Null or empty texts and texts under ``window`` words lose nothing; the digest of no words is that of the empty
    string. Repeated rows count as documents of their own, so they repeat one another. A null ``doc_id`` is a
    document like any other. Other columns are not read. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession, "substring") as work:
        places = repeated_windows(docs, window, work)
        return stored(with_places(keyed(docs), places, "left").mapInArrow(_cut(window), _CUT), "substring")


def _replace(window: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(held_as(place, c)) for place, c in enumerate(columns)]
            firsts, lasts = batch.column("first").to_pylist(), batch.column("last").to_pylist()
            text_at, size_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
            texts = rows[text_at].to_pylist()
            sizes = rows[size_at].to_pylist() if size_at is not None else None
            for row, data in enumerate(byte_rows(rows[text_at])):
                if not firsts[row]:
                    continue
                starts, ends = word_spans(data)
                first, last = np.asarray(firsts[row], dtype=np.int64), np.asarray(lasts[row], dtype=np.int64)
                kept = runs(np.flatnonzero(~covered(len(starts), first, last, window)))
                raw = data.tobytes()
                texts[row] = b" ".join(raw[starts[a] : ends[b]] for a, b in zip(*kept)).decode("utf-8", "replace")
                if sizes is not None:
                    sizes[row] = len(texts[row])
            rows[text_at] = pa.array(texts, rows[text_at].type)
            if size_at is not None:
                rows[size_at] = pa.array(sizes, rows[size_at].type)
            yield pa.RecordBatch.from_arrays(rows, columns)

    return run


def held_as(place: int, column: str) -> str:
    """What a column of the caller's is called beside the key; the text keeps its name, so it is held once."""
    return column if column == "text" else f"c{place}"


def cut_texts(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows of ``docs``, all their columns, without the words that ``without_repeats`` removes.

    Texts that lose nothing stay as they are; of others the parts left are joined by a space, and ``n_chars``, where
    there is such a column, follows. A document may be left with an empty text.

    The first level is written to the shared folder; the last one and the cut are left to the query that uses the
    result, which shuffles the rows once for both. A result that is used several times is best written first.
    """
    own = [F.col(f"`{c}`").alias(held_as(place, c)) for place, c in enumerate(docs.columns)]
    key = F.xxhash64(F.col("doc_id").cast("long"), "text").alias("doc_id"), F.hash("text").alias("twin")
    rows = docs.select(*key, *own)
    places = _levels(rows, window, lambda found: stored(found, "substring-places"))
    return with_places(rows, places, "left").mapInArrow(_replace(window, docs.columns), docs.schema)
