"""WARC archives of pages, and capture histories merged from the archives' sorted indexes."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.llm.scratch import Scratch
from lakekit.session import stored

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
END_OF_RECORD = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS_PER_FILE = 5_000
MERGE_ROWS = 200_000
FIRST_CAPTURE = "2024-01-01 00:00:00"

ENTRY = (
    "urlkey string, captured string, page_id long, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, file string, offset long, length long"
)
_COLUMNS = [part.split()[0] for part in ENTRY.split(", ")]


def base32(sha1_hex: Column) -> Column:
    """The 32 base32 characters of 40 hexadecimal ones: five of these are four of those."""
    letters = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(sha1_hex, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """A sort key that puts the captures of a host together: host labels from the last, then the rest, lower case."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?#]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each row of ``pages`` with its payload, digest, capture time, record type and what it revisits.

    Only digests are grouped; payloads meet nothing but the digests that occur more than once.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    seconds = F.coalesce(F.col("page_id"), F.lit(0)).cast("long")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.date_format(
            F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE)) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        ).alias("captured"),
    )
    several = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("sha1", "payload_bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .drop("n")
    )
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    return (
        rows.join(several, ["sha1", "payload_bytes"], "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first")))
    )


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def records(rows: DataFrame) -> DataFrame:
    """One WARC record per capture as text. A revisit holds no payload, its header says how large it was.

    Line ends in a url are percent-encoded, since a header is one line.
    """
    revisit = F.col("record_type") == "revisit"
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    stored_bytes = F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    parts = [
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _header("WARC-Date", F.col("captured")),
        F.coalesce(_header("WARC-Target-URI", url), F.lit("")),
        F.coalesce(_header("X-URL-Key", F.regexp_replace(url_key(F.col("url")), r"[\r\n]", " ")), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _header("X-Payload-Length", F.col("payload_bytes")),
        F.when(
            revisit,
            F.concat(
                _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                _header("WARC-Profile", F.lit(PROFILE)),
            ),
        ).otherwise(F.lit("")),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", stored_bytes),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    ]
    return rows.select(F.concat(*parts).alias("value"))


def write_archives(pages: DataFrame, target: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` into gzip-compressed WARC files below ``target``.

    Spark's text writer does it, the end of a record being its line end, so any store will do and a repeated task
    leaves nothing behind. Files hold at most ``RECORDS_PER_FILE`` records.
    """
    writer = records(captures(pages, min_bytes)).write.option("lineSep", END_OF_RECORD).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(target)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place, length, headers and payload of each record of an archive."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = head + 4
        end = begin + int(headers["Content-Length"])
        if content[end : end + 4] != END_OF_RECORD.encode():
            raise ValueError(f"record at byte {at} is cut short")
        yield at, end + 4 - at, headers, content[begin:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if number == "none" else int(number)


def entry(file: str, at: int, length: int, headers: dict[str, str], payload: bytes) -> tuple:
    """The index line of a record. What a response says of its payload is checked against the payload."""
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if headers["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    return (
        headers["X-URL-Key"],
        headers["WARC-Date"],
        _page(headers["WARC-Record-ID"]),
        headers["WARC-Type"],
        digest,
        size,
        _page(headers.get("WARC-Refers-To")),
        file,
        at,
        length,
    )


def _order(line: tuple) -> tuple:
    """URL key, time, page and place: a total order of the records of a collection."""
    return line[0], line[1], line[2] is None, line[2] or 0, line[7], line[8]


def _batch(lines: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*lines), kinds)], _COLUMNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place in range(batch.num_rows):
            path = batch.column("path")[place].as_py()
            content = gzip.decompress(batch.column("content")[place].as_py())
            file = path.rsplit("/", 1)[-1]
            lines = sorted((entry(file, *record) for record in parse(content)), key=_order)
            if lines:
                yield _batch(lines)


def read_archives(spark: SparkSession, source: str) -> DataFrame:
    """Index lines of every record, one sorted run per archive file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source)
    return files.select("path", "content").mapInArrow(_runs, ENTRY)


class LoserTree:
    """The least of the heads of k sorted runs; taking it costs one comparison per level.

    Inner nodes hold the run that lost there, node 0 the winner. An ended run loses to every other.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.keys = [_order(run[0]) if run else None for run in runs]
        self.tree = [-1] * max(1, self.k)
        for run in range(self.k):
            self._play(run)

    def _less(self, one: int, other: int) -> bool:
        if self.keys[one] is None or self.keys[other] is None:
            return self.keys[other] is None and self.keys[one] is not None
        return (self.keys[one], one) < (self.keys[other], other)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            held = self.tree[node]
            if held == -1:
                self.tree[node] = run
                return
            if self._less(held, run):
                self.tree[node], run = run, held
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.tree[0]] is not None:
            run = self.tree[0]
            line = self.runs[run][self.at[run]]
            self.at[run] += 1
            ended = self.at[run] == len(self.runs[run])
            self.keys[run] = None if ended else _order(self.runs[run][self.at[run]])
            self._play(run)
            yield line


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for line in zip(*[column.to_pylist() for column in batch.columns]):
            runs.setdefault(line[7], []).append(line)
    out: list[tuple] = []
    for line in LoserTree(list(runs.values())):
        out.append(line)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def histories(index: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """All index lines in one order by URL key and time: partitions in order, and in order within each.

    Lines are dealt by ranges of URL key, time and page, about ``merge_rows`` each, so that one busy URL key
    spans as many ranges as it needs. In a range the slices of the sorted runs, one per archive file, are merged by
    a loser tree.
    """
    ranges = max(1, -(-index.count() // merge_rows))
    dealt = index.repartitionByRange(ranges, "urlkey", "captured", "page_id", "file", "offset")
    in_page = F.col("page_id").isNull()
    slices = dealt.sortWithinPartitions("file", "urlkey", "captured", in_page, "page_id", "offset")
    return slices.mapInArrow(_merge, ENTRY)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as WARC archives, read them back, and return the merged index.

    One line per row: ``urlkey, captured, page_id, record_type, payload_digest, payload_bytes, refers_to, file,
    offset, length``. Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest
    ``page_id`` is a response and the others revisit it; smaller ones are all responses.

    A null ``html`` is an empty payload. A null url has no target header and an empty key. Rows of one group that
    share the smallest ``page_id`` are all responses; a null ``page_id`` revisits any known one, and is a response
    if there is none. Other columns are not read. An empty table gives an empty result. Archives are removed again;
    ``write_archives`` and ``read_archives`` keep them.
    """
    with Scratch(pages.sparkSession, "warc") as work:
        target = f"{work.path}/archives"
        write_archives(pages, target, min_bytes)
        index = work.keep(read_archives(pages.sparkSession, target))
        return stored(histories(index), "warc")
