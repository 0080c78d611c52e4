"""Each query of the dealt operators against brute force over the whole of the smallest tables."""

import base64
import collections
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakekit.llm import permutation, queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table():
    def read(name):
        return duckdb.connect().execute(f"SELECT * FROM '{TABLES}/{name}.parquet'").fetchall()

    return read


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.QUERIES[name](spark, TABLES).collect()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def linked_components(sets, percent):
    """Smallest id reachable over links, all pairs compared."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_quality_rules(run, table):
    want = {}
    for doc_id, text, *_ in table("documents"):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        twice = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        n = len(words)
        failed = n < 50 or 100 * len(twice) > 50 * n
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        want[doc_id] = (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(twice), failed)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in run("op1_quality_rules")}
    assert got == want


def test_minhash_near_dedup(run, table):
    sets = {}
    for doc_id, text, *_ in table("documents"):
        words = WORD.findall(lowered(text))
        sets[doc_id] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    want = linked_components(sets, 85)
    rows = run("op2_minhash_near_dedup")
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len(set(want.values())) < len(want)


def encoded(table, end_id):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    docs = sorted((row[0], row[1]) for row in table("documents"))
    return [(i, tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]) for i, text in docs]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_token_planes(run, table):
    want, start = {}, 0
    for doc_id, ids in encoded(table, 2):
        want[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run("op3_token_planes")} == want


def test_permutation_index(run, table):
    rows = table("embeddings")
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=np.float64)
    found = collections.defaultdict(list)
    for r in run("op4_permutation_index"):
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits, wanted = 0, 0
    by_id = {i: v for i, v in zip(ids.tolist(), vectors)}
    for query in ids[ids % 20 == 0].tolist():
        scores = vectors @ by_id[query]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != query][:20]
        got = sorted(found[query])
        assert [rank for rank, *_ in got] == list(range(1, 21))
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        assert all(abs(s - by_id[v] @ by_id[query]) < 1e-12 and v != query for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(order))
        wanted += 20
    assert hits / wanted >= 0.9


def recall(vectors, found, is_query, k=20):
    """The share of the true nearest that are among the found ones, over all queries, and for the worst of them."""
    ids = np.array([r.vec_id for r in vectors])
    table = np.array([r.embedding for r in vectors], dtype=np.float64)
    got = collections.defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    shares = []
    for at in np.flatnonzero(is_query(ids)):
        scores = table @ table[at]
        order = [int(ids[i]) for i in np.lexsort((ids, -scores)) if i != at][:k]
        shares.append(len(got[int(ids[at])].intersection(order)) / k)
    return np.mean(shares), min(shares)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_permutation_index_finds_nine_in_ten(spark, scale):
    vectors = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").collect()
    found = queries.QUERIES["op4_permutation_index"](spark, f"/root/testdata/{scale}").collect()
    assert recall(vectors, found, lambda ids: ids % 20 == 0)[0] >= 0.9


def test_permutation_index_over_several_blocks(spark, monkeypatch):
    """The share is fitted on a part of the rows, by queries that are no pivots, and holds over blocks."""
    monkeypatch.setattr(permutation, "BLOCK_ROWS", 700)
    monkeypatch.setattr(permutation, "BLOCK_QUERIES", 60)
    monkeypatch.setattr(permutation, "SAMPLE_ROWS", 1_200)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = permutation.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert recall(table.collect(), found, lambda ids: ids % 20 == 0)[0] >= 0.9
    index = permutation.fit(permutation.usable(table), 20)
    assert 0.94 <= index.sample_recall <= 1


def test_url_filters(run, table):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    rows = {r.page_id: r for r in run("op5_url_filters")}
    for page_id, url, _ in table("pages"):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            raw = re.match("[^/?#]*", rest)[0]
            host, path = lowered(raw), re.match("[^?#]*", rest[len(raw) :])[0]
        fitting = []
        for verdict, pattern in rules:
            name, _, start = pattern.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fitting.append((len(pattern), pattern, verdict))
        rule, verdict = max(fitting)[1:] if fitting else (None, None)
        row = rows[page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


def test_best_fit_packing(run, table):
    want = {}
    for doc_id, ids in encoded(table, 1):
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, piece] = (at, len(part), crc(part))
    rows = run("op6_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(length for _, length, _ in want.values())
    assert len(sequences) <= -(-total // 4096) + 1


def test_substring_dedup(run, table):
    words = {row[0]: (row[1] or "").encode().split() for row in table("documents")}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for doc_id, w in words.items():
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert any(n for _, n, _ in want.values())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run("op7_substring_dedup")} == want


def test_temperature_mixing(run, table):
    rows = run("op8_temperature_mixing")
    docs = {row[0]: (row[3], len(WORD.findall(row[1] or ""))) for row in table("documents")}
    have, taken = collections.Counter(), collections.Counter()
    for source, n in docs.values():
        have[source] += n
    for r in rows:
        taken[r.source] += docs[r.doc_id][1]
        assert r.source == docs[r.doc_id][0]
    weight = {r.source: r.weight for r in rows}
    assert abs(sum(weight.values()) - 1) < 1e-9
    longest = max(n for _, n in docs.values())
    scale = max(have[s] / weight[s] for s in have)
    assert all(weight[s] * scale - longest <= taken[s] <= weight[s] * scale + 1 for s in have)
    assert {r.doc_id for r in rows} == set(docs)
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)


def test_warc(run, table):
    pages = {row[0]: (row[2] or "").encode() for row in table("pages")}
    first = {}
    for page_id in sorted(pages):
        first.setdefault(pages[page_id], page_id)
    rows = run("op9_warc")
    assert len(rows) == len(pages)
    for r in rows:
        payload = pages[r.page_id]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = first[payload] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[payload]))
    assert [(r.urlkey, r.captured) for r in rows] == sorted((r.urlkey, r.captured) for r in rows)


def test_toxicity(run, table):
    rows = {r.doc_id: r for r in run("op10_toxicity")}
    assert set(rows) == {row[0] for row in table("documents")}
    assert all(abs(sum(r.above) - r.expected_severity) < 1e-12 for r in rows.values())
