"""Alignment of two tokenizers against a plain pass over every text, and its perfect hash."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lakekit.llm import alignment, queries

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return alignment.Vocabularies(A_FILE, B_FILE, RANKS, public_tokenizers.PATTERN)


def plain(known, text):
    """Tokens as (id, first byte, past the end) of both sides, or none."""
    if not text:
        return [], []
    a = known.a.encode(" " + text, add_special_tokens=False).ids
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE).encode(text)
    sides = []
    for ids, table in ((a, known.a_bytes), (b, known.b_bytes)):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        sides.append(tokens)
    return sides


def brute(known, docs):
    """Result rows by comparing every A token with the B tokens beside it."""
    linked, groups = [], []
    for _, text in docs:
        a, b = plain(known, text)
        linked.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, begin = [], 0
        for end in ends:
            inside = [",".join(str(t[0]) for t in side if begin <= t[1] and t[2] <= end) for side in (a, b)]
            parts.append("|".join(inside))
            begin = end
        groups.append((len(a), len(b), len(parts), ";".join(parts)))
    counts = collections.Counter(pair for links in linked for pair in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        (doc_id if doc_id is not None else -1, n_a, n_b, n, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), text)
        for (doc_id, _), links, (n_a, n_b, n, text) in zip(docs, linked, groups)
    )


def found(df):
    return sorted(
        (r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
        for r in df.collect()
    )


TEXTS = [
    (1, "The quick brown fox, déjà vu — naïve."),
    (2, "The quick brown fox, déjà vu — naïve."),
    (2, "Another text under the same id"),
    (None, "no id here"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "\n\n\tfn main() { println!(\"<|endoftext|>\"); }\r\n"),
    (7, "already ▁ marked"),
    (8, "日本語 🙂 and ½ ﬁ"),
    (9, "<0x41> <s> </s> <unk>"),
    (10, "x" * 3_000),
    (11, "ab " * 2_000),
]


def test_small_corpus(spark, known):
    docs = spark.createDataFrame(
        [(i, text, 1, 2, "p") for i, text in TEXTS], "doc_id long, text string, block int, kind int, pairs string"
    )
    want = brute(known, TEXTS)
    assert found(alignment.align(docs, A_FILE, B_FILE, RANKS, public_tokenizers.PATTERN)) == want
    assert found(alignment.align(docs.repartition(5), A_FILE, B_FILE)) == want
    assert alignment.align(docs.limit(0), A_FILE, B_FILE).count() == 0
    assert {r.n_a for r in alignment.align(docs.filter("doc_id in (3, 4)"), A_FILE, B_FILE).collect()} == {0}


def test_many_blocks(spark, known, monkeypatch):
    """Several rounds of the trees: blocks of a few documents, three parts to a round."""
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    docs = [(i, f"text {i % 7} of many, number {i}") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(23)
    assert found(alignment.align(df, A_FILE, B_FILE)) == brute(known, docs)


def test_query(spark, known):
    table = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows]
    got = {r.doc_id: r for r in queries.QUERIES["op12_token_alignment"](spark, table).collect()}
    counts, links = collections.Counter(), {}
    for doc_id, text in short:
        a, b = plain(known, text)
        pairs, j = [], 0
        for x in a:
            while j and b[j][1] > x[1]:
                j -= 1
            while b[j][2] <= x[1]:
                j += 1
            k = j
            while k < len(b) and b[k][1] < x[2]:
                pairs.append((x[0], b[k][0]))
                k += 1
        links[doc_id] = (len(a), len(b), pairs)
        counts.update(set(pairs))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    assert len(got) == len(short)
    for doc_id, (n_a, n_b, pairs) in links.items():
        row = got[doc_id]
        assert (row.n_a, row.n_b, row.n_links) == (n_a, n_b, len(pairs))
        assert row.n_best == sum(counts[p] == best[p[0]] for p in pairs)
        assert row.count_sum == sum(counts[p] for p in pairs)
        assert len(row.groups_sha256) == (64 if n_a else 0)


def test_digest_of_groups(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    aligned = {r.doc_id: r.groups for r in alignment.align(docs, A_FILE, B_FILE).collect()}
    digests = {r.doc_id: r.groups_sha256 for r in alignment.align(docs, A_FILE, B_FILE, derive=queries.alignment_digests).collect()}
    assert digests == {1: hashlib.sha256(aligned[1].encode()).hexdigest(), 2: ""}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_quick_library_gives_the_same_ids(text):
    known = _known()
    assert known.encode_a(text) == known.a.encode(text, add_special_tokens=False).ids


def _known(cache=[]):  # noqa: B006
    if not cache:
        cache.append(alignment.Vocabularies(A_FILE, B_FILE, RANKS, public_tokenizers.PATTERN))
    return cache[0]


def test_quick_library_on_all_texts(spark):
    known = _known()
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        text = " " + (row.text or "")
        assert known.encode_a(text) == known.a.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n))
    made = alignment.PerfectHash.build(keys)
    again = alignment.PerfectHash.unpacked(made.packed())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1_000), keys)
    place = again.index(others)
    kept = np.empty_like(keys)
    kept[made.index(keys)] = keys
    assert all(p < 0 or kept[p] != o for p, o in zip(place.tolist(), others.tolist()))
