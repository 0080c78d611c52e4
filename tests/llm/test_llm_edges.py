"""Nulls, empty texts and tables, repeated rows and clashing columns, for each operator."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakekit.llm import hashing, minhash, mixing, packing, permutation, quality, queries, substring, tokens, toxicity, urls, warc

LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [(1, LONG), (2, LONG), (2, LONG), (None, "a b c"), (3, None), (4, ""), (5, " \n\t"), (6, "x " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "src", "p", 1, 2, 3) for i, text in DOCS]
    schema = "doc_id long, text string, source string, hash_a string, node int, first int, twin int"
    return spark.createDataFrame(rows, schema)


def test_documents(docs):
    ledger = quality.ledger(docs)
    assert ledger.count() == len(DOCS)
    assert {r.n_words for r in ledger.filter("doc_id in (3, 4, 5)").collect()} == {0}
    report = {r.rule: r for r in quality.ablations(ledger, [quality.BASE]).collect()}
    assert report["few_words"].documents == len(DOCS) and report["few_words"].failing == 4

    near = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(near) == len(DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near} == {
        1: (58, 1, True), 2: (58, 1, False), None: (1, None, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True)
    }

    cut = {(r.doc_id, r.n_words): r.n_removed for r in substring.without_repeats(docs).collect()}
    assert cut[1, 60] == cut[2, 60] == 60 and cut[6, 30_000] == 30_000 and cut[None, 3] == 0 and cut[3, 0] == 0
    kept = substring.cut_texts(docs)
    assert kept.schema == docs.schema and kept.count() == len(DOCS)

    assert mixing.mixed(docs, max_repeats=2.0).columns == docs.columns
    packed = packing.pack_documents(docs, queries.TOKENIZER, 1).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in DOCS}
    assert toxicity.severities(docs, None).count() == len(DOCS)


def test_no_rows(spark, docs):
    none = docs.limit(0)
    assert quality.ledger(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert substring.without_repeats(none).count() == 0
    assert mixing.mixed(none, max_repeats=2.0).count() == 0
    assert packing.pack_documents(none, queries.TOKENIZER, 1).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, queries.URL_RULES).count() == 0
    assert warc.archive(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert permutation.nearest(vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_pages(spark):
    rows = [(1, "http://A.org/x", "same"), (2, None, "same"), (3, "no scheme", None), (None, "http://b.com/", "same"), (4, "http://c.de\r\nX: y", "WARC/1.1\r\n\r\nx")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(pages).collect()}
    assert found == {1: ("response", None, 4), 2: ("revisit", 1, 4), 3: ("response", None, 0), None: ("revisit", 1, 4), 4: ("response", None, 13)}
    judged = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert judged[1] == ("a.org", "/x", "org/") and judged[2] == judged[3] == ("", "", None)


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [2.0, None]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = permutation.nearest(vectors, F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 5, 1.0), (0, 2, 6, 1.0)]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("ids", [[], [0], [1, 65_535, 7], [65_536, 3, 2**31]])
def test_planes_round_trip(bits, ids):
    ids = np.asarray(ids, dtype="<u4")
    assert np.array_equal(tokens.from_planes(tokens.to_planes(ids, bits), len(ids), bits), ids)


def test_loser_tree():
    line = lambda key: (key, "t", 1, "", "", 0, None, "f", 0, 1)
    runs = [[line(k) for k in keys] for keys in ("adg", "", "bbz", "c")]
    assert "".join(each[0] for each in warc.LoserTree(runs)) == "abbcdgz"


def regular_words(size=1_024):
    """Two different words that polynomials modulo 2**64 cannot tell apart: bit parities of places, and the opposite."""
    return tuple("".join("ab"[(i.bit_count() + turn) % 2] for i in range(size)) for turn in (0, 1))


def test_regular_words_and_windows_are_told_apart():
    one, other = regular_words()
    for which in (0, 1):
        data = np.frombuffer(f"{one} {other} {one}".encode(), np.uint8)
        words = hashing.word_hashes(data, *hashing.word_spans(data), which)
        assert words[0] == words[2] != words[1]
        pattern = np.array([i.bit_count() % 2 for i in range(2_048)])
        texts = [words[:2][pattern], words[:2][1 - pattern]]
        assert hashing.window_hashes(texts[0], 2_048, which)[0] != hashing.window_hashes(texts[1], 2_048, which)[0]


@pytest.mark.parametrize("length", [1, 2, 3, 5, 18, 35, 64])
def test_equal_windows_have_equal_hashes(length):
    words = np.random.default_rng(length).integers(0, 3, 400).astype(np.uint64)
    found = hashing.window_hashes(words, length)
    assert len(found) == 400 - length + 1
    for (i, a), (j, b) in itertools.combinations(enumerate(found.tolist()), 2):
        assert (a == b) == (words[i : i + length].tolist() == words[j : j + length].tolist())


def test_regular_words_are_no_copies(spark):
    one, other = regular_words()
    docs = spark.createDataFrame([(1, f"q {one}"), (2, f"q {other}")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in minhash.near_duplicates(docs, 3, 85).collect()} == {1: True, 2: True}
    start = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.without_repeats(docs).collect()] == [0, 0]


@pytest.mark.parametrize("turn", [False, True])
def test_one_id_with_several_texts_keeps_all_links(spark, turn):
    """Each text of an id has its own links, whatever the order of the rows; together they join what they link."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(10, a), (20, b), (7, a + " more"), (7, b + " more"), (30, "something else than the others are"), (7, None)]
    docs = spark.createDataFrame(rows[::-1] if turn else rows, "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert found == {(10, 7, False), (20, 7, False), (7, 7, True), (30, 30, True)}
    chain = [(1, a), (5, a), (5, b), (9, b), (9, "one more text of this id"), (12, "one more text of this id")]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()} == {1}


def test_rows_whose_texts_hash_alike_are_told_apart(spark):
    """Rows without an id whose 32-bit text hashes agree, one of them repeated elsewhere."""
    seen, pair = {}, None
    words = [f"w{i}" for i in range(36)]
    texts = spark.range(400_000).select(F.concat_ws(" ", F.lit(" ".join(words[:35])), F.concat(F.lit("x"), "id")).alias("t"), "id")
    for row in texts.select(F.hash("t").alias("h"), "id").toLocalIterator():
        if row.h in seen:
            pair = (seen[row.h], row.id)
            break
        seen[row.h] = row.id
    assert pair
    one, other = (" ".join([*words[:35], f"x{i}"]) for i in pair)
    docs = spark.createDataFrame([(None, one), (None, other)], "doc_id long, text string")
    keys = substring.keyed(docs).select("doc_id", "twin").collect()
    assert keys[0].twin == keys[1].twin and keys[0].doc_id != keys[1].doc_id


def test_ids_of_odd_rows(spark, tmp_path):
    """Null, empty and repeated rows, rows without an id and one id for a third of them; no rows at all."""
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, ""), (1, "x"), (1, "y z"), *[(2, f"text {i % 5}") for i in range(30)]]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, segment string")
    tokens.write_ids(docs.repartition(4), str(tmp_path / "t"), queries.TOKENIZER, end_id=2)
    read = tokens.read_ids(spark, str(tmp_path / "t")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in read) == sorted((i is not None, i or 0) for i, _ in rows)
    placed = sorted(read, key=lambda r: r.start)
    assert [r.start for r in placed] == [sum(p.n_tokens for p in placed[:i]) for i in range(len(placed))]
    assert [r.doc_id or 0 for r in placed] == sorted(r.doc_id or 0 for r in read)
    assert min(r.n_tokens for r in read) == 1
    tokens.write_ids(docs.limit(0), str(tmp_path / "none"), queries.TOKENIZER, end_id=2)
    assert tokens.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_rows_of_one_id_are_ranged_over_shards(spark):
    rows = spark.range(0, 4_000, 1, 8).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1_000).alias("text"))
    turn, part = F.xxhash64("text"), F.spark_partition_id()
    ranged = rows.select("*", turn.alias("turn"), part.alias("part")).repartitionByRange(8, "doc_id", "turn", "part")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1_000


def test_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 10).collect()
    assert sorted((r.doc_id, r.label, r.text) for r in rows) == [(1, 1, "text 0"), (2, 0, None)]


def test_exponents_reach_targets_on_both_sides(spark):
    sources = spark.createDataFrame([("a", 800, 1000), ("b", 120, 1000), ("c", 50, 1000), ("d", 30, 1000)], "source string, tokens long, all_tokens long")
    for target in (0.9, 0.3, 0.1):
        exponent = mixing.find_exponent(sources, target, None)
        assert abs(mixing.entropy(sources, exponent) - target * np.log(4)) < 1e-5 and (exponent > 1) == (target < 0.5)
    equal = spark.createDataFrame([("a", 5, 10), ("b", 5, 10)], "source string, tokens long, all_tokens long")
    with pytest.warns(UserWarning, match="no exponent"):
        assert mixing.find_exponent(equal, 0.5, None) == 1
    limited = mixing.find_exponent(sources, 0.1, 3.0)
    assert 1 < limited < mixing.find_exponent(sources, 0.1, None) and abs(mixing.repetition(sources, limited) - 3) < 1e-4
