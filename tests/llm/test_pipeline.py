"""The stages of the corpus pipeline, each on its own input, against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = corpus_pipeline.COLUMNS


def prose(seed, words):
    letters = np.random.default_rng(seed).integers(0, 600, words)
    return " ".join(f"w{n}" for n in letters)


def rows_of(texts):
    return [(i, text, "en", ["a", "b", None][n % 3], None if text is None else len(text)) for n, (i, text) in enumerate(texts)]


SHARED = " ".join(f"shared{i}" for i in range(50))
TEXTS = [(i, prose(i, 40 + 7 * i)) for i in range(1, 31)]
TEXTS += [(40, TEXTS[3][1]), (41, TEXTS[3][1] + " tail"), (42, TEXTS[9][1].upper()), (43, None), (44, ""), (45, " \n"), (None, prose(90, 50))]
TEXTS += [(46, f"{prose(91, 30)} {SHARED} {prose(92, 30)}"), (47, f"{prose(93, 60)}\n{SHARED}"), (48, "few words"), (48, "few words"), (49, "x " * 9_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def test_near_duplicates(spark, docs):
    sets = [set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} - {()} for w in (words((t or "").lower()) for _, t in TEXTS)]
    ids = [i for i, _ in TEXTS]
    root = {i: i for i in ids if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if None not in (ids[a], ids[b]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(ids[a]), find(ids[b])))
                root[high] = low
    want = collections.Counter((i, t) for i, t in TEXTS if i is None or find(i) == i)
    kept = STAGES["near_dedup"](spark, docs, "")
    assert kept.columns == COLUMNS
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert len(TEXTS) - sum(want.values()) == 3


def test_repeated_passages(spark, docs):
    texts = [words(t) for _, t in TEXTS]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = collections.Counter()
    for (doc_id, text), w in zip(TEXTS, texts):
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id, left if gone else (text or "").encode()] += 1
    kept = STAGES["substring_dedup"](spark, docs, "").collect()
    got = collections.Counter()
    for r in kept:
        text = (r.text or "").encode()
        # the parts of a text that lost words keep their own white space
        got[r.doc_id, text if (r.doc_id, text) in want else b" ".join(words(r.text))] += 1
        assert r.n_chars is None or r.n_chars == len(r.text)
    assert got == want


def test_mixing(spark, docs):
    mixed = STAGES["mixing"](spark, docs, "")
    taken = collections.Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    had = collections.Counter((r[0], r[1], r[3]) for r in rows_of(TEXTS))
    assert mixed.columns == COLUMNS and set(taken) == set(had)
    assert all(had[row] <= n <= 2 * had[row] for row, n in taken.items())
    sizes = collections.Counter()
    for (_, text, source), n in had.items():
        sizes[source] += n * len(words(text))
    passes = {s: sum(n * len(words(t)) for (_, t, q), n in taken.items() if q == s) / sizes[s] for s in sizes}
    assert abs(min(passes.values()) - 1) < 0.01 and max(passes.values()) < 1.5 + max(len(words(t)) for _, t in TEXTS) / min(sizes.values())


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = collections.Counter()
    for doc_id, text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, piece, at, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())] += 1
    rows = STAGES["packing"](spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        ends = [offset + length for offset, length in sorted(parts)]
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


@pytest.fixture
def tables(spark, tmp_path):
    """Plain documents, and others with words that only toxic ones hold; labels for most of both."""

    def write(rows, labels):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_toxic_documents_and_the_whole_run(spark, tables):
    clean = [(i, prose(i, 60)) for i in range(200)]
    toxic = [(1_000 + i, prose(500 + i, 20) + " vile filth scum " * 4 + prose(800 + i, 10)) for i in range(60)]
    extra = [(None, prose(950, 60)), (2_000, None), (2_001, ""), (3, clean[3][1]), (2_002, clean[5][1])]
    labels = [(i, 1, 0) for i, _ in clean[:150]] + [(i, None, 1) for i, _ in toxic[:45]] + [(None, 1, 1), (7, 0, None)]
    place = tables(rows_of(clean + toxic + extra), labels)
    docs = spark.read.parquet(f"{place}/documents.parquet")
    kept = STAGES["toxicity"](spark, docs, place)
    assert kept.columns == COLUMNS
    texts = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts == collections.Counter(clean + extra)
    found = {r.doc_id for r in corpus_pipeline.run(spark, place).collect()}
    assert found == {i for i, _ in clean} | {None, 2_000, 2_001}


def test_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables([], [])).count() == 0
