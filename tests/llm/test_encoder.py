"""Ids of texts by words and chunks: the same as those of the whole tokenizer, which few chunks need."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from lakekit.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "H̱ T̈ J̌ İ É é İ K ẖ ÅÅ",
    "<|ENDOFTEXT|> <|endoftext|> A<|endoftext|>B <|StartOfText|>, x",
    "it's IT'S 'tis don't, DON'T. rock'n'roll' 'S 's, l'Été",
    "abc,. ABC... a×b c÷d, µg ª1 x2 3y, ÀÉßÿ! «Ça» ß×, naïve;",
    "a b 　c  ͅx ä́ ﬁn Ǆ ΣΣ ẞ, \U0001f600a a\U0001f600,",
    "_ABC_ ABC_ a_b A-B C- --- -a $A A$ a\x00B \x1cA\x85b\tC\nD\x0bE",
    "",
    "  \n ",
]


WHOLE = Tokenizer.from_file(PATH)


def whole(texts):
    return [WHOLE.encode(text, add_special_tokens=False).ids for text in texts]


def encoded(encoder, texts):
    rows = [np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8) for text in texts]
    return [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(iter(rows))]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


def test_odd_texts(encoder):
    assert encoded(encoder, ODD) == whole(ODD)


pieces = st.sampled_from(
    ["A", "b", "Qu", "the", "THE", "É", "ï", "ß", "×", "̱", "́", "'", "'S", "ll", ",", ".", "!?", "<|", "|>"]
    + ["endoftext", "EndOfText", "<|endoftext|>", "7", "٣", "µ", "İ", "K", " ", "\n", " ", "中", "«"]
)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.lists(pieces, max_size=12).map("".join), st.text(max_size=12)), min_size=1, max_size=8))
def test_like_the_whole_tokenizer(encoder, texts):
    assert encoded(encoder, texts) == whole(texts)


def test_texts_in_many_groups(monkeypatch):
    for name, value in (("_BYTES_AT_ONCE", 20), ("_JOINED_CHUNKS", 3), ("_CACHED_CHUNKS", 5)):
        monkeypatch.setattr(tokens, name, value)
    texts = [*ODD, *"One two, ONE three; two. Four one, five! six seven eight nine ten Four".split(), *ODD]
    assert encoded(tokens.Encoder(PATH), texts) == whole(texts)


def test_bytes_that_are_no_text(encoder):
    assert encoded(encoder, [b"abc \xc3 \x80\x81, d\xffe Fgh"]) == whole(["abc � ��, d�e Fgh"])


def test_words_go_to_the_model_alone(monkeypatch):
    whole_tokenizer = tokens.Encoder._learn
    passed = []
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, chunks: passed.extend(chunks) or whole_tokenizer(self, chunks))
    texts = ["Zorbleth zorbleth, ZORBLETH! Zorbléth. a1 'tis"]
    assert encoded(tokens.Encoder(PATH), texts) == whole(texts)
    assert sorted(passed) == [b"!", b"'tis", b",", b".", b"a1"]


def test_added_tokens_inside_words(tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.add_tokens([AddedToken("orble", normalized=False)])
    tokenizer.save(str(tmp_path / "added.json"))
    encoder = tokens.Encoder(str(tmp_path / "added.json"))
    text = "Zorbleth orble, ORBLE!"
    assert encoded(encoder, [text]) == [tokenizer.encode(text, add_special_tokens=False).ids]


def test_pieces_of_words(monkeypatch):
    passed, learn = [], tokens.Encoder._learn
    monkeypatch.setattr(tokens, "_encoders", {})
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, chunks: passed.extend(chunks) or learn(self, chunks))
    texts = ["Quorbith quorbith, QUORBITH; wexl\u00f6r", None, "b2 Wexl\u00f6r."]
    batch = pa.record_batch([pa.array([5, 6, None], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [row for out in tokens.pieces(PATH, 1, 4)(iter([batch])) for row in out.to_pylist()]
    wanted = []
    for doc_id, ids in zip([5, 6, None], whole([text or "" for text in texts])):
        ids = np.asarray([*ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4)):
            part = ids[start : start + 4]
            wanted.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert [tuple(row.values()) for row in got] == wanted
    assert sorted(passed) == [b",", b".", b";", b"b2"]


@pytest.mark.parametrize("cached", [6, 600_000])
def test_few_chunks_stay_after_a_task(monkeypatch, cached):
    monkeypatch.setattr(tokens, "_KEPT_CHUNKS", 3, raising=False)
    monkeypatch.setattr(tokens, "_CACHED_CHUNKS", cached)
    monkeypatch.setattr(tokens, "_BYTES_AT_ONCE", 20)
    monkeypatch.setattr(tokens, "_encoders", {})
    texts = [*ODD, "the quick brown fox jumps over the lazy dog, again and again", None]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    for _ in range(2):
        found = [np.frombuffer(ids, "<u4").tolist() for _, rows in tokens.encoded_batches(iter([batch, batch]), PATH, 2) for ids in rows]
        assert found == 2 * [ids + [2] for ids in whole([text or "" for text in texts])]
        encoder = tokens.encoder_of(PATH)
        assert encoder.chunks and len(encoder.chunks) <= 3 and not encoder.older
