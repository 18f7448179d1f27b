"""Byte-level BPE against the library and an exact round trip."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import byte_bpe
from quire.llm.registry import op13_byte_bpe
from tests.conftest import SMALL

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def replay():
    return byte_bpe.MergeReplay(PATH, PATTERN)


def lists(ids, sizes):
    ends = sizes.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabehinrst' .,!?\n\t0129éäßżя日本🙂̈"), max_size=60), min_size=1, max_size=40))
def test_equals_the_library(library, replay, texts):
    assert lists(*replay.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_runs_of_one_letter_and_forgotten_words(library, replay, monkeypatch):
    """Pairs that touch keep their order, also where a merge is applied to many positions at once."""
    texts = [c * n for c in ("a", "ab", "!", "..", " ", "日", "\n ") for n in range(1, 90)]
    for at_once in (1, 24):
        monkeypatch.setattr(byte_bpe, "AT_ONCE", at_once)
        replay.reset()
        assert lists(*replay.encode(texts)) == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    for _ in range(2):
        assert lists(*replay.encode(texts[:200])) == [library.encode_ordinary(t) for t in texts[:200]]


def test_segments_and_blocks(spark, docs, library, monkeypatch):
    """Texts longer than a segment or block, nulls, empty texts, repeated rows and ids, and no rows."""
    monkeypatch.setattr(byte_bpe, "SEGMENT", 50)
    long = "Worte und  Wörter,\n\n\tein Text's ohne Ende 12345 " * 40
    assert "".join(byte_bpe.segments_of(long)) == long
    assert [t for s in byte_bpe.segments_of(long) for t in library.encode_ordinary(s)] == library.encode_ordinary(long)
    rows = [(1, "one text"), (1, "one text"), (2, None), (3, ""), (None, "x" * 300_000), (4, "Ein Satz über\nalles. " * 250_000), (5, "end")]
    got = byte_bpe.round_trip(docs(rows), PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted(map(tuple, got.collect()), key=str) == sorted([want(*r) for r in rows], key=str)
    assert byte_bpe.round_trip(docs([]), PATH, PATTERN).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op13_byte_bpe(spark, SMALL).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_decode_null_and_unknown_ids(spark):
    t = spark.createDataFrame([([72, 73],), (None,), ([],)], "ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode_ids(t, PATH).collect()] == [byte_bpe._replay(PATH, "").bytes_of[72] + byte_bpe._replay(PATH, "").bytes_of[73], None, b""]
    with pytest.raises(Exception):  # noqa: B017  the worker's error reaches the driver as Spark's
        byte_bpe.decode_ids(spark.createDataFrame([([10**6],)], "ids array<int>"), PATH).collect()
