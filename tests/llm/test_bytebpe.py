"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest

from gapweave.llm import bytebpe, queries

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "one", "It's  a\n\n test…\t ", "naïve café 北京大学。東京 안녕하세요", "😀👩‍👩‍👧 é​", "<|endoftext|> x", "a" * 3000,
    "don't WE'LL they've 12345six 7  8\r\n", "\x00\x1c\x85\xa0 x", "word " * 400 + "12ab.cd" * 50, "文字。" * 300,
]


@pytest.fixture(scope="module")
def file():
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def library(file):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=file[1], mergeable_ranks=bytebpe.read_ranks(file[0]), special_tokens={})


def test_ids_and_offsets(spark, file, library):
    rows = [*enumerate(TEXTS), (None, "null id"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, id string")
    got = sorted(bytebpe.encode(docs, *file).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["ids"]))
    want = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0], np.array(library.encode_ordinary(r[1]), "<u4").tobytes()))
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        ids = library.encode_ordinary(t)
        assert r["doc_id"] == i and np.frombuffer(r["ids"], "<u4").tolist() == ids
        for token, a, b in zip(ids, r["starts"], r["ends"], strict=True):
            assert library.decode_single_token_bytes(token) in t[a:b].encode()  # part of the characters it spans
    assert bytebpe.encode(docs.limit(0), *file).collect() == []


@pytest.mark.parametrize("most", [1, 7, 100])
def test_cuts_are_safe(file, library, most):
    random.seed(most)
    signs = " \n'.,!12abstEvé中。、、😀　\t"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 90))) for _ in range(400)]
    bpe = bytebpe.byte_bpe(*file)
    bpe.recent[True].clear()
    assert ["".join(bytebpe.runs(t, most)) for t in texts] == texts
    for t, (ids, at) in zip(texts, bpe.encode(texts, most=most), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)
        assert bpe.decode(ids).decode() == t and "".join(bpe.decode_tokens(ids)) == t
        assert len(at) == len(ids) and (not len(at) or at.max() == len(t))


def test_decoding_split_characters(spark, file):
    bpe = bytebpe.byte_bpe(*file)
    single = {b: i for i, b in bpe.bytes.items() if len(b) == 1}
    ids = np.array([single[bytes([b])] for b in "é".encode() + b"\xff" + "中".encode()[:2]], "<u4")
    assert bpe.decode_tokens(ids) == ["", "é", "�", "", "�"]
    rows = spark.createDataFrame([(ids.tobytes(),), (None,), (b"",)], "ids binary")
    assert {None if r[1] is None else bytes(r[1]) for r in bytebpe.decode(rows, *file).collect()} == {"é".encode() + b"\xff" + "中".encode()[:2], None, b""}
    with pytest.raises(ValueError):
        bytebpe.decode(rows.withColumnRenamed("ids", "decoded"), *file)


def test_words_that_are_tokens_stay_whole(tmp_path):
    import base64

    made = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"abcd"]  # abcd: no merge of two tokens gives it first
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(made)))
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=r"\w+|\W+", mergeable_ranks=bytebpe.read_ranks(str(path)), special_tokens={})
    bpe = bytebpe.ByteBpe(str(path), r"\w+|\W+")
    texts = ["abcd", "abc", "ab", "xabcd", "abcabcd", "bcab", "aabbcc dabc"]
    assert [x[0].tolist() for x in bpe.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_byte_bpe_encode_decode(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
