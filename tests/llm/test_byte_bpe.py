import hashlib
import random

import numpy as np
import pytest

from crowdspark.llm import byte_bpe
from crowdspark.llm.byte_bpe import boundaries, cut, decode_documents, encode_documents, pattern, vocabulary_path
from crowdspark.llm.queries import op12_byte_bpe


@pytest.fixture(scope="module")
def plain():
    """The library's own encoder on whole texts."""
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(vocabulary_path()),
                             special_tokens={})


def odd_texts(n, seed=2):
    rnd = random.Random(seed)
    parts = ["a", "bc", "'s", "'ll", "'", "''", " ", "  ", "\n", "\r\n", "\t", " ", "　", "é", "é", "日本語", "٣", "12", "½",
             "!", "...", "<|endoftext|>", "👩‍👩‍👧", "\x00", "\x1c", "the", " The"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


def test_boundaries_that_are_kept_are_those_of_the_whole_text():
    find = pattern().finditer
    for text in odd_texts(400):
        for start, own, last, piece in cut(text, 24, 10):
            assert piece == text[start:start + len(piece)] and (last == (start + len(piece) == len(text)))
            true = [m.end() for m in find(text, start)]
            opens, closes = boundaries(find, piece, last, own, 10)
            assert set(start + o for o in opens[1:]) <= set(true)
            assert set(start + c for c in closes) <= {e for e in true if not text[e - 1].isspace()}


@pytest.mark.parametrize("chunk, overlap", [(8, 4), (40, 12), (1 << 15, 1 << 10)])
def test_ids_of_whole_texts(spark, tmp_path, plain, chunk, overlap):
    texts = odd_texts(60, chunk) + [None, "", " ", "x" * 500, " " * 300, "\n\n" * 90 + "a", "a's" * 70, "日" * 200, ("ab " * 300)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    rows = decode_documents(encode_documents(spark.read.parquet(path), chunk=chunk, overlap=overlap)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(text), text
        assert bytes(r["decoded"]) == text.encode()


def test_hostile_rows(hostile, keyed, plain):
    for chunk in (64, byte_bpe.CHUNK):
        rows = decode_documents(encode_documents(hostile, chunk=chunk, overlap=32)).collect()
        got = sorted((r["row_key"], r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows if r["doc_id"] is not None)
        ids = {t: np.array(plain.encode_ordinary(t or ""), "<u4").tobytes() for _, t, _, _ in keyed.values()}
        assert got == sorted((k, i, ids[t], (t or "").encode()) for k, (i, t, _, _) in keyed.items() if i is not None)
        assert len(rows) == len(keyed)


def test_empty_table(empty):
    assert decode_documents(encode_documents(empty)).count() == 0


def test_long_pre_tokens(spark, tmp_path, plain):
    """One pre-token over many chunks: the chunks that it fills are joined."""
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(5000)), "w " * 50 + "x" * 3000 + " end" * 50, " " * 2000 + "a" + "\n" * 999 + "b"]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    for r in encode_documents(spark.read.parquet(path), chunk=100, overlap=20).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(texts[r["doc_id"]])


def test_query(spark, plain):
    rows = op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
