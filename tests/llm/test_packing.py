import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from crowdspark.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_path())


def test_chunks_give_the_ids_of_whole_texts(tokenizer):
    texts = ["", " ", "The cat, sat. don't I'LL we've", "a <|endoftext|>b <|startoftext|>. <|ENDOFTEXT|>",
             "\x1c\x1d a\x85b é é ́x ΑΣ Σ. İ", "日本 語、x y", f"{P.Encoder.MARK} a{P.Encoder.MARK}, b",
             "!!, .,. ,a. A. 1. 1,000.", "x" * 3000 + ". " + "y," * 500]
    rnd = random.Random(1)
    letters = "abcXYZ019.,!?'<|>é日 ́\t\n"
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(800)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encode = P.Encoder(P.tokenizer_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in encode.batch(texts)] == want
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == want


def test_a_full_memory_starts_again(monkeypatch, tokenizer):
    monkeypatch.setattr(P, "CACHE_BYTES", 5 * 220)
    encode = P.Encoder(P.tokenizer_path())
    for text in ("a b c d.", "e f g h a, b", "a b c d e f g h i j k"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_hostile_rows(hostile, keyed, tokenizer):
    rows = P.pack_documents(hostile, with_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["row_key"], []).append(r)
    assert by_doc.keys() == keyed.keys()
    for key, pieces in by_doc.items():
        doc_id, text, _, _ = keyed[key]
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [i for r in pieces for i in r["ids"]] == ids
        for r in pieces:
            assert r["doc_id"] == doc_id and r["start"] == 2048 * r["piece"] and r["length"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert all(r["length"] == 2048 for r in pieces[:-1])
    check_places(rows)


def check_places(rows):
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_seq)


def test_groups_stay_near_the_bound(spark, tmp_path):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, "a b " * rnd.choice([5, 60, 200, 400, 900])) for i in range(600)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    rows = P.pack_documents(spark.read.parquet(str(tmp_path / "d")), group_pieces=100).collect()
    bound = -(-sum(r["length"] for r in rows) // 2048)
    assert bound <= check_places(rows) <= 1.08 * bound + 1


def test_empty_table(empty):
    assert P.pack_documents(empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_local_search_only_improves(seed):
    rnd = random.Random(seed)
    sizes = np.array([rnd.choice([rnd.randint(1, 99), rnd.randint(30, 60), 34, 51]) for _ in range(150)])
    bins = [[i] for i in range(len(sizes))]                # the worst start: a bin for each
    for start in (bins, P.best_fit(sizes, 100)):
        before = sum(int(sizes[b].sum()) ** 2 for b in start)
        out = P.local_search(sizes, start, 100)
        fill = np.bincount(out, sizes)
        assert fill.max() <= 100 and (fill.astype(int) ** 2).sum() >= before
        assert (fill > 0).sum() <= len(start)
    assert (np.bincount(P.pack_group(sizes, 100), sizes) > 0).sum() <= len(P.best_fit(sizes, 100))


def test_swaps_empty_a_bin_that_best_fit_leaves():
    # 300 in bins of 100: the start needs four bins, exchanges must find three
    sizes = np.array([60, 50, 50, 40, 34, 33, 33])
    start = [[0, 4], [1, 5], [2, 6], [3]]
    fill = np.bincount(P.local_search(sizes, start, 100), sizes)
    assert (fill > 0).sum() == 3


def test_full_pieces_stand_alone():
    out = P.pack_group(np.array([2048, 5, 2048, 2043]), 2048)
    assert len(set(out.tolist())) == 3 and out[1] == out[3]


def test_the_search_goes_on_until_no_exchange_helps():
    # a hot group of equal lengths makes a third of the bins half full, and most of them hopeless
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(6.5, 0.3, 6000).astype(int), 300, 2047)
    sizes[:2000] = 1100

    def search(start):
        out = P.local_search(sizes, start, 2048)
        fill = np.bincount(out, sizes).astype(int)
        return [np.nonzero(out == b)[0].tolist() for b in np.nonzero(fill)[0]], (fill ** 2).sum()
    bins, squares = search(P.best_fit(sizes, 2048))
    again, squares_again = search(bins)
    assert (len(again), squares_again) == (len(bins), squares)


def test_long_distinct_chunks_are_remembered_up_to_a_bound():
    import random
    rnd = random.Random(8)
    own = P.Encoder(P.tokenizer_path())
    own.memory.limit = 200_000
    for _ in range(20):
        text = " ".join("".join(rnd.choice("abcd字") for _ in range(4000)) for _ in range(3))
        assert own(text) == P.Encoder(P.tokenizer_path())._ids([text])[0].tobytes()
        assert own.memory.held <= 200_000 and sum(map(len, own.known)) <= 200_000
