import hashlib
import math
import random
import re
import zlib

import pytest

from crowdspark.llm.queries import op13_resampling
from crowdspark.llm.resampling import crc32_all, resample


def test_crcs_of_all_lengths():
    rnd = random.Random(1)
    features = [rnd.randbytes(n) for n in [*range(200), 255, 256, 257, 1000, 4095, 4096, 4097, 100_000]] + [b"the", b"the", b"\0" * 70]
    rnd.shuffle(features)
    assert crc32_all(features).tolist() == [zlib.crc32(f) for f in features]
    assert crc32_all([]).tolist() == []


def brute(docs, target, buckets=10_000, least=1, most=1, least_words=20, share=10, seed=2024):
    """docs: (row_key, doc_id, text).  {row_key: (n_features, weight, score, rank)}"""
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[2] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    S, T = sum(s), sum(t)
    out, able = {}, []
    for key, doc_id, text in docs:
        f = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in f)
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[key] = [len(f), weight, score, None]
        if len(words(text)) >= least_words:
            able.append((-score, doc_id is None, doc_id or 0, key))
    for rank, (*_, key) in enumerate(sorted(able)[:share * len(able) // 100], 1):
        out[key][3] = rank
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("most", [1, 2])
def test_hostile_rows(spark, hostile, keyed, most):
    aims = ["the cat SAT", None, "", "häuser 日本 x1", "mat mat mat"]
    target = spark.createDataFrame([(t,) for t in aims], "text string")
    docs = [(k, i, t) for k, (i, t, _, _) in keyed.items()]
    for share in (10, 100):
        got = {r["row_key"]: (r["n_features"], r["weight"], r["score"], r["rank"])
               for r in resample(hostile, target, most=most, share=share).collect()}
        assert got == brute(docs, aims, most=most, share=share)


def test_ties_go_to_the_smaller_id(spark, tmp_path):
    # one id many times: equal scores, ranked once each
    rows = [(7, "a " * 20)] * 30 + [(8, "a " * 19)] * 5
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = resample(spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([("a",)], "text string"), share=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16))
    assert all(r["doc_id"] == 7 for r in got if r["rank"])


def test_empty_tables(spark, empty, hostile, keyed):
    none = spark.createDataFrame([], "text string")
    assert resample(empty, none).count() == 0
    got = {r["row_key"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample(hostile, none).collect()}
    assert got == brute([(k, i, t) for k, (i, t, _, _) in keyed.items()], [])


def test_query(spark):
    at = "/root/testdata/sf0.001"
    docs = [(i, r["doc_id"], r["text"]) for i, r in enumerate(spark.read.parquet(f"{at}/documents.parquet").collect())]
    aims = [r["text"] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    want = {docs[k][1]: v for k, v in brute(docs, aims).items()}
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in op13_resampling(spark, at).collect()}
    assert got == want
