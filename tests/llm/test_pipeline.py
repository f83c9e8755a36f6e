"""run() against a brute-force version of each stage, and every stage on hostile rows."""

import hashlib
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crowdspark.llm import langid
from crowdspark.llm.packing import tokenizer_path

from ..conftest import SF001
from .test_mixing import water_fill
from .test_packing import check_places
from .test_simhash import components, slow_fingerprint


def brute_exact(docs):
    keep = {}
    for d in docs:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", d["text"] or "")
        if body not in keep or (d["doc_id"] is None, d["doc_id"] or 0) < (keep[body]["doc_id"] is None, keep[body]["doc_id"] or 0):
            keep[body] = d
    return list(keep.values())


def brute_near(docs):
    fp = [slow_fingerprint(d["text"]) for d in docs]
    pairs = [(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if (fp[a] ^ fp[b]).bit_count() <= 4]
    root = components(pairs, range(len(docs)))
    least = {}
    for i, d in enumerate(docs):
        rank = (d["doc_id"] is None, d["doc_id"] or 0, i)
        least[root[i]] = min(least.get(root[i], rank), rank)
    return [docs[rank[2]] for rank in least.values()]


def brute_mix(docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs]
    per = {}
    for d, n in zip(docs, size):
        per[d["source"]] = per.get(d["source"], 0) + n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    target = water_fill(per, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(per.values()), 2)
    out = []
    for s in order:
        own = [(hashlib.md5("/".join(["17", *([str(d["doc_id"])] if d["doc_id"] is not None else []), d["text"] or ""]).encode()
                            ).hexdigest(), d, n) for d, n in zip(docs, size) if d["source"] == s]
        epochs = math.floor(target[s] / per[s]) if per[s] else 0
        left = math.floor(target[s] - epochs * per[s] + 0.5)
        for _, d, n in sorted(own, key=lambda x: x[0]):
            part = max(0, min(left, n))
            left -= part
            out += [d["text"]] * (epochs if n else 0)
            if part == n and n:
                out.append(d["text"])
            elif part:
                out.append(" ".join(re.findall(r"[^\x20\x09-\x0D]+", d["text"])[:part]))
    return out


def stage(spark, tmp, name, docs):
    path = os.path.join(str(tmp), name)
    dict(corpus_pipeline.STAGES)[name](spark, docs, SF001).write.parquet(path)
    return spark.read.parquet(path)


def key(d):
    return (d["doc_id"] is None, d["doc_id"] or 0, d["text"] or "", d["source"] or "")


@pytest.mark.parametrize("which", ["table", "hostile"])
def test_stages_against_brute_force(spark, tmp_path, hostile, which):
    docs = spark.read.parquet(f"{SF001}/documents.parquet") if which == "table" else hostile
    model = langid.Scorer(langid.fit(docs))
    want = [d.asDict() for d in docs.collect()]

    def good(d):
        lang, score = model.predict(d["text"])
        return lang != "und" and score >= 0.5

    want = [d for d in want if good(d)]
    got = stage(spark, tmp_path, "language", docs)
    assert got.schema == docs.schema
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    for name, brute in (("exact", brute_exact), ("near", brute_near)):
        want = brute(want)
        got = stage(spark, tmp_path, name, got)
        assert got.columns == docs.columns
        assert sorted(map(key, got.collect())) == sorted(map(key, want))
    texts = brute_mix(want)
    got = stage(spark, tmp_path, "mix", got)
    assert got.columns == docs.columns
    assert sorted(r["text"] for r in got.collect()) == sorted(texts)
    rows = stage(spark, tmp_path, "pack", got).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    lengths = [len(e.ids) + 1 for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sum(r["length"] for r in rows) == sum(lengths)
    assert len(rows) == sum(-(-n // 2048) for n in lengths)
    bound = -(-sum(lengths) // 2048)
    assert bound <= check_places(rows) <= 1.05 * bound + 1


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        docs = stage(spark, tmp_path, name, docs)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == docs.columns
    assert sorted(got.select(columns).collect()) == sorted(docs.select(columns).collect())


def test_empty_documents(spark, tmp_path, empty):
    docs = empty
    for name, _ in corpus_pipeline.STAGES:
        docs = stage(spark, tmp_path, name, docs)
        assert docs.collect() == []


def test_clean_documents_survive_language_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, SF001).count() == docs.count()


def test_without_a_language_to_learn_only_texts_without_letters_go(spark, hostile, keyed):
    none = hostile.withColumn("lang", F.lit(None).cast("string"))
    kept = [r["text"] for r in corpus_pipeline.language(spark, none, "").collect()]
    want = [t for _, t, _, _ in keyed.values() if any(c.isalpha() for c in t or "")]
    assert sorted(kept) == sorted(want) and len(want) > 100
