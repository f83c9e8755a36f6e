import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from crowdspark.llm.lm import (BUCKETS, END, WordKeys, _answer_pass, _bytes, _request_pass, bucket, fit_weights,
                               score_documents, token_keys)


def role(doc_id):
    rest = None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7
    return "held" if rest in (None, 2) else "deleted" if rest == 4 else "fit"


def brute(keyed):
    """Scores by plain counting and the same EM over single tokens."""
    tokens = {k: [*re.findall(rb"[^\x20\x09-\x0D]+", (v[1] or "").encode().lower()), None] for k, v in keyed.items()}
    roles = {k: role(v[0]) for k, v in keyed.items()}

    def counts(which):
        one, two = Counter(), Counter()
        for k, t in tokens.items():
            if roles[k] in which:
                one.update(t)
                two.update(zip([None, *t[:-1]], t))
        return one, two
    one, two = counts(("fit",))
    n_fit = sum(one.values())
    all_one, all_two = counts(("fit", "deleted"))
    n, v = sum(all_one.values()), len(all_one)
    p0 = 1 / (v + 1)
    level = lambda c: c.bit_length()
    weights = {b: (0.5, 0.0, 0.5) if b == 0 else (1 / 3, 1 / 3, 1 / 3) for b in range(BUCKETS)}
    held = [(level(one[h]), one[w] / max(n_fit, 1), two[h, w] / max(one[h], 1)) for k, t in tokens.items()
            if roles[k] == "deleted" for h, w in zip([None, *t[:-1]], t)]
    for _ in range(30):
        sums = {}
        for b, p1, p2 in held:
            a = [x * y for x, y in zip(weights[b], (p1, p2, p0))]
            own = sums.setdefault(b, [0.0, 0.0, 0.0])
            for i in range(3):
                own[i] += a[i] / sum(a)
        new = weights | {b: tuple(x / sum(s) for x in s) for b, s in sums.items()}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b]))
        weights = new
        if moved <= 1e-6:
            break
    out = {}
    for k, t in tokens.items():
        score = 0.0
        for h, w in zip([None, *t[:-1]], t):
            l1, l2, l0 = weights[level(all_one[h])]
            score += math.log10(l1 * all_one[w] / max(n, 1) + l2 * all_two[h, w] / max(all_one[h], 1) + l0 * p0)
        out[k] = (roles[k] == "held", len(t), sum(all_one[w] > 0 for w in t), n,
                  sum(math.log10((all_one[w] + 1) / (n + v + 1)) for w in t), score)
    return out


def test_hostile_rows_against_plain_counting(hostile, keyed):
    got = {r["row_key"]: r for r in score_documents(hostile).collect()}
    want = brute(keyed)
    assert got.keys() == want.keys()
    for k, (held, n, known, train, base, score) in want.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_empty_table(empty):
    assert score_documents(empty).collect() == []


def test_flushes_and_chunks_ask_for_the_same_totals(monkeypatch):
    from crowdspark.llm import lm
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"chunk": [1, 1, 2], "role": [0, 1, 0], "text": ["a b a", "a c", "a"]},
                                       schema=pa.schema([("chunk", pa.int64()), ("role", pa.int32()), ("text", pa.string())]))
    for flush in (1, 100):
        monkeypatch.setattr(lm, "FLUSH_TOKENS", flush)
        asked = [b for b in _request_pass(1)(iter([batch]))]
        rows = [r for b in _answer_pass(iter(asked)) for r in b.to_pylist()]
        total = [r for r in rows if r["chunk"] is None]
        assert [(r["known"], r["n_fit"], r["n_deleted"]) for r in total] == [(4, 6, 3)]
        a = np.uint64(WordKeys()[b"a"])
        for chunk in (1, 2):
            own = [r for r in rows if r["chunk"] == chunk and r["words"]]
            keys = np.concatenate([lm._unpacked_keys(r["keys"]) for r in own])
            fit = np.concatenate([lm._unpacked(r["fit"]) for r in own])
            assert dict(zip(keys.tolist(), fit.tolist()))[int(a)] == 3


def test_weights_prefer_the_order_that_explains_the_deleted_part(spark):
    held = spark.createDataFrame([(3, 0.5, 1e-6, 90), (3, 0.0, 1e-3, 10), (0, 0.0, 0.1, 5)],
                                 "bucket int, p2 double, p1 double, n long")
    w = fit_weights(held, 1e-9)
    assert w[3][1] == pytest.approx(0.9, abs=0.01) and w[3][0] == pytest.approx(0.1, abs=0.01)
    assert w[0][1] == 0 and w[7].tolist() == [1 / 3] * 3
    assert np.allclose(w.sum(axis=1), 1)


def test_small_parts():
    assert bucket(np.array([0, 1, 2, 3, 4, 1023, 1024])).tolist() == [0, 1, 2, 2, 3, 10, 11]
    assert token_keys("", WordKeys()).tolist() == [int(END)]
    assert [_bytes(x) for x in ("128MB", "16m", "134217728b", "1g", "77")] == [1 << 27, 1 << 24, 1 << 27, 1 << 30, 77]


def test_counts_above_32_bits_are_kept():
    import pyarrow as pa
    from crowdspark.llm import lm
    for counts in ([], [0], [1, 255, 256], [0, (1 << 32) - 1, 1 << 32, (1 << 32) + 5, 1 << 40, (1 << 63) - 1]):
        assert lm._unpacked(lm._packed(np.array(counts, np.int64))).tolist() == counts
    # two chunks' own counts of a word add up to more than 32 bits hold
    keys, half = lm._packed_keys(np.array([7], np.uint64)), 1 << 31
    none = lm._packed(np.array([0]))
    asked = pa.RecordBatch.from_pylist(
        [{"part": 0, "chunk": c, "words": True, "keys": keys, "fit": lm._packed(np.array([half + c])), "deleted": none}
         for c in (0, 1)], schema=lm.REQUEST)
    rows = [r for b in _answer_pass(iter([asked])) for r in b.to_pylist()]
    assert [lm._unpacked(r["fit"]).tolist() for r in rows if r["chunk"] is not None] == [[2 * half + 1]] * 2
    assert [r["n_fit"] for r in rows if r["chunk"] is None] == [2 * half + 1]
