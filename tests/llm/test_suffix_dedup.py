import hashlib
import random

import numpy as np
import pytest

from crowdspark.llm import suffix_dedup as S


def brute(keyed, length=50):
    big = 1 << 70
    own = {k: (big if v[0] is None else v[0], (v[1] or "").encode()) for k, v in keyed.items()}
    first: dict[bytes, int] = {}
    for i, b in own.values():
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, big), i)
    out = {}
    for k, (i, b) in own.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < i:
                gone[s:s + length] = b"\1" * length
        runs = []
        for at in range(len(b)):
            if gone[at]:
                if runs and runs[-1][1] == at:
                    runs[-1][1] += 1
                else:
                    runs.append([at, at + 1])
        left = bytes(c for c, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), len(runs), hashlib.sha256(left).hexdigest(), [tuple(r) for r in runs])
    return out


def result(df, **more):
    return {r["row_key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"],
                           [(s["from"], s["to"]) for s in r["spans"]]) for r in S.remove_repeats(df, **more).collect()}


@pytest.mark.parametrize("hot", [16_384, 2])
def test_hostile_rows_against_brute_force(hostile, keyed, hot):
    assert result(hostile, hot=hot) == brute(keyed)


def test_empty_table(empty):
    assert result(empty) == {}


def test_planted_passages_and_runs(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40), prose(15), "!" * 130, "ab" * 60]
    rows = [(i, prose(30) + rnd.choice(passages) + prose(rnd.randint(0, 30)) + rnd.choice(passages)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    from pyspark.sql import functions as F
    df = spark.read.parquet(str(tmp_path / "d"))
    keyed = {r["k"]: (r["doc_id"], r["text"]) for r in df.select(F.monotonically_increasing_id().alias("k"), "*").collect()}
    want = brute(keyed)
    assert sum(w[1] for w in want.values()) > 5000
    for hot in (512, 4):
        assert result(df, hot=hot) == want


def test_texts_longer_than_a_block(monkeypatch):
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"abc") for _ in range(n)) for n in (49, 50, 51, 400, 3000, 0)] + [b"a" * 900]
    whole = list(S.smallest_grams(texts))
    monkeypatch.setattr(S, "BLOCK", 256)
    pieces = list(S.smallest_grams(texts))

    def windows(blocks):
        return {(t, s): (place, gram) for b in blocks for t, lo, hi, place, gram in zip(*(x.tolist() for x in b))
                for s in range(lo, hi + 1)}
    assert {k: v[1] for k, v in windows(whole).items()} == {k: v[1] for k, v in windows(pieces).items()}
    assert set(windows(whole)) == {(t, s) for t, b in enumerate(texts) for s in range(len(b) - 49)}
    assert all(s <= place <= s + 34 for (t, s), (place, _) in windows(whole).items())


def test_sort_orders_suffixes_and_groups_equal_ones():
    rnd = random.Random(5)
    bodies = [bytes(rnd.choice(b"ab") for _ in range(20)) * 3 + bytes([rnd.choice(b"xy")]) * rnd.randint(0, 20) for _ in range(40)]
    data = np.frombuffer(b"".join(bodies) + bytes(32), np.uint8)
    starts = np.arange(len(data) - 32)
    order, begins = S.multikey_sort(data, starts, 24)
    raw = data.tobytes()
    keys = [raw[s:s + 24] for s in starts[order]]
    assert keys == sorted(keys) and [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] == np.nonzero(begins)[0].tolist()
    seen: dict = {}
    for b, body in enumerate(bodies):
        for p in range(len(body) - 49):
            seen.setdefault(body[p:p + 50], set()).add((b, p))
    assert sorted(sorted(g) for g in S.equal_windows(bodies, 50)) == sorted(sorted(v) for v in seen.values() if len(v) > 1)


def test_blind_trie_order():
    rnd = random.Random(6)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(6)) for _ in range(300)]
    trie = S.BlindTrie(strings)
    for i in range(len(strings)):
        trie.insert(i)
    groups = list(trie.groups())
    assert [strings[g[0]] for g in groups] == sorted(set(strings))
    assert all(len({strings[i] for i in g}) == 1 for g in groups) and sum(map(len, groups)) == len(strings)
