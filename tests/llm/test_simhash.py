import random

import numpy as np
import xxhash

from crowdspark.llm.simhash import fingerprint, near_fingerprints, simhash_groups, trie_self_join


def slow_fingerprint(text, k=4):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def planted(n=400, seed=3):
    rnd = random.Random(seed)
    out = {rnd.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(out)[:150]:
        for d in (1, 4, 4, 5):
            for b in rnd.sample(range(64), d):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def test_trie_finds_exactly_the_near_pairs():
    fps = planted()
    i, j = trie_self_join(np.array(fps, np.uint64), 4)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4}
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_distributed_links_connect_as_all_pairs_do(spark):
    fps = planted(200)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    want = components(pairs, fps)
    for subtree in (4096, 2):                           # 2: every subtree is divided again
        links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in near_fingerprints(df, 4, subtree).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in links)
        assert components(links, fps) == want


def test_hostile_rows(hostile, keyed):
    got = {r["row_key"]: r for r in simhash_groups(hostile).collect()}
    fp = {k: slow_fingerprint(v[1]) for k, v in keyed.items()}
    keys = sorted(keyed)
    pairs = [(a, b) for a in keys for b in keys if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    root = components(pairs, keys)
    groups: dict = {}
    for k in keys:
        groups.setdefault(root[k], []).append((keyed[k][0] is None, keyed[k][0] or 0, k))
    for members in groups.values():
        last, low, first = min(members)
        for _, _, k in members:
            assert got[k]["fingerprint"] == f"{fp[k]:016x}"
            assert got[k]["component_id"] == (None if last else low)
            assert got[k]["kept"] == (k == first)
    assert len(got) == len(keys)


def test_fingerprint_of_long_text_in_blocks():
    text = " ".join(str(i * 7919 % 1000) for i in range(70_000))
    words = text.encode().split()
    counts = np.zeros(64, int)
    for i in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 3)
    assert fingerprint(text.encode()) == want


def test_empty_table(empty):
    assert simhash_groups(empty).collect() == []
