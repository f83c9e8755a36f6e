import hashlib
import re
import tempfile

import pytest

from crowdspark.llm.exact_dedup import NO_ID, exact_dedup, grace_groups


@pytest.mark.parametrize("memory", [48 << 20, 2000])
def test_hostile_rows_against_brute_force(hostile, keyed, memory):
    got = {r["row_key"]: r for r in exact_dedup(hostile, memory_bytes=memory).collect()}
    assert got.keys() == keyed.keys()
    groups: dict[str, list] = {}
    for key, (doc_id, text, _, _) in keyed.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, key))
    for body, members in groups.items():
        last, keep, first = min(members)
        for _, _, key in members:
            r = got[key]
            assert r["keep_id"] == (None if last else keep)
            assert r["group_size"] == len(members)
            assert r["kept"] == (key == first)
            assert r["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def test_empty_table(empty):
    assert exact_dedup(empty).collect() == []


def test_recursion_splits_until_buckets_fit_and_leaves_no_files():
    bodies = [b"%d" % (i % 700) * 20 for i in range(3000)]
    rows = [(hashlib.sha256(b).digest(), b, i, i, 1) for i, b in enumerate(bodies)]
    with tempfile.TemporaryDirectory() as folder:
        found = list(grace_groups(iter(rows), 3000, folder))
        import os
        assert os.listdir(folder) == []
    assert len(found) == 700
    assert sorted(m[0] for e in found for m in e[4]) == list(range(3000))
    assert all(e[2] == min((m[1], m[0]) for m in e[4]) for e in found)


def test_one_text_larger_than_memory_and_equal_hash_bits():
    same = b"\x07" * 32                               # one digest for all: only the content tells apart
    rows = [(same, b"a" * 5000, 0, 5, 1), (same, b"b", 1, NO_ID, 1), (same, b"a" * 5000, 2, 3, 1)]
    with tempfile.TemporaryDirectory() as folder:
        found = {e[1]: (e[2], e[3]) for e in grace_groups(iter(rows), 1 << 20, folder)}
    assert found == {b"a" * 5000: ((3, 2), 2), b"b": ((NO_ID, 1), 1)}
