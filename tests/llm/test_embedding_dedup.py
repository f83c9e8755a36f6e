import math
import random

import numpy as np
import pytest

from crowdspark.llm.embedding_dedup import collisions, embedding_groups, least_collisions, linked_pairs, reach


def rows_of_vectors(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    rnd = random.Random(seed)
    rows = []
    for _ in range(60):
        center = rng.standard_normal(dim)
        for _ in range(rnd.randint(1, 6)):
            v = center + rng.standard_normal(dim) * rnd.choice([0, 0.05, 0.25, 0.4])
            rows.append([(v * rnd.choice([1, 3])).tolist(), rnd.choice([0, 0, 1])])
    one = rng.standard_normal(dim).tolist()
    rows += [[one, 0]] * 30 + [[one, None], [None, 0], [[], 0], [[0.0] * dim, 0], [[float("nan")] + one[1:], 0],
                               [[None] + one[1:], 0], [[float("inf")] + one[1:], 0], [one[:-1], 0], [one[:-1], 0]]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    ids[7] = ids[9] = None
    ids[11] = ids[12]
    return [(i, v, label, 1, 2) for i, (v, label) in zip(ids, rows)]


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(keyed):
    keys = sorted(keyed)
    root = {k: k for k in keys}
    links = dict.fromkeys(keys, 0)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in keys:
        for b in keys:
            (_, v, la), (_, w, lb) = keyed[a], keyed[b]
            if a < b and la is not None and la == lb and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    groups: dict = {}
    for k in keys:
        groups.setdefault(find(k), []).append(keyed[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return {k: (links[k], least[find(k)], keyed[k][0] == least[find(k)]) for k in keys}


@pytest.mark.parametrize("block", [1024, 8])
def test_hostile_rows_against_brute_force(spark, tmp_path, block):
    from pyspark.sql import functions as F
    path = str(tmp_path / "v")
    spark.createDataFrame(rows_of_vectors(), "vec_id long, embedding array<double>, label int, node long, dim int"
                          ).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    keyed = {r["k"]: (r["vec_id"], r["embedding"], r["label"])
             for r in df.select(F.monotonically_increasing_id().alias("k"), "*").collect()}
    got = {r["row_key"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(df, block=block).collect()}
    assert got == brute(keyed)
    none = df.where("false")
    assert embedding_groups(none).collect() == []
    alone = {r["vec_id"]: r for r in embedding_groups(df.where("label is null")).collect()}
    assert all(r["n_links"] == 0 and r["component_id"] == i for i, r in alone.items())


def test_collisions_are_query_centred_windows():
    rng = np.random.default_rng(0)
    q, d = rng.standard_normal((30, 5)), rng.standard_normal((40, 5))
    want = (np.abs(q[:, None, :] - d[None, :, :]) <= 0.5).sum(axis=2)
    assert (collisions(q, d, 0.5) == want).all()


def test_recall_at_the_threshold_and_selectivity():
    """Pairs exactly at the threshold are found; unrelated ones are hardly ever verified."""
    rng = np.random.default_rng(1)
    dim, n = 64, 1000
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = 0.9301
    b = c * a + math.sqrt(1 - c * c) * side
    i, j = linked_pairs(a, b, False)
    assert (i == j).all() and len(i) >= 0.999 * n
    from crowdspark.llm.embedding_dedup import WIDTH, lines
    at = lines(dim)
    counts = collisions(a @ at.T, a @ at.T, WIDTH * reach(0.93) / math.sqrt(dim))
    np.fill_diagonal(counts, 0)
    assert (counts >= least_collisions()).mean() < 0.01
