import re

import pytest
from pyspark.sql import functions as F

from crowdspark.llm.mixing import mix_sources, source_targets


def water_fill(sizes, weights, goal, most):
    """Reshare the excess by weight until no source is above its limit."""
    target = {s: 0.0 for s in sizes}
    free, rest = set(sizes), goal
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / total > most * sizes[s]]
        if not over:
            for s in free:
                target[s] = rest * weights[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_hostile_rows(hostile, keyed, ranges):
    got = {r["row_key"]: r for r in mix_sources(hostile, ranges=ranges).collect()}
    assert got.keys() == keyed.keys()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", v[1] or "")) for k, v in keyed.items()}
    per: dict = {}
    for k, v in keyed.items():
        per[v[3]] = per.get(v[3], 0) + size[k]
    order = sorted((s for s in per if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = water_fill(per, weights, 1.5 * sum(per.values()), 2)
    taken: dict = {}
    for k, r in got.items():
        source = keyed[k][3]
        assert (r["size"], r["source_size"]) == (size[k], per[source])
        assert r["target"] == pytest.approx(want[source], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in per)
    partial = {s: sum(1 for k, r in got.items() if keyed[k][3] == s and r["size"] and r["taken"] % r["size"]) for s in per}
    assert all(n <= 1 for n in partial.values())        # only the document on the cut is cut


def test_reruns_agree(hostile):
    first, second = (mix_sources(hostile).orderBy("row_key").collect() for _ in range(2))
    assert first == second


def test_empty_table(empty):
    assert mix_sources(empty).collect() == []


def test_sources_without_words(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "source string, size long")
    assert all(r["target"] == 0 for r in source_targets(df).collect())
    df = spark.createDataFrame([("a", 0), ("b", 10)], "source string, size long")
    assert {r["source"]: r["target"] for r in source_targets(df).collect()} == {"a": 0.0, "b": 15.0}
