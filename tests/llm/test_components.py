import random

import numpy as np

from crowdspark.llm.components import connected_components, star_links

from .test_simhash import components


def test_random_links_chains_and_hubs(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)]
    links += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 2000 + i) for i in range(200)] + [(7, 7), (8, 7), (7, 8)]
    nodes = {n for l in links for n in l}
    want = components(links, nodes)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_star_links():
    u, v = star_links(np.array([10, 11, 12, 13, 14]), np.array([0, 1, 3]), np.array([1, 2, 4]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(11, 10), (12, 10), (14, 13)]
