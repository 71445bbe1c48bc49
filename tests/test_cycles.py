import random

import pytest

from fiduciary.operators.cycles import cycle_components


def brute(links):
    links = {(a, b) for a, b in links if a is not None and b is not None}
    nodes = {x for e in links for x in e}
    after = {n: {b for a, b in links if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, open_ = set(), list(after[n])
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += after[x]
        reach[n] = seen
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in nodes if n in reach[n])


def found(spark, links):
    return sorted(map(tuple, cycle_components(spark.createDataFrame(links, "source long, target long")).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 30
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.choice([25, 40]))] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 104), (200, 201), (201, 200), (201, 202), (202, 203), (203, 201), (1, 300), (None, 1)]
    assert found(spark, links + links[:5]) == brute(links)


def test_a_long_ring_and_a_long_chain(spark):
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    chain = [(i, i + 1) for i in range(10_000, 13_000)]
    assert found(spark, ring + chain + [(5, 10_000)]) == [(i, 0) for i in range(3000)]


def test_no_links(spark):
    assert found(spark, []) == [] and found(spark, [(1, 2), (2, 3)]) == [] and found(spark, [(4, 4)]) == [(4, 4)]
