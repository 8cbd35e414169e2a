"""Connected parts against a union of sets."""

import random

import pytest

from ligandloom.operators.components import connected


def plain(links):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        top[high] = low
    return {x: find(x) for x in top}


@pytest.mark.parametrize("n,m,chain", [(10, 0, 0), (60, 30, 0), (300, 200, 60), (200, 600, 0)])
def test_equals_union_of_sets(spark, n, m, chain):
    rng = random.Random(n)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k + n, k + n + 1) for k in range(chain)]
    links += links[:5]
    got = connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == plain(links) and len(got) == len(plain(links))
