"""Connected components against a plain union-find."""

import random

import pytest

from panelspark.operators.graph import components


def brute(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def shapes(kind):
    rng = random.Random(3)
    if kind == "random":
        return [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    if kind == "chain":
        at = list(range(500))
        rng.shuffle(at)
        return list(zip(at, at[1:]))
    return [(0, k) for k in range(1, 300)] + [(5, 5), (-3, 7)]


@pytest.mark.parametrize("kind", ["random", "chain", "hub"])
@pytest.mark.parametrize("per_task", [50, 10_000])
def test_components(spark, kind, per_task):
    links = shapes(kind)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, len(links), per_task).collect()}
    assert got == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), 0).collect() == []
