import random

import pytest

from ticketlens.llm.components import components


def _by_search(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        if start in root:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return {x: r for x, r in root.items() if x != r}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(4, 4)],
        [(1, 2), (2, 1), (1, 2)],
        [(i, i + 1) for i in range(-8, 9)],
        [(0, i) for i in range(1, 40)],
        [(random.Random(3).randint(0, 9**9) % 41, i % 37) for i in range(30)],
        [(a, b) for r in [random.Random(5)] for a, b in ((r.randint(-50, 50), r.randint(-50, 50)) for _ in range(45))],
    ],
)
def test_roots_are_the_least_reachable(spark, links):
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == _by_search(links)
    assert len(got) == len({r["node"] for r in got})
