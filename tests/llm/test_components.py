import random

import pytest

from tricolor.llm import components
from tricolor.llm.components import connected_components


def expected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in root)


def chain(n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    return list(zip(order, order[1:]))


CASES = {
    "empty": [],
    "one edge twice": [(2, 1), (1, 2), (2, 1)],
    "self loops": [(5, 5), (5, 5), (7, 7), (7, 3), (2, 2), (2, 9)],
    "null ends": [(None, 1), (2, None), (4, 3), (None, None)],
    "chain in order": [(i, i + 1) for i in range(40)],
    "chain in any order": chain(60),
    "star around the largest": [(100, i) for i in range(50)],
    "stars that meet": [(i, i % 7) for i in range(7, 80)] + [(-1, 3), (-1, 5), (200, 201)],
}


@pytest.mark.parametrize("edges", CASES.values(), ids=CASES)
def test_equals_union_find(rows, edges):
    got = connected_components(rows("a long, b long", edges)).collect()
    assert sorted((r["id"], r["component"]) for r in got) == expected(edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_union_find_on_random_edges(rows, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]
    got = connected_components(rows("a long, b long", edges)).collect()
    assert sorted((r["id"], r["component"]) for r in got) == expected(edges)


def test_shuffles_and_rows_of_a_round(rows, spark, monkeypatch):
    """Every shuffle costs as many tasks as there are partitions, however few the rows."""
    shuffles, written = [], []
    real = components.stage_table

    def staged(df, name):
        shuffles.append(str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning"))
        out = real(df, name)
        written.append(out.count())
        return out

    edges = chain(60)
    monkeypatch.setattr(components, "stage_table", staged)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        got = connected_components(rows("a long, b long", edges)).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r["id"], r["component"]) for r in got) == expected(edges)
    assert max(written) <= len(edges)
    assert max(shuffles) <= 7 and shuffles[-1] <= 2   # 10 and 10 before
