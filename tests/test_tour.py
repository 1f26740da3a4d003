"""Preorder intervals against a plain walk: random forests, long chains, hot parents, cycles."""

import random

import pytest

from tessera.operators import tour

SCHEMA = "parent bigint, child bigint, ordinal bigint"


def plain(edges):
    up = {}
    for p, c, o in edges:
        if p is not None and c is not None:
            up[c] = min(up.get(c, (p, o)), (p, o))
    down = {}
    for c, (p, o) in up.items():
        down.setdefault(p, []).append((o, c))
    out = {}
    for root in set(down) - set(up):
        place, stack = 0, [(root, 0, False)]
        while stack:
            node, depth, leaving = stack.pop()
            if leaving:
                out[node] = (*out[node], place)
                continue
            place += 1
            out[node] = (root, depth, place)
            stack.append((node, depth, True))
            stack += [(c, depth + 1, False) for _, c in sorted(down.get(node, []), reverse=True)]
    return out


def got(df):
    rows = df.collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: (r["root"], r["depth"], r["place"], r["last"]) for r in rows}


def forest(seed, n=400):
    rnd = random.Random(seed)
    ids = rnd.sample(range(10_000), n)
    edges = [(ids[rnd.randrange(max(0, i - 1 - rnd.choice([0, 3, 200])), i)], ids[i], rnd.randrange(4)) for i in range(1, n) if rnd.random() < 0.97]
    return edges + [(e[0], e[1], e[2] + 1) for e in edges[:9]] + [(min(ids) - 1, e[1], 5) for e in edges[10:14]]


@pytest.mark.parametrize("seed, spacing, one_task", [(1, 64, 1_000_000), (2, 5, 20), (3, 3, 0)])
def test_equals_a_plain_walk(spark, seed, spacing, one_task):
    edges = forest(seed)
    if one_task == 0:
        one_task = 50
    df = spark.createDataFrame(edges, SCHEMA).repartition(3)
    assert got(tour.tour(df, spacing, one_task)) == plain(edges)


def test_a_chain_of_100_000(spark):
    n = 100_000
    df = spark.range(1, n).selectExpr("id - 1 as parent", "id as child", "0L as ordinal")
    rows = tour.tour(df, one_task=50_000)
    assert rows.filter("root = 0 and depth = node and place = node + 1").filter(f"last = {n}").count() == n
    assert tour.below(rows, 99_990, 3).orderBy("place").collect() == [(99_990, 1, 1), (99_991, 2, 2), (99_992, 3, 3)]


def test_a_hot_parent_over_many_tasks(spark):
    df = spark.range(1, 30_000).selectExpr("0L as parent", "id as child", "id % 7 as ordinal")
    rows = {r["node"]: r["place"] for r in tour.tour(df).collect()}
    order = [0, *sorted(range(1, 30_000), key=lambda i: (i % 7, i))]
    assert rows == {node: k + 1 for k, node in enumerate(order)}


def test_cycles_and_what_hangs_below_them_are_left_out(spark):
    edges = [(1, 2, 0), (2, 3, 0), (3, 1, 0), (3, 4, 0), (4, 5, 0), (10, 11, 1), (10, 12, 0), (7, 7, 0), (None, 20, 0), (10, None, 0)]
    for one_task, spacing in ((100, 64), (2, 2)):
        assert got(tour.tour(spark.createDataFrame(edges, SCHEMA), spacing, one_task)) == plain(edges) == {10: (10, 0, 1, 3), 12: (10, 1, 2, 2), 11: (10, 1, 3, 3)}


def test_text_ids_and_no_edges(spark):
    schema = "parent string, child string, ordinal bigint"
    rows = tour.tour(spark.createDataFrame([("r", "b", 1), ("r", "a", 1), ("a", "c", 0)], schema))
    assert {r["node"]: r["place"] for r in tour.below(rows, "r", 9).collect()} == {"r": 1, "a": 2, "c": 3, "b": 4}
    assert tour.below(rows, "a", 1).count() == 1 and tour.below(rows, "nothing", 4).count() == 0 and tour.below(rows, "r", 0).count() == 0
    assert tour.tour(spark.createDataFrame([], schema)).count() == 0
