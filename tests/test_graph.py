import random

import pytest

from millrace.operators.graph import connected_components
from millrace.operators.index import page_rank


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


def test_random_graph_chain_and_hub(spark, rows):
    random.seed(1)
    edges = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7), (900, 900), (-5, 3), (3, -5)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows(connected_components(df)) == sorted(brute(edges), key=repr)


@pytest.mark.parametrize("edges", [[], [(None, 1), (1, None)]])
def test_no_edges(spark, edges):
    assert connected_components(spark.createDataFrame(edges, "a long, b long")).count() == 0


def test_page_rank_against_power_iteration(spark):
    edges = [(1, 2), (3, 2), (2, 1), (4, 2), (4, 3), (3, 5), (4, 2)]
    links = set(edges)
    nodes = {x for e in links for x in e}
    rank = {n: 1 / 5 for n in nodes}
    for _ in range(3):
        given = {n: sum(rank[a] / sum(x == a for x, _ in links) for a, b in links if b == n) for n in nodes}
        lost = 1 - sum(given.values())
        rank = {n: 0.15 / 5 + 0.85 * (given[n] + lost / 5) for n in nodes}
    got = {r[0]: r[1] for r in page_rank(spark.createDataFrame(edges, "src_id long, dst_id long"), rounds=3).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-9 for n in nodes)
