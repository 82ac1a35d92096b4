"""The divisive loop in memory: betweenness kept up from cut to cut is what it is when found anew, and a large component ends."""

import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_compact import ACROSS, written  # noqa: F401
from test_graph_cluster import both, brute_betweenness

from orefield.operators import division, graph


def random_edges(rng, nodes, edges):
    return sorted({tuple(sorted(rng.sample([f"n{i:03d}" for i in range(nodes)], 2))) for _ in range(edges)})


def component_of(nodes, edges):
    near, found = defaultdict(set), {}
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    for x in sorted(nodes):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in found:
                found[y] = x
                todo += near[y]
    return found


def slow_division(edges, slack):
    """The loop as it is described, everything found anew after each cut."""
    nodes, left, m = {x for e in edges for x in e}, list(edges), len(edges)
    degree = {x: sum(x in e for e in edges) for x in nodes}
    best, best_score = component_of(nodes, left), -1.0
    while left:
        credits = {e: round(c, 9) for e, c in brute_betweenness(left).items()}
        left.remove(min(credits, key=lambda e: (-credits[e], e)))
        parts = component_of(nodes, left)
        total = defaultdict(int)
        for x in nodes:
            total[parts[x]] += degree[x]
        score = division._rounded(4 * m * sum(parts[u] == parts[v] for u, v in edges) - sum(n * n for n in total.values()), 4 * m * m)
        if score >= best_score:
            best, best_score = parts, score
        elif score < best_score - slack:
            break
    return best, best_score


def divided(edges, slack=0.1, dense=division.DENSE):
    src, dst = ([e[i] for e in edges] + [e[1 - i] for e in edges] for i in (0, 1))
    nodes, parts, score = division.divide(pa.chunked_array([src]), pa.chunked_array([dst]), None, slack, dense)
    return dict(zip(nodes.to_pylist(), parts.to_pylist())), score


@pytest.mark.parametrize("nodes, edges", [(6, 8), (12, 14), (14, 40), (25, 30), (24, 70)])
def test_division_is_that_of_the_slow_loop(nodes, edges):
    for seed in range(6):
        some = random_edges(random.Random(seed), nodes, edges)
        for slack in (0.1, 9.0):
            expected = slow_division(some, slack)
            assert all(divided(some, slack, dense) == expected for dense in (division.DENSE, 5, 0))


@pytest.mark.parametrize("shape", ["random", "grid", "ring", "hubs"])
def test_betweenness_is_kept_up(shape):
    rng = random.Random(7)
    edges = {
        "random": random_edges(rng, 30, 80),
        "grid": sorted([(f"{i}{j}", f"{i}{j + 1}") for i in range(6) for j in range(5)] + [(f"{i}{j}", f"{i + 1}{j}") for i in range(5) for j in range(6)]),
        "ring": sorted(tuple(sorted((f"n{i:02d}", f"n{(i + 1) % 25:02d}"))) for i in range(25)),
        "hubs": sorted({(h, f"n{i:02d}") for h in ("a", "b", "c") for i in range(30) if rng.random() < 0.8} | {("a", "b"), ("b", "c")}),
    }[shape]
    names = sorted({x for e in edges for x in e})
    codes = sorted((names.index(u), names.index(v)) for u, v in edges)
    held = division.Component(*np.array(codes).T)
    left = dict(enumerate((names[u], names[v]) for u, v in codes))
    while left:
        expected, got = brute_betweenness(left.values()), held.credits()
        assert all(abs(got[e] - expected[tuple(sorted(ends))]) < 2e-9 for e, ends in left.items())
        e = rng.choice(list(left))
        held.cut(e)
        del left[e]


def test_large_component_ends(spark):
    edges = random_edges(random.Random(1), 350, 1800)
    began = time.time()
    best, _ = graph.girvan_newman(both(spark, edges), slack=9.0)  # until every node stands alone
    assert best.count() == 350 and time.time() - began < 40


def test_many_edges_of_few_nodes_are_cut_in_one_task(spark, written):  # noqa: F811
    best, score = graph.girvan_newman(both(spark, ACROSS), max_cuts=3)
    assert best.count() == 204 and best.select("component").distinct().count() == 1 and score == 0 and len(written) <= 2


def test_score_is_rounded_exactly():
    assert [division._rounded(*x) for x in ((1198, 1600), (-1198, 1600), (0, 4), (1, 3))] == [0.7488, -0.7488, 0.0, 0.3333]
