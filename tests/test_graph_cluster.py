import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.operators import cluster, graph, meeting
from orefield.plans import cluster_queries, graph_queries  # noqa: F401  (register their queries)
from orefield.plans.registry import CORE


def both(spark, edges):
    return graph.both_ways(spark.createDataFrame(edges, "u string, v string"))


def brute_betweenness(edges):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    score = defaultdict(float)
    for root in near:
        dist, sigma, order, parents = {root: 0}, defaultdict(float, {root: 1.0}), [], defaultdict(list)
        queue = deque([root])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
                    parents[y].append(x)
        credit = defaultdict(lambda: 1.0)
        for y in reversed(order):
            for x in parents[y]:
                part = credit[y] * sigma[x] / sigma[y]
                score[tuple(sorted((x, y)))] += part / 2
                credit[x] += part
    return score


TWO_TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"), ("x", "y")]


@pytest.mark.parametrize("edges", [TWO_TRIANGLES, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]])
def test_betweenness(spark, edges):
    expected = brute_betweenness(edges)
    for options in ({}, {"local_edges": 0}, {"local_edges": 0, "roots": 3}):
        got = {(r.u, r.v): r.betweenness for r in graph.edge_betweenness(both(spark, edges), **options).collect()}
        assert set(got) == set(expected) and all(math.isclose(got[e], expected[e], abs_tol=1e-9) for e in got)
    assert graph.edge_betweenness(both(spark, edges).limit(0)).count() == 0


def test_communities(spark):
    edges = both(spark, TWO_TRIANGLES)
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == dict.fromkeys("abcdef", "a") | dict.fromkeys("xy", "x")
    whole = graph.vertices(edges).withColumn("component", F.lit("all"))
    assert graph.modularity(edges, whole) == 0
    best, score = graph.girvan_newman(edges, max_cuts=3)
    groups = defaultdict(set)
    for r in best.collect():
        groups[r.component].add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"], ["x", "y"]]
    assert score > 0.4
    labels = {r.node: r.label for r in graph.label_propagation(edges, 5).collect()}
    assert set(labels) == set("abcdefxy")


def test_division_runs_to_its_stop_rules(spark, tmp_path):
    two = [(f"{side}{i}", f"{side}{j}") for side in "ab" for i in range(8) for j in range(i)]
    linked = two + [(f"a{i}", f"b{(i + k) % 8}") for i in range(5) for k in range(2)]  # ten cuts to split
    rows = [(user, f"{u}-{v}-{k}") for u, v in linked for k in range(5) for user in (u, v)]
    spark.createDataFrame(rows, "user_id string, business_id string").write.parquet(f"{tmp_path}/user_business.parquet")
    got = CORE.queries["girvan_newman"](spark, str(tmp_path)).collect()
    assert {r.node: r.component for r in got} == {r.node: f"{r.node[0]}0" for r in got} and len(got) == 16
    assert got[0].modularity == round(56 / 66 - 0.5, 4)


@pytest.mark.parametrize("edges", [TWO_TRIANGLES, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]])
def test_division_in_a_task_and_over_tables(spark, edges):
    edges = both(spark, edges)
    (one, score), (other, other_score) = (graph.girvan_newman(edges, local_edges=n) for n in (100, 0))
    assert score == other_score and sorted(one.collect()) == sorted(other.collect())
    empty, score = graph.girvan_newman(edges.limit(0))
    assert empty.count() == 0 and score == -1.0


def test_long_chain_and_isolated_nodes(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(61)] + [("z",)], "node string")
    found = {r.node: r.component for r in graph.components(both(spark, chain), nodes).collect()}
    assert set(found.values()) == {"n000", "z"} and found["z"] == "z"


@pytest.mark.parametrize("bucket", [3, 4096])
def test_hot_tokens_are_split(spark, bucket, monkeypatch):
    rows = [(f"r{i:03d}", "hot") for i in range(60)] + [(f"r{i:03d}", f"t{i % 9}") for i in range(60)]
    df = spark.createDataFrame(rows, "record string, token string")
    got = [(r.token, r.a.record, r.b.record) for r in meeting.meet(df, ["token"], bucket).collect()]
    expected = {(t, a, b) for a, t in rows for b, u in rows if t == u}
    assert len(got) == len(expected) and set(got) == expected
    monkeypatch.setattr(meeting, "SPLIT_KEYS", 0)  # hot keys are met by a join that splits
    assert sorted((r.token, r.a.record, r.b.record) for r in meeting.meet(df, ["token"], bucket).collect()) == sorted(expected)
    assert meeting.meet(df.limit(0), ["token"]).count() == 0


def test_no_task_meets_a_hot_token_alone(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("record"), F.lit("everywhere").alias("token"))
    met = meeting.meet(df, ["token"], 200)
    load = sorted(r.n for r in met.where("a.record < b.record").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    assert sum(load) == 6000 * 5999 // 2 and load[-1] <= 3 * load[len(load) // 2]


def test_cooccurrence(spark):
    rng = random.Random(1)
    pairs = [(f"u{rng.randint(0, 15)}", f"i{rng.randint(0, 12)}") for _ in range(140)] + [(f"u{i}", "hot") for i in range(16)] + [(None, "i1"), ("u1", None)]
    by = defaultdict(set)
    for u, i in pairs:
        if u and i:
            by[u].add(i)
    for t in (1, 3, 5):
        got = {(r.src, r.dst) for r in graph.cooccurrence_edges(spark.createDataFrame(pairs, "u string, i string"), "u", "i", t).collect()}
        assert got == {(a, b) for a in by for b in by if a != b and len(by[a] & by[b]) >= t}


def blobs(seed=0, n=240):
    rng = random.Random(seed)
    centers = [(0, 0, 5.0), (50, 0, 5.0), (0, 60, 5.0)]
    rows = []
    for i in range(n):
        x, y, z = centers[i % 3]
        rows.append((i, [x + rng.gauss(0, 1), y + rng.gauss(0, 1), z], 1 + i * 3 // n))
    rows += [(n + k, [500.0 + 90 * k, -700.0 - 41 * k * k, 5.0], 1 + k % 3) for k in range(4)]
    return rows


def test_clusters_merge_by_either_deviation():
    assert cluster._apart([10.0], [10.0], [0.0], [1.0]) == 1.0 == cluster._apart([0.0], [1.0], [10.0], [10.0])
    assert cluster._apart([3.0, 1.0], [0.0, 1.0], [0.0, 1.0], [0.0, 9.0]) == 3.0


def test_new_cluster_joins_an_old_one_by_its_own_width(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1), 0.0], 1) for i in range(60)] + [(100 + i, [400 + rng.gauss(0, 1), 0.0], 1) for i in range(60)]
    rows += [(200 + i, [20.0 + 14 * (i % 2) + rng.gauss(0, 0.1), 0.0], 2) for i in range(9)]
    points = spark.createDataFrame(rows, "point_id long, features array<double>, round int")
    state = cluster.bfr(points, 2, alpha=2.0)
    assert sum(s.n for s in state.ds.values()) + sum(s.n for s in state.cs.values()) + state.n_retained == len(rows)
    labels = {r.point_id: r.cluster for r in cluster.bfr_labels(state).collect()}
    assert sorted(labels) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("local_values", [0, 2_000_000])
def test_kmeans_in_a_task_and_over_tables(spark, local_values):
    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(80)]
    points = spark.createDataFrame(rows, "point_id long, features array<double>")
    start = [[0.0, 0.0], [6.0, 10.0], [900.0, 900.0]]  # the third loses all points at once
    _, found = cluster.kmeans(points, start, local_values=local_values)
    ids, values = np.array([i for i, _ in rows]), np.array([f for _, f in rows])
    expected, rest = cluster._lloyd(ids, values, np.array(start), 100, 1e-4, 0)
    assert rest and all(math.isclose(x, y, abs_tol=1e-9) for (_, c), e in zip(found, expected) for x, y in zip(c, e))


def test_starts_are_means_of_six(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)]
    points = spark.createDataFrame(rows, "point_id long, features array<double>")
    drawn = sorted(sorted(range(40), key=lambda i: (cluster._seeded(7, "start", i), i))[:18])
    assert cluster._start_means(points, 3, 7) == [[sum(drawn[g * 6 : g * 6 + 6]) / 6, 1.0] for g in range(3)]
    assert len(cluster._start_means(points, 30, 7)) == 30


def test_kmeans(spark):
    rows = blobs()[:240]
    points = spark.createDataFrame(rows, "point_id long, features array<double>, round int")
    found, centroids = cluster.kmeans(points, [rows[0][1], rows[1][1], rows[2][1]])
    labels = {r.point_id: r.cluster for r in found.collect()}
    assert all(labels[i] == i % 3 for i in range(240)) and len(centroids) == 3
    tie = spark.createDataFrame([(1, [0.0])], "point_id long, features array<double>")
    assert cluster.assign(tie, [(0, [-1.0]), (1, [1.0])]).first().cluster == 1


def test_bfr_conserves_points(spark):
    rows = blobs()
    points = spark.createDataFrame(rows, "point_id long, features array<double>, round int")
    state = cluster.bfr(points, 3, alpha=2.0, max_rounds=10)
    seen = 0
    for turn, _, ds, _, cs, rs in state.rounds:
        seen += sum(1 for r in rows if r[2] == turn)
        assert ds + cs + rs == seen
    labels = {r.point_id: r.cluster for r in cluster.bfr_labels(state).collect()}
    assert sorted(labels) == [r[0] for r in rows]
    assert cluster.round_report(state, spark).count() == 3
    assert not cluster.bfr(points.limit(0), 3).rounds


def test_bfr_queries_converge(spark, monkeypatch):
    kmeans, moves = cluster.kmeans, []

    def watched(points, start, *args):
        found, centroids = kmeans(points, start, *args)
        _, further = kmeans(points, [c for _, c in centroids], 1, -1.0)
        moves.append(max(math.dist(a, b) for (_, a), (_, b) in zip(centroids, further)))
        return found, centroids

    monkeypatch.setattr(cluster, "kmeans", watched)
    assert CORE.queries["bfr_rounds"](spark, "/root/testdata/sf0.1").count() == 4
    assert moves and max(moves) < 1e-3


def test_kmeans_warns_when_stopped_early(spark):
    points = spark.createDataFrame([(i, [float(i * i)]) for i in range(40)], "point_id long, features array<double>")
    with pytest.warns(RuntimeWarning, match="not converged"):
        cluster.kmeans(points, [[0.0], [1.0]], max_rounds=1)


def test_summary(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0], 0), (2, [3.0, 5.0], 0), (3, [9.0, 0.0], 1)], "point_id long, features array<double>, cluster int")
    got = {r.cluster: r for r in cluster.centroids_of(cluster.summaries(rows)).collect()}
    assert got[0].centroid == [2.0, 5.0] and got[0].deviation == [1.0, 0.0] and got[1].n == 1
