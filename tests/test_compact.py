"""Joins and walks over arrays: the same rows as over tables, and nothing large written on the way."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from oracle import compare
from test_graph_cluster import both, brute_betweenness

from orefield.operators import compact, graph, meeting, minhash
from orefield.plans import io_queries  # noqa: F401  (register their queries)
from orefield.plans.registry import CORE


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that the graph operators write."""
    rows, cut = [], graph.cut_lineage

    def counted(df):
        table = cut(df)
        rows.append(table.count())
        return table

    monkeypatch.setattr(graph, "cut_lineage", counted)
    return rows


def some_edges(nodes=40, degree=5):
    rng = random.Random(3)
    return sorted({tuple(sorted((f"n{i:02d}", f"n{rng.randrange(nodes - 1):02d}"))) for i in range(nodes) for _ in range(degree)} - {(f"n{i:02d}",) * 2 for i in range(nodes)})


def test_betweenness_in_portions(spark, monkeypatch):
    edges = some_edges()
    monkeypatch.setattr(compact.Graph.flows, "__defaults__", (1000,))  # several batches of roots in a task
    got = {(r.u, r.v): r.betweenness for r in graph.edge_betweenness(both(spark, edges)).collect()}
    expected = brute_betweenness(edges)
    assert set(got) == set(expected) and all(math.isclose(got[e], expected[e], abs_tol=1e-8) for e in got)


#: Two sides of 102 nodes, all linked across: more edges than the divisive loop takes into one task.
SIDE = 102
ACROSS = [(f"a{i:03d}", f"b{j:03d}") for i in range(SIDE) for j in range(SIDE)]


def test_betweenness_writes_no_paths(spark, written):
    got = graph.edge_betweenness(both(spark, ACROSS)).collect()
    assert {(r.u, r.v) for r in got} == set(ACROSS) and len(got) == len(ACROSS)
    assert all(math.isclose(r.betweenness, 1 + 2 * (SIDE - 1) / SIDE, abs_tol=1e-8) for r in got)
    assert max(written) <= 2 * len(ACROSS)  # the paths are twice as many, their arcs a hundred times


@pytest.mark.parametrize("at_least", [1, 2, 3])
def test_cooccurrence_in_tasks_and_over_tables(spark, at_least):
    rng = random.Random(5)
    rows = sorted({(f"u{min(rng.randrange(50), rng.randrange(50))}", f"i{min(rng.randrange(20), rng.randrange(20))}") for _ in range(260)})
    pairs = spark.createDataFrame([*rows, *rows[:9], (None, "i1"), ("u1", None)], "n string, i string")
    items = defaultdict(set)
    for u, i in rows:
        items[u].add(i)
    expected = {(a, b) for x, y in combinations(items, 2) if len(items[x] & items[y]) >= at_least for a, b in ((x, y), (y, x))}
    for local in (graph.LOCAL_ROWS, 0):
        got = [tuple(r) for r in graph.cooccurrence_edges(pairs, "n", "i", at_least, local_rows=local).collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert graph.cooccurrence_edges(pairs.where(F.lit(False)), "n", "i", at_least).count() == 0


def test_pairs_are_counted_alike_in_any_portion():
    class Rows:
        def toArrow(self):
            import pyarrow as pa

            return pa.table({"record": ["b", "b", "a", "c", "a", "c", "d"], "token": [1, 2, 1, 2, 2, 1, 9]})

    sets = compact.Sets(Rows())
    for shares, at_once in ((1, 100), (1, 1), (3, 2)):
        got = sorted((int(a), int(b), int(n)) for share in range(shares) for found in sets.shared(share, shares, at_once) for a, b, n in zip(*found))
        assert got == [(0, 1, 2), (0, 2, 2), (1, 2, 2)]


def test_paths_are_not_written(spark, written):
    paths = graph.shortest_paths(both(spark, ACROSS))
    got = paths.groupBy("dist").agg(F.count(F.lit(1)).alias("n"), F.min("sigma").alias("least"), F.max("sigma").alias("most"), F.countDistinct("root", "node").alias("pairs")).collect()
    n = 2 * SIDE
    assert sorted(map(tuple, got)) == [(0, n, 1.0, 1.0, n), (1, n * SIDE, 1.0, 1.0, n * SIDE), (2, n * (SIDE - 1), SIDE, SIDE, n * (SIDE - 1))]
    assert max(written) <= 2 * len(ACROSS)


def test_paths_in_tasks_and_over_tables(spark):
    edges = both(spark, [*some_edges(30, 2), ("x", "y")])
    one, other = (sorted(map(tuple, graph.shortest_paths(edges, local_edges=n).collect())) for n in (graph.WALK_EDGES, 0))
    assert one == other and len(one) == len(set(one))
    assert graph.shortest_paths(edges.limit(0)).count() == 0


def test_edge_file_writes_no_paths(spark, written, tmp_path):
    users = 145
    spark.createDataFrame([(f"u{i:03d}", f"b{k}") for i in range(users) for k in range(3)], "user_id string, business_id string").write.parquet(f"{tmp_path}/user_business.parquet")
    lines = [r.value for r in CORE.queries["edge_file"](spark, str(tmp_path)).orderBy("line_no").collect()]
    assert lines == [f"('u{i:03d}', 'u{j:03d}'), 1.0" for i in range(users) for j in range(i + 1, users)]
    assert max(written) <= users * (users - 1)  # both directions of the edges


def test_edge_file_writes_no_rows_of_small_nodes(spark, written, tmp_path):
    large = [(f"u{i}", f"b{k}") for i in range(9) for k in range(3)]
    small = [(f"v{i:03d}", f"b{i % 5}") for i in range(300)]
    spark.createDataFrame([*large, *small, *small[:20] * 2], "user_id string, business_id string").write.parquet(f"{tmp_path}/user_business.parquet")
    _, difference = compare(spark, CORE.queries, CORE.sql, "edge_file", str(tmp_path))
    assert not difference and max(written) <= 9 * 8  # both directions of the edges


def test_flows_are_sent_by_no_more_tasks_than_run_at_once(spark, monkeypatch):
    sent, in_shares = [], graph.in_shares

    def counted(*args):
        sent.append(in_shares(*args))
        return sent[-1]

    monkeypatch.setattr(graph, "in_shares", counted)
    edges = some_edges()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert graph.edge_betweenness(both(spark, edges)).count() == len(edges)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert sum(x.count() for x in sent) <= spark.sparkContext.defaultParallelism * len(edges)


@pytest.fixture
def written_by_minhash(monkeypatch):
    """Rows of each table that the operators on signatures and meetings write."""
    rows, cut = [], minhash.cut_lineage

    def counted(df):
        table = cut(df)
        rows.append(table.count())
        return table

    for module in (minhash, meeting):
        monkeypatch.setattr(module, "cut_lineage", counted)
    return rows


#: 60 sets of one element each and 60 that overlap: sets of small least numbers share bands, though few share elements.
SETS = [(f"e{i:02d}", f"x{i:02d}") for i in range(60)] + [(f"f{i:02d}", f"y{(i + k) % 60:02d}") for i in range(60) for k in range(1 + i % 5)]


@pytest.mark.parametrize("rows", [1, 2, 3])
def test_lsh_in_tasks_and_over_tables(spark, rows):
    sets = spark.createDataFrame(SETS, "entity string, element string")
    options = (sets, 0.2, rows, [3, 5, 7, 11, 13], [1, 0, 4, 2, 9], 17)
    one, other = (sorted(map(tuple, minhash.lsh_pairs(*options, local_rows=n).collect())) for n in (minhash.LOCAL_ROWS, 0))
    assert one == other and one
    counts = [minhash.lsh_recall(*options, local_rows=n).collect() for n in (minhash.LOCAL_ROWS, 0)]
    assert counts[0] == counts[1] and counts[0][0].n_found == len(one)
    none = sets.limit(0)
    assert minhash.lsh_pairs(none, *options[1:]).count() == 0
    assert tuple(minhash.lsh_recall(none, *options[1:]).first()) == (0, 0)


@pytest.mark.parametrize("name", ["lsh_recall", "lsh_jaccard"])
def test_lsh_writes_no_bands(spark, written_by_minhash, tmp_path, name):
    spark.createDataFrame([(x, e) for e, x in SETS], "user_id string, business_id string").write.parquet(f"{tmp_path}/user_business.parquet")
    _, difference = compare(spark, CORE.queries, CORE.sql, name, str(tmp_path))
    assert not difference and max(written_by_minhash) <= len(SETS)  # there are 32 bands per set
