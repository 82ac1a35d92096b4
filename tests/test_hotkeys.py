import math
import random
from collections import Counter, defaultdict

import pytest

from orefield.operators import hotkeys
from orefield.operators.ranking import dense_index, with_place


def skewed(n=4000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else f"k{rng.randint(0, 60)}"
        value = rng.choice([None, float("nan"), rng.random() * 1e6, 5.0, 5.0, float(rng.randint(-9, 9))])
        rows.append((key if rng.random() > 0.02 else None, value, f"u{rng.randint(0, 300)}" if rng.random() > 0.1 else None, f"2020-01-{rng.randint(1, 28):02d}"))
    return rows


SCHEMA = "k string, v double, u string, d string"


def test_quantiles_are_exact(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA)
    by = defaultdict(list)
    for k, v, *_ in rows:
        if k is not None and v is not None and not math.isnan(v):
            by[k].append(v)
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    expected = {(k, q): sorted(vs)[max(1, math.ceil(q * len(vs) - 1e-9)) - 1] for k, vs in by.items() for q in qs}
    got = {(r.key, r.q): r.value for r in hotkeys.keyed_quantiles(df, "k", "v", qs, bins=8).collect()}
    assert got == expected


def test_profile_and_heavy_keys(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA)
    profile = {r.key: r for r in hotkeys.keyed_profile(df, "k", "v", "u", "d", [0.5]).collect()}
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    assert set(profile) == set(by)
    for k, rs in by.items():
        vs = [r[1] for r in rs if r[1] is not None and not math.isnan(r[1])]
        p = profile[k]
        assert p.n_rows == len(rs) and p.n_members == len({r[2] for r in rs if r[2]}) and p.latest == max(r[3] for r in rs)
        assert (p.mean_value is None and not vs) or math.isclose(p.mean_value, sum(vs) / len(vs))
    total = sum(map(len, by.values()))
    heavy = {r.key for r in hotkeys.heavy_keys(df, "k", 0.01).collect()}
    assert heavy == {k for k, rs in by.items() if len(rs) >= 0.01 * total}


@pytest.mark.parametrize("share", [1.0, 0.3, 0.05, 0.001])
def test_heavy_keys_by_selection(spark, share):
    rng = random.Random(4)
    names = [f"k{min(int(rng.paretovariate(0.5)), 900)}" for _ in range(3000)] + ["edge"] * 150 + [None] * 300
    df = spark.createDataFrame([(n, 1) for n in names], "name string, v int").repartition(5)
    counts = Counter(n for n in names if n)
    for bins in (2, 256):
        got = {r.key: r.n_rows for r in hotkeys.heavy_keys(df, "name", share, bins, max_rounds=64).collect()}
        assert got == {k: n for k, n in counts.items() if n >= share * sum(counts.values()) - 1e-9}
    one = spark.createDataFrame([(7,)] * 9, "key long")
    assert [(r.key, r.n_rows) for r in hotkeys.heavy_keys(one, "key", share).collect()] == [(7, 9)]


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hotkeys.keyed_quantiles(empty, "k", "v", [0.5]).count() == 0
    assert hotkeys.keyed_profile(empty, "k", "v", "u", "d").count() == 0
    assert hotkeys.heavy_keys(empty, "k", 0.1).count() == 0
    same = spark.createDataFrame([("a", 2.0, None, None)] * 5 + [("b", None, None, None)], SCHEMA)
    assert [(r.key, r.value) for r in hotkeys.keyed_quantiles(same, "k", "v", [0.5]).collect()] == [("a", 2.0)]
    huge = spark.createDataFrame([("a", -1.7e308), ("a", 1.7e308), ("a", 0.0)], "k string, v double")
    assert hotkeys.keyed_quantiles(huge, "k", "v", [0.5]).first().value == 0.0


@pytest.mark.parametrize("parts", [2, 1024])
def test_hot_split_join(spark, parts):
    rows = skewed(600)
    left = spark.createDataFrame(rows, SCHEMA)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, x int")
    plain = sorted(map(str, left.join(right, "k").collect()))
    assert sorted(map(str, hotkeys.hot_split_join(left, right, "k", parts).select("k", "v", "u", "d", "x").collect())) == plain


def test_places(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)] + [(None,)], "x int")
    assert sorted((r.x, r.idx) for r in dense_index(df, "x").collect()) == [(i, i) for i in range(101)]
    assert sorted(r.p for r in with_place(df, ["x"], "p").collect()) == list(range(102))


def test_quantiles_of_any_spread(spark):
    values = {"wide": [s * 2.0**e for s in (-1, 1) for e in range(-1070, 1024, 3)] + [0.0], "endless": [float("-inf"), *map(float, range(-40, 40)), float("inf"), float("inf")], "one": [float("inf")]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(3)
    qs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    got = {(r.key, r.q): r.value for r in hotkeys.keyed_quantiles(df, "k", "v", qs).collect()}
    assert got == {(k, q): sorted(vs)[max(1, math.ceil(q * len(vs) - 1e-9)) - 1] for k, vs in values.items() for q in qs}
    with pytest.raises(RuntimeError, match="open"):
        hotkeys.keyed_quantiles(df, "k", "v", qs, bins=4, max_rounds=2)
