import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.llm.frequency import marked_frequencies, term_frequencies, words_of
from orefield.llm.heavy import iceberg
from orefield.llm.overlap import expand_pairs, overlap_join
from orefield.llm.setsketch import SketchSpec, joint_estimate, merge_sketches, sketch_sets, with_estimates


def brute_ngrams(records, max_len):
    cf, df = Counter(), Counter()
    for terms in records:
        terms = [t for t in terms or [] if t is not None]
        grams = [tuple(terms[i : i + n]) for n in range(1, max_len + 1) for i in range(len(terms) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (cf[g], df[g]) for g in cf}


@pytest.mark.parametrize("max_len", [1, 2, 4])
def test_ngrams(spark, max_len):
    rng = random.Random(max_len)
    records = [[rng.choice("abcde") if rng.random() > 0.4 else "hot" for _ in range(rng.randint(0, 12))] for _ in range(150)]
    records += [None, [], ["solo"], ["hot"] * 500, [None, "a", None], ["a", "a"], [""]]
    df = spark.createDataFrame([(r, "x") for r in records], "t array<string>, occurrences string").repartition(5)
    got = {tuple(r["terms"]): (r["occurrences"], r["records"]) for r in term_frequencies(df, "t", max_len).collect()}
    root = got.pop(())
    assert root == (sum(len([t for t in r or [] if t is not None]) for r in records), len(records))
    assert got == brute_ngrams(records, max_len)


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_stack_goes_on_over_batches(spark, size):
    records = [["a", "b", "c"][k % 3 :] + ["a"] * (k % 4) for k in range(60)]
    df = spark.createDataFrame([(r,) for r in records], "t array<string>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {tuple(r["terms"]): (r["occurrences"], r["records"]) for r in term_frequencies(df, "t", 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.pop(()) == (sum(map(len, records)), 60) and got == brute_ngrams(records, 3)


def test_marks_and_words(spark):
    df = spark.createDataFrame([(["a", "b", "b"],), (["a"],), (["a", "c"],), (None,)], "t array<string>")
    got = {r["terms"][0]: (r["occurrences"], r["records"], r["mark"]) for r in marked_frequencies(df, "t", 1, 0.5).collect()}
    assert got == {"a": (3, 3, "common"), "b": (2, 1, "rare"), "c": (1, 1, "rare")}
    assert marked_frequencies(df.limit(0), "t", 1, 0.5).count() == 0
    text = spark.createDataFrame([("Hi,  (THERE)\t!\nyou",), (None,), ("",)], "s string").select(words_of("s").alias("w"))
    assert [r.w for r in text.collect()] == [["hi", "there", "you"], None, []]


def test_iceberg(spark):
    rng = random.Random(2)
    items = ["hot"] * 900 + [f"x{rng.randint(0, 900)}" for _ in range(2000)] + ["edge"] * 30 + [None] * 50 + [""] * 40
    counts = Counter(i for i in items if i is not None)
    total = sum(counts.values())
    df = spark.createDataFrame([(i, 1) for i in items], "v string, n int").repartition(6)
    for support, buckets in ((0.01, 1 << 12), (30 / total, 1 << 10)):
        got = {r["item"]: r["n"] for r in iceberg(df, "v", support, buckets=buckets).collect()}
        assert got == {i: n for i, n in counts.items() if n >= support * total}
    bounds = iceberg(df, "v", 0.01, buckets=512).collect()
    assert all(r.bound >= r.n for r in bounds)
    assert iceberg(df.limit(0), "v", 0.01).count() == 0
    with pytest.raises(ValueError):
        iceberg(df, "v", 0.001, buckets=100)


def make_sets(seed):
    rng = random.Random(seed)
    sets = {f"s{k:03d}": {f"u{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 40))} for k in range(60)}
    names = list(sets)
    for k in range(40):
        base = sets[rng.choice(names)]
        copy = {u for u in base if rng.random() > 0.2} | {f"v{rng.randint(0, 900)}" for _ in range(rng.randint(0, 3))}
        sets[f"c{k:03d}"] = copy or {"one"}
    for k in range(8):
        sets[f"same{k}"] = set(sets["s005"]) | {"hot"}
    for s in list(sets.values())[::2]:
        s.add("hot")
    return sets


@pytest.mark.parametrize("threshold,least,small", [(0.5, 5, 12), (0.8, 2, 6), (0.3, 3, 8), (1.0, 1, 12), (0.5, 5, 0), (0.5, 5, None), (0.7, 2, None)])
def test_overlap_join(spark, threshold, least, small):
    sets = make_sets(int(threshold * 10) + least)
    rows = [(s, u, 1) for s, us in sets.items() for u in us]
    rows += rows[:50] + [(None, "u1", 1), ("s001", None, 1)]
    df = spark.createDataFrame(rows, "s string, u string, n int")
    pairs, members = overlap_join(df, "s", "u", threshold, least, small)
    got = {(r.a, r.b) for r in expand_pairs(pairs, members).collect()}
    big = {s: us for s, us in sets.items() if len(us) >= least}
    expected = {(a, b) for a, b in combinations(sorted(big), 2) if len(big[a] & big[b]) >= threshold * len(big[a] | big[b]) - 1e-12}
    assert got == expected


def test_overlap_join_empty(spark):
    pairs, members = overlap_join(spark.createDataFrame([], "s string, u string"), "s", "u", 0.5, 5)
    assert expand_pairs(pairs, members).count() == 0


SPEC = SketchSpec(m=512, b=1.001, sparse=64)


def test_sketch_counts(spark):
    sizes = {"a": 10, "b": 64, "c": 65, "d": 3000, "e": 30_000}
    rows = spark.createDataFrame(list(sizes.items()), "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("u"), F.lit("x").alias("payload"))
    rows = rows.unionByName(rows.where("u % 3 = 0")).unionByName(spark.createDataFrame([("a", None, "x"), ("f", None, "x"), (None, 7, "x")], "g string, u int, payload string")).repartition(7)
    got = {r.g: r for r in with_estimates(sketch_sets(rows, ["g"], "u", SPEC, rows=5000), SPEC).collect()}
    assert set(got) == {*sizes, None}
    for g, n in sizes.items():
        r = got[g]
        assert r.is_sparse == (n <= 64)
        assert abs(r.n_distinct / n - 1) < 4 * r.rel_error and r.rel_error == SPEC.count_error
    assert sketch_sets(rows.limit(0), ["g"], "u", SPEC).count() == 0


def test_registers_do_not_depend_on_the_way_they_are_drawn():
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63 - 1, 40_000)
    for spec in (SPEC, SketchSpec(m=16, b=1.5)):
        for n in (1, 60, 500, 40_000):
            few = spec.registers(np.min([spec._all_values(part.astype(np.uint64)).min(axis=0) for part in np.array_split(hashes[:n], -(-n // 1000))], axis=0))
            assert (spec.dense(hashes[:n], np.array([0]))[0] == few).all()
        groups = np.array([0, 1, 3, 70, 200, 5000])
        many = spec.dense(hashes, groups)
        for g, (s, e) in enumerate(zip(groups, [*groups[1:], len(hashes)])):
            assert (many[g] == spec.dense(hashes[s:e], np.array([0]))[0]).all()


def test_counts_keep_their_stated_error():
    rng = np.random.default_rng(4)
    for n in (1, 4, 40, 90, 125, 2000):
        off = np.array([SPEC.cardinality(SPEC.dense(rng.integers(-(2**63), 2**63 - 1, n), np.array([0]))[0]) / n - 1 for _ in range(200)])
        assert (abs(off) < 2 * SPEC.count_error).mean() >= 0.9 and np.sqrt((off**2).mean()) < 1.3 * SPEC.count_error


def test_sketches_merge_like_unions(spark):
    rows = spark.range(6000).select((F.col("id") % 5).cast("string").alias("g"), F.lit("all").alias("h"), (F.col("id") % 4000).alias("u"))
    direct = with_estimates(sketch_sets(rows, ["h"], "u", SPEC), SPEC).first()
    rolled = with_estimates(merge_sketches(sketch_sets(rows, ["g", "h"], "u", SPEC), ["h"], SPEC), SPEC).first()
    assert bytes(direct.payload) == bytes(rolled.payload) and direct.n_distinct == rolled.n_distinct


def test_joint_estimates():
    rng = np.random.default_rng(1)
    for both, only_a, only_b in ((2000, 2000, 2000), (5000, 100, 100), (0, 3000, 3000), (500, 0, 4500)):
        x = rng.integers(-(2**63), 2**63 - 1, both + only_a + only_b)
        ku, kv = SPEC.dense(x[: both + only_a], np.array([0]))[0], SPEC.dense(np.r_[x[:both], x[both + only_a :]], np.array([0]))[0]
        j, union, error = joint_estimate(SPEC, ku, kv)
        assert abs(j - both / len(x)) < 4.5 * error + 0.001
        assert abs(union / len(x) - 1) < 6 * SPEC.count_error
