import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.functions.hashing import bytes_mod, coefficients, trailing_zeros
from orefield.operators import explore, itemsets, minhash, reservoir, sketches


def brute_itemsets(sets, support):
    out = {}
    for k in range(1, max(map(len, sets), default=0) + 1):
        counts = Counter(c for s in sets for c in combinations(sorted(s), k))
        level = {c: n for c, n in counts.items() if n >= support}
        if not level:
            break
        out |= level
    return out


@pytest.mark.parametrize("support", [2, 3, 50])
def test_itemsets_agree(spark, support):
    rng = random.Random(support)
    sets = [{f"i{rng.randint(0, 6)}" for _ in range(rng.randint(1, 5))} for _ in range(25)] + [{"a", "b"}] * 3
    pairs = [(f"b{k}", i) for k, s in enumerate(sets) for i in s] * 2 + [(None, "x"), ("b1", None)]
    rows = itemsets.baskets(spark.createDataFrame(pairs, "b string, i string"), "b", "i")
    expected = brute_itemsets(sets, support)
    for found in (itemsets.levelwise(rows, support), itemsets.son(rows, support, 3), itemsets.fp_growth(rows, support)):
        assert {tuple(r["items"]): r["n"] for r in found.collect()} == expected
    candidates = {tuple(r["items"]) for r in itemsets.son_candidates(rows, support, 3).collect()}
    assert set(expected) <= candidates


@pytest.mark.parametrize("size", [1, 22])
def test_long_baskets_at_low_support(spark, size):
    pairs = [("long", f"i{k:02d}") for k in range(22)] + [("other", f"i{k:02d}") for k in range(7)] + [(f"b{k}", f"i{k:02d}") for k in range(size)]
    rows = itemsets.baskets(spark.createDataFrame(pairs, "b string, i string"), "b", "i")
    sets = [{i for b, i in pairs if b == name} for name in {b for b, _ in pairs}]
    common = sets[0].__class__.union(*[a & b for a, b in combinations(sets, 2)])
    expected = brute_itemsets([s & common for s in sets], 2) if len(common) < 10 else None
    got = {tuple(r["items"]): r["n"] for r in itemsets.son(rows, 2, 4).collect()}
    assert got == expected if expected is not None else len(got) == 2**7 - 1 + 15


def test_local_mining():
    rng = random.Random(3)
    for support in (1, 2, 4):
        sets = [sorted({rng.randint(0, 8) for _ in range(rng.randint(0, 6))}) for _ in range(20)]
        owner = np.array([k for k, s in enumerate(sets) for _ in s], dtype=np.int64)
        flat = np.array([i for s in sets for i in s], dtype=np.int64)
        found = list(itemsets.mine_local(owner, flat, support))
        assert len(found) == len(set(found)) and set(found) == set(brute_itemsets([set(s) for s in sets if s], support))


def test_parts_of_the_two_pass_algorithm():
    assert itemsets.son_parts(1000, 2, 8) == 1 and itemsets.son_parts(1000, 9, 4) == 2 and itemsets.son_parts(1000, 100, 8) == 8
    assert itemsets.son_parts(5 * itemsets.PART_ROWS, 100, 2) == 5
    assert itemsets.son_parts(5 * itemsets.PART_ROWS, 4, 2) is None


def test_parts_that_do_not_fit_are_mined_over_tables(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "PART_ROWS", 10)
    sets = [{"a", "b", "c"}, {"a", "b"}, {"a", "c"}, {"a", "b", "c"}, {"d"}]
    rows = itemsets.baskets(spark.createDataFrame([(f"b{k}", i) for k, s in enumerate(sets) for i in s], "b string, i string"), "b", "i")
    assert {tuple(r["items"]): r["n"] for r in itemsets.son(rows, 2, 4).collect()} == brute_itemsets(sets, 2)


def test_itemsets_empty(spark):
    rows = itemsets.baskets(spark.createDataFrame([], "b string, i string"), "b", "i")
    assert itemsets.levelwise(rows, 1).count() == itemsets.fp_growth(rows, 1).count() == itemsets.son(rows, 1).count() == 0


def test_big_integer_hash(spark):
    words = ["", "a", "Zürich", "São Lúvio", "x" * 300, "😀"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    got = {r.w: r.h for r in df.select("w", bytes_mod(F.col("w"), 7000).alias("h")).collect()}
    assert got == {w: int.from_bytes(w.encode(), "big") % 7000 for w in words} | {None: None}
    zeros = spark.range(500).select("id", trailing_zeros(F.col("id")).alias("z")).collect()
    assert all(r.z == len(bin(r.id)) - len(bin(r.id).rstrip("0")) for r in zeros)


def test_bloom_has_no_false_negatives(spark):
    a, b = coefficients(6, 7000, 1)
    keys = [f"key {i}" for i in range(200)]
    bits = sketches.bloom_build(spark.createDataFrame([(k,) for k in [*keys, keys[0], None, ""]], "k string"), "k", a, b, 7000)
    probes = spark.createDataFrame([(k,) for k in [*keys, "", None, "absent one"]], "k string")
    got = {r.k: r.predicted for r in sketches.bloom_probe(probes, "k", bits, a, b, 7000).collect()}
    assert all(got[k] == 1 for k in keys) and got[""] == 1 and got[None] == 0
    strict = {r.k: r.predicted for r in sketches.bloom_probe(probes, "k", bits, a, b, 7000, empty_is_member=False).collect()}
    assert strict[""] == 0 and strict[keys[3]] == 1


def test_fm_follows_the_definition(spark):
    a, b = coefficients(8, 500, 2)
    keys = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(bytes_mod(F.col("k"), 500).alias("x"))
    row = df.agg(*sketches.fm_maxima(F.col("x"), a, b, 500)).withColumn("e", sketches.fm_estimate(8, 2)).first()
    tz = lambda v: len(bin(v)) - len(bin(v).rstrip("0"))
    z = [max(tz((i * (int.from_bytes(k.encode(), "big") % 500) + j) % 500) for k in keys) for i, j in zip(a, b)]
    means = sorted(sum(2.0**v for v in z[g * 4 : g * 4 + 4]) / 4 for g in range(2))
    assert row.e == round(sum(means) / 2)


def test_lsh_is_inside_exact(spark):
    rng = random.Random(5)
    pairs = [(f"e{k}", f"u{rng.randint(0, 40)}") for k in range(30) for _ in range(rng.randint(1, 12))]
    sets = minhash.set_rows(spark.createDataFrame([*pairs, *pairs[:5], (None, "u1")], "e string, u string"), "e", "u")
    index = spark.createDataFrame([(f"u{i}", i) for i in range(41)], "element string, idx long")
    sigs = minhash.signatures(sets, index, *coefficients(16, 26189, 4), 26189)
    found = {(r.a, r.b, r.sim) for r in minhash.verify(minhash.candidates(minhash.bands(sigs, 2)), sets, 0.2).collect()}
    exact = {(r.a, r.b, r.sim) for r in minhash.all_pairs(sets, 0.2).collect()}
    by = {}
    for e, u in pairs:
        by.setdefault(e, set()).add(u)
    brute = {(a, b, round(len(by[a] & by[b]) / len(by[a] | by[b]), 6)) for a, b in combinations(sorted(by), 2) if len(by[a] & by[b]) / len(by[a] | by[b]) >= 0.2}
    assert exact == brute and found <= exact


def test_reports_after_every_event(spark):
    events = [(n, [f"t{n * n % 5}", f"t{n % 3}"] if n % 4 else [f"t{n % 7}"]) for n in range(1, 200)]
    df = spark.createDataFrame(events, "n long, tags array<string>")
    slots = {r.n: r.slot for r in df.select("n", reservoir.slot_of(F.col("n"), 10, 3).alias("slot")).collect()}
    rows = reservoir.reservoir_reports(df, "n", "tags", 10, 3).collect()
    held = {}
    for n, tags in events:
        if slots[n] is not None:
            held[slots[n]] = tags
        counts = Counter(t for ts in held.values() for t in ts)
        top = sorted(set(counts.values()), reverse=True)[:3]
        expected = {(t, c, top.index(c) + 1) for t, c in counts.items() if c in top}
        assert {(r.tag, r.n, r.rank) for r in rows if r.n_from <= n and (r.n_to is None or n <= r.n_to)} == expected
    assert reservoir.reservoir_reports(df.limit(0), "n", "tags", 10, 3).count() == 0


def test_partition_function(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [(None, 99)], "k string, partitions int")
    placed = explore.partition_by(df, "k", 4, lambda k: int(k[1:]))
    assert placed.columns == df.columns
    assert {(r.partitions, r.p) for r in placed.select("partitions", F.spark_partition_id().alias("p")).collect()} == {(i, i % 4) for i in range(50)} | {(99, 0)}
    assert [r.n for r in explore.layout(placed).orderBy("partition").collect()] == [14, 13, 12, 12]


def test_reservoir(spark):
    events = spark.range(1, 1001).select(F.col("id").alias("n"), F.concat(F.lit("t"), F.col("id") % 7).alias("t"))
    sample = reservoir.reservoir(events, "n", "t", 100, 9)
    assert sample.count() == 100
    again = reservoir.reservoir(events.repartition(7), "n", "t", 100, 9)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))
    assert reservoir.reservoir(events.limit(30), "n", "t", 100, 9).count() == 30
    ties = spark.createDataFrame([(t,) for t in "aabbcdeef"], "tag string")
    got = {(r.tag, r.n) for r in reservoir.top_frequencies(ties, "tag", 2).collect()}
    assert got == {("a", 2), ("b", 2), ("e", 2), ("c", 1), ("d", 1), ("f", 1)}


def test_exploration_edge_cases(spark):
    reviews = spark.createDataFrame([("r1", "u1", "b1", 4.0, "2018-01-01", "Hi,  (there)!\nYou hi"), ("r2", "u2", "b1", None, "2018-05-01", None), ("r3", None, "b9", 2.0, None, "")], "review_id string, user_id string, business_id string, stars double, date string, text string")
    business = spark.createDataFrame([("b1", " A , B,A"), ("b1", "A"), ("b2", "C"), ("b3", None)], "business_id string, categories string")
    got = {r.category: (r.avg_stars, r.n) for r in explore.category_averages(reviews, business).collect()}
    assert got == {"A": (4.0, 3), "B": (4.0, 1)}
    assert {r.category: r.avg_stars for r in explore.category_averages_all(reviews, business).collect()} == {"A": 4.0, "B": 4.0, "C": 0.0}
    assert explore.count_in_year(reviews, "date", "1999").first().n == 0
    stop = spark.createDataFrame([("you",), (None,)], "word string")
    words = {r.word: r.n for r in explore.top_words(reviews, "text", stop, 10).collect()}
    assert words == {"hi": 2, "": 2, "there\nyou": 1} or words == {"hi": 2, "": 2, "there\nyou": 1, "you": 1}
    assert [r.n for r in explore.partition_sizes(spark.range(3).repartition(1), 5, "id").orderBy("partition").collect()].count(0) >= 2
