"""All pairs of records whose sets overlap above a Jaccard threshold: a size-aware overlap join.

Equal sets are one class and take part once. Tokens are ordered by how many sets hold them, rarest first.
*Small* sets (at most ``small`` tokens, by default as many as pays in these data) list the token subsets of the size that any qualifying pair must share, and meet on a subset.
*Large* sets scan inverted lists, among sets of compatible size. Both look only at the rarest part of a set which a qualifying
partner must touch, so lists of frequent tokens are not paired. The union of the pairs is verified by exact overlap.

No window or list ever holds a large set, and no task all sets of a frequent token: the rarest part comes from a histogram of token
frequencies per set, a token that many sets share is split, and the verification joins on (set, token).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.operators.meeting import meet, rare_part, shared_counts, sized_tokens
from orefield.session import cut_lineage


def set_classes(sets: DataFrame, record: str, token: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (record, token) rows, and (record, n, rep) for records with at least ``min_size`` tokens.

    Records with equal sets share ``rep``, the least of them. Sets are compared by size and two xor-sums of 64-bit hashes.
    """
    rows = sets.select(F.col(record).alias("record"), F.col(token).alias("token")).where("record IS NOT NULL AND token IS NOT NULL")
    rows = cut_lineage(rows.distinct())
    sized = (
        rows.groupBy("record")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("token")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("token"))).alias("y"))
        .where(F.col("n") >= min_size)
    )
    rep = sized.groupBy("n", "x", "y").agg(F.min("record").alias("rep"))
    return rows, sized.join(rep, ["n", "x", "y"]).select("record", "n", "rep")


def _least_overlap(threshold: float, a: int, b: int) -> int:
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


#: Largest size that subsets are enumerated for by default, and the most subsets of one set; beyond, lists are scanned.
MOST_SMALL, MOST_SUBSETS = 24, 5_000


def _subset_places(n: int, threshold: float, share: int) -> int:
    """How many of the rarest tokens of a set of ``n`` its subsets of ``share`` tokens are taken from."""
    return min(n, n - max(math.ceil(n * threshold - 1e-9), share) + share)


def size_boundary(rare: DataFrame, threshold: float, share: int) -> int:
    """The size up to which enumerating subsets makes fewer rows than scanning the lists of the rare tokens, added up over the sizes.

    A record met in a list counts as ``share`` rows, as many as it takes at least to verify a pair; pairs from subsets nearly all qualify.
    """
    per = rare.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count_distinct("record").alias("sets"), F.sum("df").alias("scanned"))
    best, balance = 0, 0
    for row in sorted(per.collect()):  # at most MOST_SMALL rows
        subsets = math.comb(_subset_places(row["n"], threshold, share), share)
        if subsets > MOST_SUBSETS:
            break
        balance += row["scanned"] * share - row["sets"] * subsets
        if balance >= 0:
            best = row["n"]
    return best


def overlap_join(sets: DataFrame, record: str, token: str, threshold: float, min_size: int, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (rep_a, rep_b, n_a, n_b, shared, jaccard) with rep_a < rep_b, and the members (record, n, rep).

    Null records and tokens are skipped, repeated rows count once, records below ``min_size`` tokens are not in the result. Complete:
    every pair with ``jaccard >= threshold`` comes out, either as a pair of classes or within one class.
    """
    if not 0 < threshold <= 1 or min_size < 1:
        raise ValueError("threshold must be in (0, 1] and min_size at least 1")
    rows, members = set_classes(sets, record, token, min_size)
    members = cut_lineage(members)
    reps = members.where("record = rep").select("record", "n")
    tokens = cut_lineage(sized_tokens(rows, reps))  # a token of one set pairs nothing

    share = min(_least_overlap(threshold, min_size, min_size), min_size)  # overlap of any qualifying pair, at least
    least = F.ceil(F.col("n") * threshold - 1e-9)  # and of one with a set of n tokens
    rare = cut_lineage(rare_part(tokens, least))  # the n - least + 1 rarest tokens of each set
    if small is None:
        small = size_boundary(rare, threshold, share)

    # small sets: subsets of `share` tokens out of the n - least + share rarest
    lists = (
        tokens.where(F.col("n") <= small)
        .groupBy("record", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("rare"))
        .select("record", "n", F.col("rare.token").alias("rare"), (F.size("rare") - F.greatest(least, F.lit(share)) + F.lit(share)).alias("p"))
        .withColumn("p", F.least(F.col("p"), F.size("rare")).cast("int"))
        .where(F.col("p") >= share)
    )
    spark = sets.sparkSession
    places = lambda n: _subset_places(n, threshold, share)
    chosen = [(p, list(c)) for p in range(share, max(map(places, range(1, small + 1)), default=0) + 1) for c in combinations(range(p), share)]
    subsets = spark.createDataFrame(chosen, "p int, at array<int>") if chosen else spark.createDataFrame([], "p int, at array<int>")
    key = F.xxhash64(*[F.get("rare", F.col("at")[i]) for i in range(share)])
    keyed = lists.join(F.broadcast(subsets), "p").select("record", "n", key.alias("key"))
    pairs = _pairs(keyed, "key", threshold, lambda larger: larger <= small)

    # large sets: inverted lists of the rarest tokens
    near = rare.where(F.col("n") >= math.ceil(threshold * (small + 1) - 1e-9)).select("record", "n", "token")
    pairs = pairs.unionByName(_pairs(near, "token", threshold, lambda larger: larger > small))

    counted = shared_counts(pairs.distinct(), tokens).withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
    return counted.where(F.col("jaccard") >= threshold - 1e-12).withColumnsRenamed({"a": "rep_a", "b": "rep_b"}), members


def _pairs(rows: DataFrame, key: str, threshold: float, larger: Callable[[Column], Column]) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of records of compatible size that share a key; a key that many share is split over tasks."""
    met = meet(rows, [key]).select(F.col("a.record").alias("a"), F.col("b.record").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    compatible = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    return met.where((F.col("a") < F.col("b")) & compatible & larger(F.greatest("n_a", "n_b"))).distinct()


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records (a, b), a < b: those of paired classes and those within a class."""
    left = members.select(F.col("rep").alias("rep_a"), F.col("record").alias("p"))
    right = members.select(F.col("rep").alias("rep_b"), F.col("record").alias("q"))
    across = pairs.select("rep_a", "rep_b").join(left, "rep_a").join(right, "rep_b").select("p", "q")
    copies = members.where("record <> rep").select("rep").distinct()
    inner = members.join(copies, "rep", "left_semi").select("rep", "record")
    within = inner.select("rep", F.col("record").alias("p")).join(inner.select("rep", F.col("record").alias("q")), "rep").where("p < q").select("p", "q")
    both = across.unionByName(within)
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
