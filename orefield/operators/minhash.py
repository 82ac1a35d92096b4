"""MinHash signatures, LSH bands and Jaccard verification of set-valued records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.hashing import linear_hash
from orefield.functions.vectors import jaccard
from orefield.operators.compact import Sets, agree, in_shares
from orefield.operators.hotkeys import bounded_broadcast, hot_split_join
from orefield.operators.meeting import meet, rare_part, shared_counts, sized_tokens
from orefield.operators.ranking import dense_index
from orefield.session import cut_lineage

#: Rows of an index that are broadcast.
MAX_BROADCAST = 500_000
#: Up to so many (entity, element) rows (counted) go to every task, which compares its share of the entities.
LOCAL_ROWS = 2_000_000


def set_rows(df: DataFrame, entity: str, element: str) -> DataFrame:
    """Distinct (entity, element) rows without nulls."""
    return df.select(F.col(entity).alias("entity"), F.col(element).alias("element")).where("entity IS NOT NULL AND element IS NOT NULL").distinct()


def signatures(sets: DataFrame, index: DataFrame, a: list[int], b: list[int], m: int) -> DataFrame:
    """(entity, sig): for each coefficient pair the least ``(a*i + b) % m`` over the indexes of the entity's elements.

    ``index``: (element, idx); it is broadcast if it is small (counted), else an element of many entities is split. The minima are combined before the exchange on the entity, so large sets are no hot spots.
    """
    small = bounded_broadcast(index, MAX_BROADCAST)
    indexed = (sets.join(small, "element") if small is not index else hot_split_join(sets, index, "element")).select("entity", "idx")
    mins: list[Column] = [F.min(linear_hash(F.col("idx"), x, y, m)).alias(f"h{i}") for i, (x, y) in enumerate(zip(a, b))]
    return indexed.groupBy("entity").agg(*mins).select("entity", F.array(*[f"h{i}" for i in range(len(a))]).alias("sig"))


def bands(sigs: DataFrame, rows: int) -> DataFrame:
    """(entity, band, key): the signature in slices of ``rows``; what is left over at the end is not used."""
    count = F.floor(F.size("sig") / rows).cast("int")
    slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("sig", i * rows + 1, F.lit(rows)))
    return sigs.select("entity", F.posexplode(slices).alias("band", "key"))


def candidates(banded: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a band; a band that many entities share is split over several tasks."""
    met = meet(banded.select("band", "key", "entity"), ["band", "key"])
    return met.select(F.col("a.entity").alias("a"), F.col("b.entity").alias("b")).where("a < b").distinct()


def _sized(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record, token) rows, and the size of each record."""
    rows = sets.select(F.col("entity").alias("record"), F.col("element").alias("token"))
    return rows, rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"))


def _above(counted: DataFrame, threshold: float) -> DataFrame:
    sim = jaccard(F.col("shared"), F.col("n_a"), F.col("n_b"))
    return counted.where(sim >= threshold).select("a", "b", F.round(sim, 6).alias("sim"))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard index of the pairs, at least ``threshold`` (above 0): (a, b, sim)."""
    rows, sizes = _sized(sets)
    sized = pairs.join(sizes.select(F.col("record").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("record").alias("b"), F.col("n").alias("n_b")), "b")
    return _above(shared_counts(sized.select("a", "b", "n_a", "n_b"), rows.join(sizes, "record")), threshold)


def all_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Every pair with a Jaccard index of at least ``threshold`` (above 0): the truth that LSH approaches.

    Sets meet on the shared elements of their rarest part only, never all with all, and hot elements are split; sets whose sizes rule the
    threshold out do not meet.
    """
    rows, sizes = _sized(cut_lineage(sets))
    tokens = cut_lineage(sized_tokens(rows, sizes))
    met = meet(rare_part(tokens, F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9))).drop("df"), ["token"])
    sized = met.select(F.col("a.record").alias("a"), F.col("b.record").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    return _above(shared_counts(sized.where((F.col("a") < F.col("b")) & fits).distinct(), tokens), threshold)


def _held(sets: DataFrame, local_rows: int):
    """The sets as a broadcast of arrays if they have at most ``local_rows`` rows (counted), else None."""
    if not local_rows or sets.count() > local_rows:
        return None
    return sets.sparkSession.sparkContext.broadcast(Sets(sets.select(F.col("entity").alias("record"), F.col("element").alias("token"))))


def _banded(sets: DataFrame, rows: int, a: list[int], b: list[int], m: int) -> DataFrame:
    return candidates(bands(signatures(sets, dense_index(sets, "element"), a, b, m), rows))


def lsh_pairs(sets: DataFrame, threshold: float, rows: int, a: list[int], b: list[int], m: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Pairs that share a band of ``rows`` and have a Jaccard index of at least ``threshold`` (above 0): (a, b, sim).

    Elements are numbered in their order. Most pairs that share a band share no element, and some bands are shared by very many; up to
    ``local_rows`` rows of ``sets`` the pairs meet on elements in tasks that hold all sets, and those that are similar are kept if their
    signatures agree in a band. That is the same set of pairs, without the candidates being written. Beyond, they are, and are verified.
    """
    sets = cut_lineage(sets)
    held = _held(sets, local_rows)
    if not held:
        return verify(_banded(sets, rows, a, b, m), sets, threshold)
    kind = sets.schema["entity"].dataType.simpleString()

    def compare(share: int, shares: int) -> Iterator[pa.RecordBatch]:
        own = held.value
        sigs = own.signatures(a, b, m)
        for x, y, sim in own.similar(share, shares, threshold):
            kept = np.flatnonzero(agree(sigs, x, y, rows))
            yield pa.RecordBatch.from_arrays([own.names.take(pa.array(x[kept])), own.names.take(pa.array(y[kept])), pa.array(sim[kept])], ["a", "b", "sim"])

    return in_shares(sets.sparkSession, compare, f"a {kind}, b {kind}, sim double").withColumn("sim", F.round("sim", 6))


def lsh_recall(sets: DataFrame, threshold: float, rows: int, a: list[int], b: list[int], m: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row (n_similar, n_found): pairs with a Jaccard index of at least ``threshold``, and those of them that share a band.

    Up to ``local_rows`` rows every task counts for its share of the entities, as in ``lsh_pairs``, and no pair leaves it.
    """
    sets = cut_lineage(sets)
    held = _held(sets, local_rows)
    if not held:
        found = _banded(sets, rows, a, b, m).withColumn("found", F.lit(1))
        return all_pairs(sets, threshold).select("a", "b").join(found, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n_similar"), F.count("found").alias("n_found"))

    def compare(share: int, shares: int) -> Iterator[pa.RecordBatch]:
        own = held.value
        sigs = own.signatures(a, b, m)
        n_similar = n_found = 0
        for x, y, _ in own.similar(share, shares, threshold):
            n_similar, n_found = n_similar + len(x), n_found + int(agree(sigs, x, y, rows).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_similar]), pa.array([n_found])], ["n_similar", "n_found"])

    return in_shares(sets.sparkSession, compare, "n_similar long, n_found long").agg(F.sum("n_similar").alias("n_similar"), F.sum("n_found").alias("n_found"))
