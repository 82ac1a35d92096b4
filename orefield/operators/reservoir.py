"""Reservoir sampling (algorithm R) as a relation, tag counts, and fixed-fraction samples.

The n-th accepted event goes to slot n while n <= s; later it is taken if r1(n) <= s, into slot r2(n), with r1 uniform in 1..n and r2 in
1..s, both derived from md5(seed, n). The content of a slot is the event with the greatest n that went there, so the reservoir is a
``max_by`` per slot: it merges in any order and needs no sequential state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions.hashing import seeded_number
from orefield.operators.ranking import with_place


def slot_of(n: Column, size: int, seed: int) -> Column:
    """The slot of event ``n`` (from 1), null if it is not taken."""
    r1 = F.pmod(seeded_number(seed, F.lit("a"), n), n) + 1
    r2 = F.pmod(seeded_number(seed, F.lit("b"), n), F.lit(size)) + 1
    return F.when(n <= size, n).when(r1 <= size, r2)


def reservoir(events: DataFrame, n: str, item: str, size: int, seed: int) -> DataFrame:
    """(slot, n, item): the reservoir after all events. ``n`` numbers the accepted events from 1."""
    placed = events.select(F.col(n).cast("long").alias("n"), F.col(item).alias("item")).withColumn("slot", slot_of(F.col("n"), size, seed)).where("slot IS NOT NULL")
    return placed.groupBy("slot").agg(F.max("n").alias("n"), F.max_by("item", "n").alias("item"))


def top_frequencies(items: DataFrame, tag: str, ranks: int = 3) -> DataFrame:
    """Tags with one of the ``ranks`` highest distinct frequencies, ties all kept: (tag, n, rank).

    The input is a reservoir's tags, so the window over all counts is over a bounded table.
    """
    counts = items.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"))))
    return ranked.where(F.col("rank") <= ranks)


def reservoir_tags(sample: DataFrame, item: str) -> DataFrame:
    """The tags in a reservoir of tag arrays, one per row."""
    return sample.select(F.explode(item).alias("tag")).where("tag IS NOT NULL")


def reservoir_reports(events: DataFrame, n: str, item: str, size: int, seed: int, ranks: int = 3) -> DataFrame:
    """The tags of highest frequency after *every* event: (n_from, n_to, tag, n, rank).

    The reservoir only changes at events that are taken, ``size * (1 + ln(events / size))`` of them; the report of a row holds after each
    of the events ``n_from .. n_to`` (null: until now), also those whose event was not taken. A taken event is in the reservoir from its
    own change until its slot is taken again, and counts in the reports between.
    """
    taken = events.select(F.col(n).cast("long").alias("n"), F.col(item).alias("item")).withColumn("slot", slot_of(F.col("n"), size, seed)).where("slot IS NOT NULL")
    taken = with_place(taken, ["n"], "place")
    starts = taken.select(F.col("place").alias("at"), F.col("n").alias("n_from"))
    follows = Window.partitionBy("slot").orderBy("n")  # a few rows per slot
    total = taken.agg(F.max("place").alias("last"))
    lived = taken.withColumn("until", F.lead("place").over(follows)).crossJoin(F.broadcast(total))
    shown = lived.select("item", F.explode(F.sequence("place", F.coalesce(F.col("until") - 1, F.col("last")))).alias("at")).select("at", F.explode("item").alias("tag"))
    counts = shown.where("tag IS NOT NULL").groupBy("at", "tag").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.dense_rank().over(Window.partitionBy("at").orderBy(F.desc("n")))).where(F.col("rank") <= ranks)
    ends = starts.select((F.col("at") - 1).alias("at"), (F.col("n_from") - 1).alias("n_to"))
    return ranked.join(starts, "at").join(ends, "at", "left").select("n_from", "n_to", "tag", "n", "rank")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The rows whose seeded hash falls below ``fraction``: the same in any engine and for any partitioning, without a shuffle."""
    return df.where(seeded_number(seed, F.col(key)) < F.lit(int(fraction * (1 << 32))))
