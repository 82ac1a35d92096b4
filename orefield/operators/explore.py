"""Exploration of review-like tables: counts, top-k, joins with averages, partition layout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions.text import blank_tokens, clean_lower, list_values, year_of


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_in_year(df: DataFrame, date: str, year: str) -> DataFrame:
    """Rows of one year; 0 where there is none."""
    return df.agg(F.count_if(year_of(F.col(date)) == year).alias("n"))


def count_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def top_counts(df: DataFrame, key: str, m: int) -> DataFrame:
    """The ``m`` most frequent non-null keys; ties by the greater key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.desc(key)).limit(m)


def top_words(df: DataFrame, text: str, stop_words: DataFrame, m: int) -> DataFrame:
    """The ``m`` most frequent tokens that are not stop words. ``stop_words`` has a column ``word``; its size decides the join."""
    words = df.where(F.col(text).isNotNull()).select(F.explode(blank_tokens(clean_lower(F.col(text)))).alias("word"))
    # counting first leaves one row per distinct word for the anti-join
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(stop_words.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), F.desc("word")).limit(m)


def counts_above(df: DataFrame, key: str, n: int) -> DataFrame:
    """Non-null keys with more than ``n`` rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)


def category_averages(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """Mean stars per category over all (review, business row, category) combinations: (category, avg_stars, n).

    Stars are summed per business before the join, so one row per business is joined, not one per review.
    """
    per_business = reviews.where("business_id IS NOT NULL").groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("c"))
    joined = business.where("categories IS NOT NULL").select("business_id", "categories").join(per_business, "business_id")
    exploded = joined.select(F.explode(list_values(F.col("categories"))).alias("category"), "s", "c")
    sums = exploded.groupBy("category").agg(F.sum("s").alias("s"), F.sum("c").alias("n"))
    return sums.select("category", F.round(F.col("s") / F.when(F.col("n") > 0, F.col("n")), 6).alias("avg_stars"), "n")


def category_averages_all(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """As ``category_averages``, for every category of ``business``; 0 where none of its businesses has a review."""
    every = business.where("categories IS NOT NULL").select(F.explode(list_values(F.col("categories"))).alias("category")).distinct()
    return every.join(category_averages(reviews, business), "category", "left").select("category", F.coalesce("avg_stars", F.lit(0.0)).alias("avg_stars"))


def top_by_value(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` rows with the greatest value; ties by the smaller key."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(n)


def partition_by(df: DataFrame, key: str, partitions: int, function: Callable[[str], int]) -> DataFrame:
    """``df`` with each row in the partition ``function(key) % partitions``, for a partition function of the caller's.

    The function runs once per distinct key of an Arrow batch; a null key goes to partition 0.
    """

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        codes, names = pd.factorize(keys)
        numbers = np.array([function(n) % partitions for n in names] + [0], dtype=np.int32)  # the last one for code -1
        return pd.Series(numbers[codes])

    return df.withColumn("__partition", number(F.col(key))).repartitionById(partitions, F.col("__partition")).drop("__partition")


def partition_sizes(df: DataFrame, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Rows in each partition, empty ones included: (partition, n); after hashing on ``key`` into ``partitions`` if given."""
    spread = df if partitions is None else (df.repartition(partitions, key) if key else df.repartition(partitions))
    return layout(spread)


def layout(spread: DataFrame) -> DataFrame:
    """Rows in each partition of ``spread`` as it is laid out, empty ones included: (partition, n)."""
    df, total = spread, spread.rdd.getNumPartitions()
    counts = spread.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(total).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))
