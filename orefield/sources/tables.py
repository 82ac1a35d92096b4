"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of folder ``sf_dir``; the schema comes from the Parquet footer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: the row with the greatest ``order``.

    One exchange on ``key``; the maximum is combined before it, so copies of a key never travel together.
    Ties on ``order`` are broken by the remaining columns, so the result does not depend on the input order.
    A null ``order`` loses against any value. Rows with a null key are left out.
    """
    names = [c for c in columns if c != key]
    picked = F.struct(F.col(order).alias("__order"), *[F.col(c) for c in names])
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(picked).alias("__row"))
    return kept.select(key, *[F.col(f"__row.{c}").alias(c) for c in names])


def distinct_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per non-null ``key`` where all rows of a key agree on ``columns`` (re-sent copies).

    Any copy serves, so no order column needs to travel; takes the least row when copies differ after all.
    """
    names = [c for c in columns if c != key]
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in names])).alias("__row"))
    return kept.select(key, *[F.col(f"__row.{c}").alias(c) for c in names])


def day_of(column: str | Column) -> Column:
    """The day (YYYY-MM-DD) at the start of a date string."""
    return F.substring(F.col(column) if isinstance(column, str) else column, 1, 10)
