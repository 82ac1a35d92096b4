"""Queries of problem 2 (packed fields) and problem 3 (hot keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators.hotkeys import heavy_keys, keyed_profile, keyed_quantiles
from orefield.operators.packed import split_packed
from orefield.plans.registry import CORE
from orefield.sources.tables import day_of, distinct_by, latest_by, table


@CORE.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single value of every business row with its place."""
    return split_packed(table(spark, sf_dir, "business"), "categories", ["record_id"], pos="pos", value="cat_value")


#: Characters that make a field more than a list cut at delimiters.
_MARKS = r"""["'“”‘’«»\\\[\]()/\x{2022}\t\n\r]"""


@CORE.add(
    "p2_plain",
    f"""
    WITH f AS (SELECT record_id, list_filter(list_transform(string_split_regex(categories, '[,;|]'), lambda v: trim(v)), lambda v: v <> '') AS vs
               FROM business WHERE categories IS NOT NULL AND NOT regexp_matches(categories, '{_MARKS.replace("'", "''")}'))
    SELECT record_id, CAST(unnest(generate_series(1, len(vs))) AS INTEGER) AS pos, unnest(vs) AS cat_value FROM f
    """,
)
def p2_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of ``p2_found`` in rows without quotes, brackets, slashes and escapes, which SQL can split as well."""
    plain = table(spark, sf_dir, "business").where(~F.col("categories").rlike(_MARKS)).select("record_id")
    return p2_found(spark, sf_dir).join(plain, "record_id", "left_semi")


@CORE.add(
    "p3_found",
    """
    WITH r AS (SELECT review_id, any_value(business_id) AS business_id FROM review WHERE review_id IS NOT NULL GROUP BY 1)
    SELECT business_id FROM r WHERE business_id IS NOT NULL GROUP BY 1
    HAVING count(*) >= 0.01 * (SELECT count(business_id) FROM r)
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses with at least 1 % of the reviews."""
    reviews = distinct_by(table(spark, sf_dir, "review"), "review_id", ["review_id", "business_id"])
    return heavy_keys(reviews, "business_id", 0.01).select(F.col("key").alias("business_id"))


@CORE.add(
    "p3_profile",
    """
    WITH r AS (
      SELECT review_id, any_value(business_id) AS business_id, any_value(user_id) AS user_id, any_value(substr(date, 1, 10)) AS d,
             max_by(stars, loaded_at) AS stars
      FROM review WHERE review_id IS NOT NULL GROUP BY 1)
    SELECT business_id, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, round(avg(stars), 6) AS mean_stars, max(d) AS latest_day,
           quantile_disc(stars, 0.5) AS median_stars
    FROM r WHERE business_id IS NOT NULL GROUP BY 1
    """,
)
def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per business: reviews, users, mean and median stars, latest day."""
    reviews = latest_by(
        table(spark, sf_dir, "review").withColumn("day", day_of("date")), "review_id", "loaded_at", ["review_id", "business_id", "user_id", "stars", "day"]
    )
    profile = keyed_profile(reviews, "business_id", "stars", "user_id", "day", [0.5])
    return profile.select(
        F.col("key").alias("business_id"),
        F.col("n_rows").alias("n_reviews"),
        F.coalesce("n_members", F.lit(0)).alias("n_users"),
        F.round("mean_value", 6).alias("mean_stars"),
        F.col("latest").alias("latest_day"),
        F.col("q50").alias("median_stars"),
    )


@CORE.add(
    "p3_text_quantiles",
    """
    WITH r AS (SELECT review_id, any_value(business_id) AS business_id, any_value(length(text)) AS n FROM review WHERE review_id IS NOT NULL GROUP BY 1),
         v AS (SELECT business_id, n, row_number() OVER (PARTITION BY business_id ORDER BY n) AS k, count(*) OVER (PARTITION BY business_id) AS c
               FROM r WHERE business_id IS NOT NULL AND n IS NOT NULL)
    SELECT business_id, q, CAST(n AS BIGINT) AS n_chars
    FROM v JOIN (VALUES (0.25), (0.5), (0.99)) AS t(q0) ON v.k = greatest(1, ceil(q0 * c - 1e-9)), LATERAL (SELECT CAST(q0 AS DOUBLE) AS q)
    """,
)
def p3_text_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the text length per business, by refinement rounds."""
    reviews = distinct_by(table(spark, sf_dir, "review").withColumn("n", F.length("text")), "review_id", ["review_id", "business_id", "n"])
    found = keyed_quantiles(reviews, "business_id", "n", [0.25, 0.5, 0.99], bins=64)
    return found.select(F.col("key").alias("business_id"), "q", F.col("value").cast("long").alias("n_chars"))
