"""Queries: exploration, joins with averages, text, partition layout."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions.text import hashtag_texts, now_text, strip
from orefield.operators import explore
from orefield.plans.registry import CORE
from orefield.session import reused
from orefield.sources.tables import table

YEAR, TOP_USERS, TOP_WORDS, TOP_CATEGORIES, MORE_THAN, PARTITIONS = "2018", 20, 30, 25, 40, 12
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CATEGORIES = f"SELECT b.business_id, {_STRIP.format('c.x')} AS category FROM business b, LATERAL (SELECT unnest(string_split(b.categories, ',')) AS x) c WHERE b.categories IS NOT NULL"


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review")


@CORE.add("review_count", "SELECT count(*) AS n FROM review")
def review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_rows(_review(spark, sf_dir))


@CORE.add("count_year", f"SELECT count(*) FILTER (WHERE substr(date, 1, 4) = '{YEAR}') AS n FROM review")
def count_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_in_year(_review(spark, sf_dir), "date", YEAR)


@CORE.add("count_year_none", "SELECT count(*) FILTER (WHERE substr(date, 1, 4) = '1900') AS n FROM review")
def count_year_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year without rows gives 0."""
    return explore.count_in_year(_review(spark, sf_dir), "date", "1900")


@CORE.add("distinct_users", "SELECT count(DISTINCT user_id) AS n FROM review")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_distinct(_review(spark, sf_dir), "user_id")


@CORE.add("top_users", f"SELECT user_id, count(*) AS n FROM review WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id DESC LIMIT {TOP_USERS}")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_counts(_review(spark, sf_dir), "user_id", TOP_USERS)


@CORE.add(
    "top_words",
    f"""
    SELECT word, count(*) AS n FROM (SELECT unnest(string_split(translate(lower(text), '([,.!?:;])', ''), ' ')) AS word FROM review WHERE text IS NOT NULL)
    WHERE word NOT IN (SELECT word FROM stopwords WHERE word IS NOT NULL) GROUP BY 1 ORDER BY n DESC, word DESC LIMIT {TOP_WORDS}
    """,
)
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_words(_review(spark, sf_dir), "text", table(spark, sf_dir, "stopwords"), TOP_WORDS)


@CORE.add("having_count_gt", f"SELECT business_id, count(*) AS n FROM review WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) > {MORE_THAN}")
def having_count_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.counts_above(_review(spark, sf_dir), "business_id", MORE_THAN)


_AVERAGES = f"""
    c AS ({_CATEGORIES}),
    a AS (SELECT c.category, round(sum(r.stars) / count(r.stars), 6) AS avg_stars, count(r.stars) AS n FROM c JOIN review r ON c.business_id = r.business_id GROUP BY 1)
"""


@CORE.add("category_avg", f"WITH {_AVERAGES} SELECT category, avg_stars, n FROM a")
def category_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_averages(_review(spark, sf_dir), table(spark, sf_dir, "business"))


@CORE.add("category_avg_topn", f"WITH {_AVERAGES} SELECT category, avg_stars FROM a ORDER BY avg_stars DESC, category LIMIT {TOP_CATEGORIES}")
def category_avg_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = explore.category_averages(_review(spark, sf_dir), table(spark, sf_dir, "business")).select("category", "avg_stars")
    return explore.top_by_value(averages, "category", "avg_stars", TOP_CATEGORIES)


@CORE.add("category_avg_all", f"WITH {_AVERAGES} SELECT category, coalesce(avg_stars, 0) AS avg_stars FROM (SELECT DISTINCT category FROM c) LEFT JOIN a USING (category)")
def category_avg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_averages_all(_review(spark, sf_dir), table(spark, sf_dir, "business"))


@CORE.add(
    "left_join_notnull",
    """
    SELECT b.state, count(*) AS n FROM review r LEFT JOIN business b ON r.business_id = b.business_id WHERE b.categories IS NOT NULL GROUP BY 1
    """,
)
def left_join_notnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _review(spark, sf_dir).select("business_id").join(table(spark, sf_dir, "business").select("business_id", "categories", "state"), "business_id", "left")
    return joined.where("categories IS NOT NULL").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("category_values", f"SELECT business_id, category FROM ({_CATEGORIES})")
def category_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories cut at commas and stripped, one row each."""
    business = table(spark, sf_dir, "business").where("categories IS NOT NULL")
    return business.select("business_id", F.explode(F.split("categories", ",")).alias("x")).select("business_id", strip(F.col("x")).alias("category"))


@CORE.add("rows_unmatched", "SELECT r.review_id FROM review r WHERE NOT EXISTS (SELECT 1 FROM user_business u WHERE u.user_id = r.user_id)")
def rows_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join: reviews whose user is not in the sample."""
    return _review(spark, sf_dir).join(table(spark, sf_dir, "user_business").select("user_id"), "user_id", "left_anti").select("review_id")


@CORE.add("rows_matched", "SELECT r.review_id FROM review r WHERE EXISTS (SELECT 1 FROM user_business u WHERE u.user_id = r.user_id)")
def rows_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: reviews whose user is in the sample."""
    return _review(spark, sf_dir).join(table(spark, sf_dir, "user_business").select("user_id"), "user_id", "left_semi").select("review_id")


@CORE.add("bag_union", "SELECT id, count(*) AS n FROM (SELECT business_id AS id FROM review UNION ALL SELECT business_id FROM user_business) GROUP BY 1")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _review(spark, sf_dir).select(F.col("business_id").alias("id")).unionByName(table(spark, sf_dir, "user_business").select(F.col("business_id").alias("id")))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("distinct_pairs", "SELECT DISTINCT user_id, business_id FROM user_business WHERE user_id <> 'user_id'")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "user_business").where("user_id <> 'user_id'").distinct()


@CORE.add("tweet_tags", "SELECT tweet_id, h.text AS tag FROM (SELECT tweet_id, unnest(entities.hashtags) AS h FROM tweet) WHERE h.text IS NOT NULL")
def tweet_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out of the nested array; events without tags yield no row."""
    tags = table(spark, sf_dir, "tweet").select("tweet_id", F.explode(hashtag_texts(F.col("entities"))).alias("tag"))
    return tags.where("tag IS NOT NULL")


@CORE.add("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field out of JSON text, by a declared schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@CORE.add("partition_totals", f"SELECT {PARTITIONS} AS partitions, count(*) AS n FROM review")
def partition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of partitions, empty ones included, and of their rows, after hashing on the business."""
    sizes = explore.partition_sizes(_review(spark, sf_dir).select("business_id"), PARTITIONS, "business_id")
    return sizes.agg(F.count(F.lit(1)).cast("int").alias("partitions"), F.sum("n").alias("n"))


@CORE.add("partition_layout")
def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition of the scan and after hashing on the business."""
    reviews = _review(spark, sf_dir).select("business_id")
    default = explore.partition_sizes(reviews).select(F.lit("scan").alias("layout"), "partition", "n")
    return default.unionByName(explore.partition_sizes(reviews, PARTITIONS, "business_id").select(F.lit("hashed").alias("layout"), "partition", "n"))


#: Parts of the layout by a partition function of the caller's.
PARTS = 7


def md5_number(key: str) -> int:
    """The partition function: the first eight hex digits of the md5 of the key."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


@CORE.add("partition_function", f"WITH n AS (SELECT CASE WHEN business_id IS NULL THEN 0 ELSE CAST('0x' || substr(md5(business_id), 1, 8) AS BIGINT) % {PARTS} END AS p, count(*) AS n FROM review GROUP BY 1) SELECT CAST(i AS INTEGER) AS partition, coalesce(n, 0) AS n FROM range({PARTS}) AS r(i) LEFT JOIN n ON p = i")
def partition_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews in each partition of a function of the business."""
    return explore.layout(explore.partition_by(table(spark, sf_dir, "review").select("business_id"), "business_id", PARTS, md5_number))


@CORE.add("kept_counts", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM review WHERE stars >= 4")
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts over a table that is kept between them."""
    with reused(table(spark, sf_dir, "review").where("stars >= 4").select("user_id")) as kept:
        rows, users = kept.count(), kept.agg(F.count_distinct("user_id")).first()[0]
    return spark.createDataFrame([(rows, users)], "n_rows long, n_users long")


@CORE.add("now_length", "SELECT CAST(length(strftime(now(), '%Y-%m-%d %H:%M:%S')) AS INTEGER) AS n")
def now_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted time has as many characters as its pattern."""
    return spark.range(1).select(F.length(now_text()).alias("n"))
