"""Queries that count and compare: problems 1, 4, 6 and 7."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm.frequency import marked_frequencies, words_of
from orefield.llm.heavy import iceberg
from orefield.llm.overlap import expand_pairs, overlap_join
from orefield.llm.queries import LLM
from orefield.llm.setsketch import SketchSpec, joint_estimates, merge_sketches, sketch_sets, with_estimates
from orefield.operators.hotkeys import bounded_broadcast, hot_split_join
from orefield.operators.packed import split_field_udf
from orefield.session import cut_lineage
from orefield.sources.tables import day_of, distinct_by, latest_by, table

RARE, COMMON = 2, 0.22


def review_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review with the array of its words."""
    return distinct_by(table(spark, sf_dir, "review"), "review_id", ["review_id", "text"]).select(words_of("text").alias("terms"))


def business_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per business with the array of its lower-case categories."""
    latest = latest_by(table(spark, sf_dir, "business"), "business_id", "updated_at", ["business_id", "categories"])
    return latest.select(F.transform(split_field_udf("categories"), lambda v: F.lower(v)).alias("terms"))


@LLM.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and categories in too few or too many records."""
    parts = [
        marked_frequencies(records, "terms", RARE, COMMON).where("mark IS NOT NULL").select(F.lit(field).alias("field"), F.col("terms")[0].alias("term"), "mark")
        for field, records in (("text", review_words(spark, sf_dir)), ("categories", business_categories(spark, sf_dir)))
    ]
    return parts[0].unionByName(parts[1])


@LLM.add(
    "p1_text_marks",
    r"""
    WITH r AS (SELECT review_id, any_value(text) AS text FROM review WHERE review_id IS NOT NULL GROUP BY 1),
    t AS (SELECT review_id, unnest(list_filter(string_split_regex(translate(lower(text), '([,.!?:;])', ''), '[ \t\n\r]+'), lambda x: x <> '')) AS term FROM r),
    n AS (SELECT term, count(DISTINCT review_id) AS k FROM t GROUP BY 1)
    SELECT term, CASE WHEN k <= 2 THEN 'rare' ELSE 'common' END AS mark FROM n WHERE k <= 2 OR k > 0.22 * (SELECT count(*) FROM r)
    """,
)
def p1_text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words among ``p1_found``."""
    return p1_found(spark, sf_dir).where("field = 'text'").select("term", "mark")


_WORDS = r"""
    r AS (SELECT review_id, any_value(text) AS text FROM review WHERE review_id IS NOT NULL GROUP BY 1),
    w AS (SELECT review_id, list_filter(string_split_regex(translate(lower(text), '([,.!?:;])', ''), '[ \t\n\r]+'), lambda x: x <> '') AS terms FROM r)
"""


@LLM.add(
    "p1_word_counts",
    "WITH" + _WORDS + """,
    t AS (SELECT review_id, unnest(terms) AS term FROM w)
    SELECT term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT review_id) AS BIGINT) AS records,
           CASE WHEN count(DISTINCT review_id) <= 2 THEN 'rare' WHEN count(DISTINCT review_id) > 0.22 * (SELECT count(*) FROM r) THEN 'common' END AS mark
    FROM t GROUP BY 1
    """,
)
def p1_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every word of the reviews."""
    counts = marked_frequencies(review_words(spark, sf_dir), "terms", RARE, COMMON)
    return counts.select(F.col("terms")[0].alias("term"), "occurrences", "records", "mark")


@LLM.add(
    "p1_phrases",
    "WITH" + _WORDS + """,
    g AS (SELECT review_id, k, unnest(list_transform(generate_series(1, len(terms) - k + 1), lambda i: list_aggregate(terms[i:i + k - 1], 'string_agg', ' '))) AS phrase
          FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(terms) >= k)
    SELECT phrase, k AS n_words, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT review_id) AS BIGINT) AS records FROM g GROUP BY 1, 2
    """,
)
def p1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every phrase of one to three words."""
    counts = marked_frequencies(review_words(spark, sf_dir), "terms", RARE, COMMON, max_len=3)
    return counts.select(F.array_join("terms", " ").alias("phrase"), F.size("terms").alias("n_words"), "occurrences", "records")


def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tag entry of each tweet taken once: lower case, without surrounding blanks and one leading #."""
    tweets = distinct_by(table(spark, sf_dir, "tweet"), "tweet_id", ["tweet_id", "entities"])
    blank = "^[\\s\\u00a0]+|[\\s\\u00a0]+$"
    tag = F.lower(F.regexp_replace("item", blank, ""))
    tags = tweets.select(F.explode("entities.hashtags").alias("h")).select(F.col("h.text").alias("item")).where("item IS NOT NULL")
    tags = tags.select(F.regexp_replace(F.regexp_replace(tag, "^#", ""), blank, "").alias("item"))
    return tags.where("item <> ''")


def reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of each review taken once."""
    return distinct_by(table(spark, sf_dir, "review"), "review_id", ["review_id", "user_id"]).select(F.col("user_id").alias("item"))


def _heavy(spark: SparkSession, sf_dir: str, support: float) -> DataFrame:
    parts = [iceberg(items, "item", support).select(F.lit(field).alias("field"), "item", "n", "bound") for field, items in (("hashtag", hashtags(spark, sf_dir)), ("user_id", reviewers(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


_ITEMS = r"""
    WITH tw AS (SELECT tweet_id, any_value(entities) AS e FROM tweet WHERE tweet_id IS NOT NULL GROUP BY 1),
    h AS (SELECT unnest(e.hashtags) AS h FROM tw),
    tags AS (SELECT trim(regexp_replace(lower(trim(h.text, E' \t\n\r')), '^#', ''), E' \t\n\r') AS item FROM h WHERE h.text IS NOT NULL),
    items AS (
      SELECT 'hashtag' AS field, item FROM tags WHERE item <> ''
      UNION ALL
      SELECT 'user_id', u FROM (SELECT review_id, any_value(user_id) AS u FROM review WHERE review_id IS NOT NULL GROUP BY 1) WHERE u IS NOT NULL),
    n AS (SELECT field, item, count(*) AS n FROM items GROUP BY 1, 2),
    s AS (SELECT field, sum(n) AS total FROM n GROUP BY 1)
"""


@LLM.add("p4_found", _ITEMS + "SELECT field, item FROM n JOIN s USING (field) WHERE n >= 0.01 * total")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags and users with at least 1 % of the entries."""
    return _heavy(spark, sf_dir, 0.01).select("field", "item")


@LLM.add("p4_counts", _ITEMS + "SELECT field, item, CAST(n AS BIGINT) AS n FROM n JOIN s USING (field) WHERE n >= 0.001 * total")
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags and users with at least 0.1 % of the entries, with their counts."""
    return _heavy(spark, sf_dir, 0.001).select("field", "item", "n")


MIN_USERS, OVERLAP = 5, 0.5

_SETS = """
    WITH s AS (SELECT DISTINCT business_id AS b, user_id AS u FROM review WHERE business_id IS NOT NULL AND user_id IS NOT NULL),
    z AS (SELECT b, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5),
    p AS (SELECT x.b AS a, y.b AS b, count(*) AS o FROM s x JOIN s y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2),
    q AS (SELECT p.a, p.b, p.o / (za.n + zb.n - p.o) AS j FROM p JOIN z za ON za.b = p.a JOIN z zb ON zb.b = p.b WHERE p.o >= 0.5 * (za.n + zb.n - p.o))
"""


@LLM.add("p6_found", _SETS + "SELECT a AS business_id_a, b AS business_id_b FROM q")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of businesses whose users overlap by at least half."""
    pairs, members = overlap_join(table(spark, sf_dir, "review"), "business_id", "user_id", OVERLAP, MIN_USERS)
    return expand_pairs(pairs, members).select(F.col("a").alias("business_id_a"), F.col("b").alias("business_id_b"))


@LLM.add("p6_links", _SETS + "SELECT business_id, count(*) AS n_links FROM (SELECT a AS business_id FROM q UNION ALL SELECT b FROM q) GROUP BY 1")
def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per business with a partner: the number of its partners. Copies are counted by class, not expanded."""
    pairs, members = overlap_join(table(spark, sf_dir, "review"), "business_id", "user_id", OVERLAP, MIN_USERS)
    members = cut_lineage(members)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    pairs = cut_lineage(pairs.select("rep_a", "rep_b"))
    both = pairs.unionByName(pairs.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    across = both.join(sizes.withColumnRenamed("rep", "rep_b"), "rep_b").groupBy(F.col("rep_a").alias("rep")).agg(F.sum("copies").alias("across"))
    links = sizes.join(across, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("across", F.lit(0))).alias("n_links")).where("n_links > 0")
    return hot_split_join(members, links, "rep").select(F.col("record").alias("business_id"), "n_links")


SPEC = SketchSpec(m=1024, b=1.001, a=20.0, sparse=256)
MIN_DISTINCT = 100
#: No true count lies between 0.9 and 1.25 of the wanted number. Estimates are cut in the middle of that gap, 4.8 standard errors or more
#: from either end.
CUT = MIN_DISTINCT * math.sqrt(0.9 * 1.25)
REF_CITIES = 10_000


def city_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city_name, review_day, user_id) of the reviews of businesses whose city is an entry of the list but for blanks, tabs and case."""
    key = F.lower(F.regexp_replace("city", "^[ \\t]+|[ \\t]+$", ""))
    cities = table(spark, sf_dir, "ref_city").select("city_name", F.lower("city_name").alias("city_key")).dropDuplicates(["city_key"])
    business = latest_by(table(spark, sf_dir, "business"), "business_id", "updated_at", ["business_id", "city"]).select("business_id", key.alias("city_key"))
    placed = cut_lineage(business.join(bounded_broadcast(cities, REF_CITIES), "city_key").select("business_id", "city_name"))
    reviews = table(spark, sf_dir, "review").where("user_id IS NOT NULL AND business_id IS NOT NULL").select("business_id", day_of("date").alias("review_day"), "user_id")
    return hot_split_join(reviews, placed, "business_id").select("city_name", "review_day", "user_id")


_CITY_REVIEWS = r"""
    WITH b AS (SELECT business_id, arg_max(city, updated_at) AS city FROM business WHERE business_id IS NOT NULL GROUP BY 1),
    c AS (SELECT b.business_id, r.city_name FROM b JOIN ref_city r ON lower(r.city_name) = lower(trim(b.city, E' \t'))),
    v AS (SELECT c.city_name, substr(r.date, 1, 10) AS review_day, r.user_id FROM review r JOIN c ON r.business_id = c.business_id WHERE r.user_id IS NOT NULL)
"""


@LLM.add("p7_found", _CITY_REVIEWS + "SELECT city_name, review_day FROM v GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 100")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and day with at least 100 distinct users, by estimates from registers."""
    counted = with_estimates(sketch_sets(city_reviews(spark, sf_dir), ["city_name", "review_day"], "user_id", SPEC), SPEC)
    return counted.where(F.col("n_distinct") >= CUT).select("city_name", "review_day")


@LLM.add("p7_counts")
def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per city and day, per city (rolled up from the sketches of both), and per day over all reviews."""
    both = cut_lineage(sketch_sets(city_reviews(spark, sf_dir), ["city_name", "review_day"], "user_id", SPEC))
    every = table(spark, sf_dir, "review").select(day_of("date").alias("review_day"), "user_id")
    none = F.lit(None).cast("string")
    levels = [
        both.select(F.lit("city and day").alias("level"), "city_name", "review_day", "is_sparse", "payload"),
        merge_sketches(both, ["city_name"], SPEC).select(F.lit("city").alias("level"), "city_name", none.alias("review_day"), "is_sparse", "payload"),
        sketch_sets(every, ["review_day"], "user_id", SPEC).select(F.lit("day").alias("level"), none.alias("city_name"), "review_day", "is_sparse", "payload"),
    ]
    counted = with_estimates(levels[0].unionByName(levels[1]).unionByName(levels[2]), SPEC)
    return counted.select("level", "city_name", "review_day", F.round("n_distinct").cast("long").alias("n_users"), "rel_error")


_EXACT = _CITY_REVIEWS + """, n AS (
    SELECT 'city and day' AS level, city_name, review_day, count(DISTINCT user_id) AS n FROM v GROUP BY 2, 3
    UNION ALL SELECT 'city', city_name, NULL, count(DISTINCT user_id) FROM v GROUP BY 2
    UNION ALL SELECT 'day', NULL, substr(date, 1, 10), count(DISTINCT user_id) FROM review WHERE user_id IS NOT NULL GROUP BY 3)
"""


@LLM.add("p7_coverage", _EXACT + "SELECT level, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_users, TRUE AS within_stated_error FROM n GROUP BY 1")
def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimates keep their stated error: 95 % of all cells, and 90 % of each level, within two standard errors of the exact count."""
    estimated = cut_lineage(p7_counts(spark, sf_dir))
    reviews = cut_lineage(city_reviews(spark, sf_dir).distinct())
    every = table(spark, sf_dir, "review").where("user_id IS NOT NULL").select(day_of("date").alias("review_day"), "user_id").distinct()
    none = F.lit(None).cast("string")
    n = F.count(F.lit(1)).alias("n")
    exact = [
        reviews.groupBy("city_name", "review_day").agg(n).select(F.lit("city and day").alias("level"), "city_name", "review_day", "n"),
        reviews.select("city_name", "user_id").distinct().groupBy("city_name").agg(n).select(F.lit("city").alias("level"), "city_name", none.alias("review_day"), "n"),
        every.groupBy("review_day").agg(n).select(F.lit("day").alias("level"), none.alias("city_name"), "review_day", "n"),
    ]
    truth = exact[0].unionByName(exact[1]).unionByName(exact[2])
    same = [estimated[c].eqNullSafe(truth[c]) for c in ("level", "city_name", "review_day")]
    joined = truth.join(estimated, same[0] & same[1] & same[2], "left").select(truth["level"], "n", (F.abs(F.col("n_users") - F.col("n")) <= 2 * F.col("rel_error") * F.col("n") + 0.5).alias("near"))
    levels = joined.groupBy("level").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_users"), F.count_if("near").alias("near"))
    total = levels.agg((F.sum("near") >= 0.95 * F.sum("n_cells")).alias("all_near"))
    return levels.crossJoin(F.broadcast(total)).select("level", "n_cells", "n_users", (F.col("all_near") & (F.col("near") >= 0.9 * F.col("n_cells"))).alias("within_stated_error"))


@LLM.add("p7_joint")
def p7_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each two cities of a state: users of either, of both, and their Jaccard index with its standard error."""
    sketches = cut_lineage(sketch_sets(city_reviews(spark, sf_dir), ["city_name"], "user_id", SPEC))
    states = table(spark, sf_dir, "ref_city").select("city_name", "state")
    placed = sketches.join(bounded_broadcast(states, REF_CITIES), "city_name")
    a = placed.select("state", F.col("city_name").alias("city_a"), F.col("is_sparse").alias("is_sparse_a"), F.col("payload").alias("payload_a"))
    b = placed.select("state", F.col("city_name").alias("city_b"), F.col("is_sparse").alias("is_sparse_b"), F.col("payload").alias("payload_b"))
    pairs = a.join(b, "state").where("city_a < city_b")
    return joint_estimates(pairs, SPEC)
