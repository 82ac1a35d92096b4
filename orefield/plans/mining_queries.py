"""Queries: frequent itemsets, similarity, sketches, sampling, streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions.hashing import bytes_mod, coefficients, trailing_zeros
from orefield.operators import itemsets, minhash, reservoir, sketches
from orefield.operators.ranking import dense_index, with_place
from orefield.plans.registry import CORE
from orefield.sources.readers import drop_header_rows
from orefield.sources.tables import table
from orefield.streaming.pipelines import run_to_end, stream_fm, stream_reservoir

# --- frequent itemsets -------------------------------------------------------------------------------------------------------

#: An itemset is frequent in at least this share of the baskets.
SHARE, MIN_BASKET, PARTS = 0.025, 3, 4
_PAIRS = "p AS (SELECT DISTINCT user_id, business_id FROM user_business WHERE user_id <> 'user_id' AND business_id IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reviewed what, without the repeated header rows."""
    return drop_header_rows(table(spark, sf_dir, "user_business").select("user_id", "business_id"))


def _joined(rows: DataFrame) -> DataFrame:
    return itemsets.basket_arrays(rows).select("basket", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


def _baskets_sql(basket: str, item: str, least: int = 1) -> str:
    return f"WITH {_PAIRS} SELECT {basket} AS basket, CAST(count(*) AS INTEGER) AS n, string_agg({item}, ',' ORDER BY {item}) AS items FROM p GROUP BY 1 HAVING count(*) >= {least}"


@CORE.add("baskets_case1", _baskets_sql("user_id", "business_id"))
def baskets_case1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(itemsets.baskets(pairs(spark, sf_dir), "user_id", "business_id"))


@CORE.add("baskets_case2", _baskets_sql("business_id", "user_id"))
def baskets_case2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(itemsets.baskets(pairs(spark, sf_dir), "business_id", "user_id"))


@CORE.add("baskets_filtered", _baskets_sql("user_id", "business_id", MIN_BASKET))
def baskets_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(itemsets.baskets(pairs(spark, sf_dir), "user_id", "business_id", MIN_BASKET))


def _itemset_sql(part: str = "0", parts: str = "1") -> str:
    """Itemsets with their counts, grown item by item; per part of the baskets, at the threshold of a part."""
    return f"""
    WITH RECURSIVE {_PAIRS},
    b AS (SELECT business_id AS k, user_id AS i FROM p),
    s AS (SELECT ceil({SHARE} * count(DISTINCT k) - 1e-9) AS support FROM b),
    t AS (SELECT ceil(support / {parts}) AS least FROM s),
    f AS (SELECT i FROM b GROUP BY i HAVING count(*) >= (SELECT support FROM s)),
    q AS (SELECT k, i, {part} AS part FROM b SEMI JOIN f USING (i)),
    h AS (
      SELECT part, k, [i] AS items, i AS last FROM q QUALIFY count(*) OVER (PARTITION BY part, i) >= (SELECT least FROM t)
      UNION ALL
      SELECT part, k, items, last FROM (
        SELECT h.part, h.k, list_append(h.items, q.i) AS items, q.i AS last, count(*) OVER (PARTITION BY h.part, h.items, q.i) AS n
        FROM h JOIN q ON q.k = h.k AND q.i > h.last) WHERE n >= (SELECT least FROM t))
    SELECT array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS size, count(*) AS n FROM h GROUP BY part, h.items
    """


_ITEMSETS = _itemset_sql()


def _rows_and_support(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = itemsets.baskets(pairs(spark, sf_dir), "business_id", "user_id")
    total = rows.agg(F.count_distinct("basket")).first()[0]
    return rows, max(1, math.ceil(total * SHARE - 1e-9))


def _shown(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("items", ",").alias("items"), F.size("items").alias("size"), "n")


@CORE.add("freq_itemsets_levelwise", _ITEMSETS)
def freq_itemsets_levelwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.levelwise(*_rows_and_support(spark, sf_dir)))


@CORE.add("freq_itemsets_son", _ITEMSETS)
def freq_itemsets_son(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.son(*_rows_and_support(spark, sf_dir), partitions=PARTS))


@CORE.add("freq_itemsets_fpgrowth", _ITEMSETS)
def freq_itemsets_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.fp_growth(*_rows_and_support(spark, sf_dir)))


_PARTS = f"least({PARTS}, greatest(1, floor(support / {itemsets.LEAST_LOCAL})))"
_PART = f"CAST('0x' || substr(md5(concat('0-', k)), 1, 8) AS BIGINT) % CAST((SELECT {_PARTS} FROM s) AS BIGINT)"


@CORE.add("son_candidates", f"SELECT DISTINCT items, size FROM ({_itemset_sql(_PART, _PARTS)})")
def son_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass 1 only: what is frequent in a part."""
    found = itemsets.son_candidates(*_rows_and_support(spark, sf_dir), partitions=PARTS)
    return found.select(F.array_join("items", ",").alias("items"), F.size("items").alias("size"))


@CORE.add("itemset_report_lines", f"SELECT size AS k, string_agg(t, ',' ORDER BY items) AS value FROM (SELECT size, items, '(''' || replace(items, ',', ''', ''') || ''')' AS t FROM ({_ITEMSETS})) GROUP BY 1")
def itemset_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.sources.writers import itemset_lines

    return itemset_lines(itemsets.levelwise(*_rows_and_support(spark, sf_dir)))


# --- similarity --------------------------------------------------------------------------------------------------------------

#: Number of hash functions and their modulus.
N_HASHES, MODULUS = 32, 26189
SIG_A, SIG_B = coefficients(N_HASHES, MODULUS, seed=7)
BAND_ROWS, SIMILAR = 1, 0.05
_SETS = """
    s AS (SELECT DISTINCT business_id AS e, user_id AS u FROM user_business WHERE user_id <> 'user_id' AND business_id IS NOT NULL),
    x AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS i FROM (SELECT DISTINCT u FROM s)),
    z AS (SELECT e, count(*) AS n FROM s GROUP BY 1)
"""
_MINHASH = (
    "g AS (SELECT e, ["
    + ", ".join(f"min(({a} * i + {b}) % {MODULUS})" for a, b in zip(SIG_A, SIG_B))
    + "] AS sig FROM s JOIN x USING (u) GROUP BY e), d AS (SELECT e, unnest(range(32)) AS band, unnest(sig) AS h FROM g), c AS (SELECT DISTINCT p.e AS a, q.e AS b FROM d p JOIN d q ON p.band = q.band AND p.h = q.h AND p.e < q.e)"
)
_JACCARD = "j AS (SELECT p.e AS a, q.e AS b, count(*) AS o FROM s p JOIN s q ON p.u = q.u AND p.e < q.e GROUP BY 1, 2)"


def review_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.set_rows(pairs(spark, sf_dir), "business_id", "user_id")


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = review_sets(spark, sf_dir)
    return minhash.signatures(sets, dense_index(sets, "element"), SIG_A, SIG_B, MODULUS)


@CORE.add("element_index", f"WITH {_SETS} SELECT u AS element, i AS idx FROM x")
def element_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(review_sets(spark, sf_dir), "element")


@CORE.add("minhash_signatures", f"WITH {_SETS}, {_MINHASH} SELECT e AS entity, array_to_string(sig, ',') AS sig FROM g")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("entity", F.array_join(F.transform("sig", lambda v: v.cast("string")), ",").alias("sig"))


@CORE.add("lsh_candidates", f"WITH {_SETS}, {_MINHASH} SELECT a, b FROM c")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.candidates(minhash.bands(_signatures(spark, sf_dir), BAND_ROWS))


@CORE.add("lsh_jaccard", f"WITH {_SETS}, {_MINHASH}, {_JACCARD} SELECT a, b, round(o / (za.n + zb.n - o), 6) AS sim FROM c JOIN j USING (a, b) JOIN z za ON za.e = a JOIN z zb ON zb.e = b WHERE o / (za.n + zb.n - o) >= {SIMILAR}")
def lsh_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.lsh_pairs(review_sets(spark, sf_dir), SIMILAR, BAND_ROWS, SIG_A, SIG_B, MODULUS)


@CORE.add("jaccard_exact", f"WITH {_SETS}, {_JACCARD} SELECT a, b, round(o / (za.n + zb.n - o), 6) AS sim FROM j JOIN z za ON za.e = a JOIN z zb ON zb.e = b WHERE o / (za.n + zb.n - o) >= {SIMILAR}")
def jaccard_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.all_pairs(review_sets(spark, sf_dir), SIMILAR)


@CORE.add("lsh_recall", f"WITH {_SETS}, {_MINHASH}, {_JACCARD}, y AS (SELECT a, b FROM j JOIN z za ON za.e = a JOIN z zb ON zb.e = b WHERE o / (za.n + zb.n - o) >= {SIMILAR}) SELECT (SELECT count(*) FROM y) AS n_similar, (SELECT count(*) FROM y JOIN c USING (a, b)) AS n_found")
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the similar pairs share a band."""
    return minhash.lsh_recall(review_sets(spark, sf_dir), SIMILAR, BAND_ROWS, SIG_A, SIG_B, MODULUS)


# --- sketches ----------------------------------------------------------------------------------------------------------------

#: Bloom filter size and number of hash functions.
BLOOM_M, BLOOM_K = 7000, 6
BLOOM_A, BLOOM_B = coefficients(BLOOM_K, BLOOM_M, seed=11)
_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(generate_series(1, octet_length(encode({c}))), lambda i: CAST(concat('0x', substr(hex(encode({c})), 2 * i - 1, 2)) AS BIGINT))), lambda a, v: (a * 256 + v) % {m})"


def _mod_sql(column: str, m: int) -> str:
    return _MOD.format(c=column, m=m)


def _positions_sql(x: str) -> str:
    return "[" + ", ".join(f"({a} * {x} + {b}) % {BLOOM_M}" for a, b in zip(BLOOM_A, BLOOM_B)) + "]"


_BLOOM = f"""
    k AS (SELECT DISTINCT city_name AS c FROM ref_city WHERE city_name IS NOT NULL),
    kx AS (SELECT {_mod_sql("c", BLOOM_M)} AS x FROM k WHERE c <> ''),
    bits AS (SELECT DISTINCT unnest({_positions_sql("x")}) AS position FROM kx)
"""


@CORE.add("hash_positions", f"SELECT DISTINCT city, array_to_string({_positions_sql('x')}, ',') AS positions FROM (SELECT city, {_mod_sql('city', BLOOM_M)} AS x FROM business WHERE city <> '')")
def hash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "business").select("city").where("city <> ''").distinct()
    at = sketches.positions(F.col("city"), BLOOM_A, BLOOM_B, BLOOM_M)
    return cities.select("city", F.array_join(F.transform(at, lambda v: v.cast("string")), ",").alias("positions"))


@CORE.add("bloom_build", f"WITH {_BLOOM} SELECT position FROM bits")
def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.bloom_build(table(spark, sf_dir, "ref_city"), "city_name", BLOOM_A, BLOOM_B, BLOOM_M)


@CORE.add(
    "bloom_probe",
    f"""
    WITH {_BLOOM}, bx AS (SELECT list(position) AS l FROM bits), q AS (SELECT record_id, city, CASE WHEN city <> '' THEN {_mod_sql("city", BLOOM_M)} END AS x FROM business)
    SELECT record_id, CASE WHEN city IS NULL THEN 0 WHEN city = '' THEN 1 WHEN list_has_all(l, {_positions_sql("x")}) THEN 1 ELSE 0 END AS predicted FROM q, bx
    """,
)
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = bloom_build(spark, sf_dir)
    probes = table(spark, sf_dir, "business").select("record_id", "city")
    return sketches.bloom_probe(probes, "city", bits, BLOOM_A, BLOOM_B, BLOOM_M).select("record_id", "predicted")


#: Hash functions, groups and modulus of the distinct-count estimate.
FM_K, FM_GROUPS, FM_M = 40, 10, 500
FM_A, FM_B = coefficients(FM_K, FM_M, seed=13)
WINDOW, SLIDE, LATENESS = "12 hours", "6 hours", "6 hours"
_ZEROS = "CASE WHEN ({h}) = 0 THEN 1 ELSE bit_count((({h}) & -({h})) - 1) END"
_FM_MEANS = "[" + ", ".join("(" + " + ".join(f"pow(2, z{g * 4 + i})" for i in range(4)) + ") / 4" for g in range(FM_GROUPS)) + "]"
_FM = f"""
    e AS (SELECT ts, CAST(user_id AS VARCHAR) AS k FROM events WHERE user_id IS NOT NULL),
    x AS (SELECT ts, k, {_mod_sql("k", FM_M)} AS x FROM e),
    w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + o * INTERVAL 6 HOURS AS window_end, k, x FROM x, (VALUES (1), (2)) AS v(o)),
    m AS (SELECT window_end, count(DISTINCT k) AS truth, {", ".join(f"max({_ZEROS.format(h=f'({a} * x + {b}) % {FM_M}')}) AS z{i}" for i, (a, b) in enumerate(zip(FM_A, FM_B)))} FROM w GROUP BY 1),
    g AS (SELECT window_end, truth, list_sort({_FM_MEANS}) AS l FROM m)
"""


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts"), F.col("user_id").cast("string").alias("k"))


@CORE.add("fm_estimate_windows", f"WITH {_FM} SELECT CAST(epoch(window_end) AS BIGINT) AS window_end, CAST(round_even((l[5] + l[6]) / 2, 0) AS BIGINT) AS estimate, truth FROM g")
def fm_estimate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = keyed_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = sketches.fm_windows(events, "ts", "k", WINDOW, SLIDE, FM_A, FM_B, FM_M, FM_GROUPS)
    return found.select(F.unix_timestamp("window_end").alias("window_end"), "estimate", "truth")


@CORE.add("distinct_ground_truth", f"WITH {_FM} SELECT CAST(epoch(window_end) AS BIGINT) AS window_end, truth FROM g")
def distinct_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = keyed_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    per = events.groupBy(F.window("ts", WINDOW, SLIDE).alias("w")).agg(F.count_distinct("k").alias("truth"))
    return per.select(F.unix_timestamp("w.end").alias("window_end"), "truth")


@CORE.add("trailing_zero_counts", f"SELECT DISTINCT k, {_ZEROS.format(h='x')} AS zeros FROM (SELECT CAST(user_id AS VARCHAR) AS k, {_mod_sql('CAST(user_id AS VARCHAR)', FM_M)} AS x FROM events)")
def trailing_zero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(spark, sf_dir).select("k").distinct().select("k", trailing_zeros(bytes_mod(F.col("k"), FM_M)).alias("zeros"))


# --- sampling ----------------------------------------------------------------------------------------------------------------

RESERVOIR, SEED = 100, 553
_HEX = "CAST('0x' || substr(md5(concat({parts})), 1, 8) AS BIGINT)"
_ACCEPTED = """
    e AS (SELECT row_number() OVER (ORDER BY received_at, tweet_id) AS n, tweet_id, list_filter(list_transform(entities.hashtags, lambda h: h.text), lambda t: t IS NOT NULL) AS tags
          FROM tweet WHERE len(list_filter(entities.hashtags, lambda h: h.text IS NOT NULL)) > 0)
"""
_RESERVOIR = f"""{_ACCEPTED},
    q AS (SELECT *, {_HEX.format(parts=f"'{SEED}-a-', n")} % n + 1 AS r1, {_HEX.format(parts=f"'{SEED}-b-', n")} % {RESERVOIR} + 1 AS r2 FROM e),
    v AS (SELECT *, CASE WHEN n <= {RESERVOIR} THEN n WHEN r1 <= {RESERVOIR} THEN r2 END AS slot FROM q),
    r AS (SELECT slot, max(n) AS n, arg_max(tags, n) AS tags FROM v WHERE slot IS NOT NULL GROUP BY 1)
"""


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with at least one tag, numbered from 1 in order of arrival."""
    tags = F.filter(F.transform("entities.hashtags", lambda h: h["text"]), lambda t: t.isNotNull())
    events = table(spark, sf_dir, "tweet").select("tweet_id", "received_at", tags.alias("tags")).where(F.size("tags") > 0)
    return with_place(events, ["received_at", "tweet_id"], "place").select((F.col("place") + 1).alias("n"), "tags")


@CORE.add("accepted_sequence", f"WITH {_ACCEPTED} SELECT n, array_to_string(tags, ' ') AS tags FROM e")
def accepted_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(spark, sf_dir).select("n", F.array_join("tags", " ").alias("tags"))


@CORE.add("reservoir_final", f"WITH {_RESERVOIR} SELECT slot, n, array_to_string(tags, ' ') AS tags FROM r")
def reservoir_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = reservoir.reservoir(accepted(spark, sf_dir), "n", "tags", RESERVOIR, SEED)
    return sample.select("slot", "n", F.array_join("item", " ").alias("tags"))


@CORE.add(
    "reservoir_top3_tags",
    f"WITH {_RESERVOIR}, t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM r) GROUP BY 1), k AS (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM t) SELECT tag, n, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3",
)
def reservoir_top3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = reservoir.reservoir(accepted(spark, sf_dir), "n", "tags", RESERVOIR, SEED)
    return reservoir.top_frequencies(reservoir.reservoir_tags(sample, "item"), "tag")


@CORE.add(
    "reservoir_reports",
    f"""WITH {_RESERVOIR.split("r AS (")[0].rstrip().rstrip(",")},
    w AS (SELECT n, tags, lead(n) OVER (PARTITION BY slot ORDER BY n) AS gone FROM v WHERE slot IS NOT NULL),
    c AS (SELECT n AS n_from, lead(n) OVER (ORDER BY n) - 1 AS n_to FROM w),
    t AS (SELECT c.n_from, c.n_to, unnest(w.tags) AS tag FROM c JOIN w ON w.n <= c.n_from AND (w.gone IS NULL OR w.gone > c.n_from)),
    k AS (SELECT n_from, n_to, tag, count(*) AS n FROM t GROUP BY 1, 2, 3)
    SELECT n_from, n_to, tag, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, dense_rank() OVER (PARTITION BY n_from ORDER BY n DESC) AS rank FROM k) WHERE rank <= 3""",
)
def reservoir_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report after every accepted event, as ranges of events with the same report."""
    return reservoir.reservoir_reports(accepted(spark, sf_dir), "n", "tags", RESERVOIR, SEED)


@CORE.add("sample_fraction", f"SELECT event_id FROM events WHERE {_HEX.format(parts=f"'{SEED}-', event_id")} < {int(0.2 * (1 << 32))}")
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.sample_fraction(table(spark, sf_dir, "events"), "event_id", 0.2, SEED).select("event_id")


# --- streams -----------------------------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("ts", F.col("user_id").cast("string").alias("k"))


@CORE.add(
    "stream_fm",
    f"""
    WITH {_FM} SELECT CAST(epoch(window_end) AS BIGINT) AS window_end, CAST(round_even((l[5] + l[6]) / 2, 0) AS BIGINT) AS estimate, truth FROM g
    WHERE window_end <= (SELECT max(ts) - INTERVAL 6 HOURS FROM e)
    """,
)
def stream_fm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows a stream over all events has closed."""
    stream = stream_fm(event_stream(spark, sf_dir), "ts", "k", WINDOW, SLIDE, LATENESS, FM_A, FM_B, FM_M, FM_GROUPS)
    found = run_to_end(stream, f"fm_{uuid.uuid4().hex}", "append")
    return found.select(F.unix_timestamp("window_end").alias("window_end"), "estimate", "truth")


@CORE.add("stream_reservoir", f"WITH e AS (SELECT event_id + 1 AS n, event_id FROM events), q AS (SELECT *, {_HEX.format(parts=f"'{SEED}-a-', n")} % n + 1 AS r1, {_HEX.format(parts=f"'{SEED}-b-', n")} % {RESERVOIR} + 1 AS r2 FROM e), v AS (SELECT *, CASE WHEN n <= {RESERVOIR} THEN n WHEN r1 <= {RESERVOIR} THEN r2 END AS slot FROM q) SELECT slot, max(n) AS n, arg_max(event_id, n) AS item FROM v WHERE slot IS NOT NULL GROUP BY 1")
def stream_reservoir_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reservoir a stream over all events has kept; events are numbered by their ids."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select((F.col("event_id") + 1).alias("n"), "event_id")
    return run_to_end(stream_reservoir(events, "n", "event_id", RESERVOIR, SEED), f"reservoir_{uuid.uuid4().hex}", "complete")
