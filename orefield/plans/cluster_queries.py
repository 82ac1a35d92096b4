"""Queries: K-Means and BFR on the embedding vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions.vectors import euclidean, normalised_distance
from orefield.operators import cluster
from orefield.plans.registry import CORE
from orefield.session import cut_lineage
from orefield.sources.tables import table

K, ROUNDS, ALPHA, DIM = 5, 3, 1.02, 64
_POINTS = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f, label FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(generate_series(1, len({a})), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"
_NORM = "sqrt(list_sum(list_transform(generate_series(1, len({a})), lambda i: pow(({a}[i] - {b}[i]) / CASE WHEN {s}[i] = 0 THEN 1 ELSE {s}[i] END, 2))))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def start_points(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """The K points of least id."""
    return [list(r["features"]) for r in points(spark, sf_dir).orderBy("point_id").limit(K).collect()]


def _lloyd_sql(rounds: int) -> str:
    steps = [_POINTS, f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, f FROM p ORDER BY id LIMIT {K})"]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT p.id, p.f, c.k, row_number() OVER (PARTITION BY p.id ORDER BY {_DIST.format(a='p.f', b='c.f')}, c.k DESC) AS n FROM p, c{r} c)")
        steps.append(f"a{r} AS (SELECT id, f, k FROM d{r} WHERE n = 1)")
        steps.append(f"m{r} AS (SELECT k, i, avg(x) AS x FROM (SELECT k, unnest(generate_series(1, {DIM})) AS i, unnest(f) AS x FROM a{r}) GROUP BY 1, 2)")
        steps.append(f"c{r + 1} AS (SELECT k, list(x ORDER BY i) AS f FROM m{r} GROUP BY 1)")
    return "WITH " + ", ".join(steps)


@CORE.add("kmeans_assign", f"{_lloyd_sql(0)} SELECT id AS point_id, CAST(k AS INTEGER) AS cluster FROM a0")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(points(spark, sf_dir), list(enumerate(start_points(spark, sf_dir)))).select("point_id", "cluster")


@CORE.add("kmeans_lloyd3", f"{_lloyd_sql(ROUNDS)} SELECT id AS point_id, CAST(k AS INTEGER) AS cluster FROM a{ROUNDS}")
def kmeans_lloyd3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = cluster.kmeans(points(spark, sf_dir), start_points(spark, sf_dir), max_rounds=ROUNDS, tol=-1.0)
    return found.select("point_id", "cluster")


@CORE.add("kmeans_centroids3", f"{_lloyd_sql(ROUNDS)} SELECT CAST(k AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) AS x FROM m{ROUNDS - 1}")
def kmeans_centroids3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centroids = cluster.kmeans(points(spark, sf_dir), start_points(spark, sf_dir), max_rounds=ROUNDS, tol=-1.0)
    rows = spark.createDataFrame(centroids, "cluster int, f array<double>")
    return rows.select("cluster", F.posexplode("f").alias("dim", "x")).select("cluster", "dim", F.round("x", 6).alias("x"))


_SUMMARY = """
    u AS (SELECT label AS c, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q, avg(x) AS m, stddev_pop(x) AS d
          FROM (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(f) AS x FROM p {where}) GROUP BY 1, 2)
"""


@CORE.add("cluster_summary", f"WITH {_POINTS}, {_SUMMARY.format(where='')} SELECT c AS cluster, CAST(i - 1 AS INTEGER) AS dim, n, round(s, 6) AS s, round(q, 6) AS q, round(m, 6) AS centroid, round(d, 6) AS deviation FROM u")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N, SUM, SUMSQ, centroid and deviation per label and dimension."""
    labelled = points(spark, sf_dir).select("point_id", "features", F.col("label").alias("cluster"))
    sums = cluster.summaries(labelled)
    stats = cluster.centroids_of(sums).select("cluster", "centroid", "deviation")
    zipped = F.arrays_zip("sum", "sumsq", "centroid", "deviation")
    rows = sums.join(stats, "cluster").select("cluster", "n", F.posexplode(zipped).alias("dim", "z"))
    return rows.select("cluster", "dim", "n", *[F.round(F.col(f"z.{a}"), 6).alias(b) for a, b in (("sum", "s"), ("sumsq", "q"), ("centroid", "centroid"), ("deviation", "deviation"))])


_DS = f"{_POINTS}, {_SUMMARY.format(where='')}, g AS (SELECT c, list(m ORDER BY i) AS m, list(d ORDER BY i) AS d, max(n) AS n, list(s ORDER BY i) AS s, list(q ORDER BY i) AS q FROM u GROUP BY 1)"
_LIMIT = ALPHA * math.sqrt(DIM)


def _ds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[int, cluster.Summary]]:
    every = cut_lineage(points(spark, sf_dir))
    known = every.select("point_id", "features", F.col("label").alias("cluster"))
    return every, known, cluster._collect_summaries(known)


@CORE.add("bfr_assign_ds", f"WITH {_DS}, z AS (SELECT p.id, min(g.c) AS c FROM p, g WHERE {_NORM.format(a='p.f', b='g.m', s='g.d')} < {_LIMIT} GROUP BY 1) SELECT p.id AS point_id, coalesce(z.c, -1) AS cluster FROM p LEFT JOIN z ON p.id = z.id")
def bfr_assign_ds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the first cluster within reach, -1 if none."""
    every, _, ds = _ds(spark, sf_dir)
    return every.select("point_id", F.coalesce(cluster.first_within(every, cluster._stats(ds), _LIMIT), F.lit(-1)).alias("cluster"))


@CORE.add("normalised_distances", f"WITH {_DS} SELECT p.id AS point_id, g.c AS cluster, round({_NORM.format(a='p.f', b='g.m', s='g.d')}, 6) AS d FROM p JOIN g ON p.label = g.c")
def normalised_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, known, _ = _ds(spark, sf_dir)
    stats = cluster.centroids_of(cluster.summaries(known)).select("cluster", "centroid", "deviation")
    joined = every.withColumnRenamed("label", "cluster").join(stats, "cluster")
    return joined.select("point_id", "cluster", F.round(normalised_distance(F.col("features"), F.col("centroid"), F.col("deviation")), 6).alias("d"))


@CORE.add("euclidean_distances", f"WITH {_DS} SELECT p.id AS point_id, g.c AS cluster, round({_DIST.format(a='p.f', b='g.m')}, 6) AS d FROM p JOIN g ON p.label = g.c")
def euclidean_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, known, _ = _ds(spark, sf_dir)
    stats = cluster.centroids_of(cluster.summaries(known)).select("cluster", "centroid")
    joined = every.withColumnRenamed("label", "cluster").join(stats, "cluster")
    return joined.select("point_id", "cluster", F.round(euclidean(F.col("features"), F.col("centroid")), 6).alias("d"))


@CORE.add("bfr_merge", f"WITH {_POINTS}, u AS (SELECT label % 3 AS c, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(f) AS x FROM p) GROUP BY 1, 2) SELECT c AS cluster, CAST(i - 1 AS INTEGER) AS dim, n, round(s, 6) AS s, round(q, 6) AS q FROM u")
def bfr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the labels merged into three clusters, from the summaries alone."""
    labelled = points(spark, sf_dir).select("point_id", "features", F.col("label").alias("cluster"))
    merged: dict[int, cluster.Summary] = {}
    for i, s in cluster._collect_summaries(labelled).items():
        merged[i % 3] = merged[i % 3].merged(s) if i % 3 in merged else s
    rows = spark.createDataFrame([(i, s.n, s.total, s.squares) for i, s in merged.items()], "cluster int, n long, s array<double>, q array<double>")
    return rows.select("cluster", "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "z")).select("cluster", "dim", "n", F.round("z.s", 6).alias("s"), F.round("z.q", 6).alias("q"))


def in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points in four rounds."""
    return points(spark, sf_dir).select("point_id", "features", (F.pmod("point_id", F.lit(4)) + 1).cast("int").alias("round"))


def _bfr(spark: SparkSession, sf_dir: str) -> cluster.BfrState:
    return cluster.bfr(in_rounds(spark, sf_dir), K, alpha=ALPHA)


def _number(seed: int, *parts: str) -> str:
    """``seeded_number`` in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('-', '{seed}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _kmeans_sql(name: str, points: str, start: str, seed: int) -> list[str]:
    """``name``: K-Means over ``points`` (id, f) from ``start`` (k, f) until no centroid moves, as a recursive table with one row per
    iteration; ``name_a``: (id, f, k), the points with their last centroid."""
    nearest = "len({c}) - list_position(list_reverse(list_transform({c}, lambda x: list_distance(x, {f}))), list_min(list_transform({c}, lambda x: list_distance(x, {f}))))"
    again = f"list_min(list_transform(members, lambda m: {{'h': {_number(seed, 'r', 'j - 1', 'm.id')}, 'id': m.id, 'f': m.f}})).f"
    mean = f"list_transform(range(1, {DIM + 1}), lambda i: list_avg(list_transform(list_filter(members, lambda m: m.k = j - 1), lambda m: m.f[i])))"
    return [
        f"""{name} AS (
        SELECT 0 AS r, (SELECT list(f ORDER BY k) FROM {start}) AS c, CAST(1e9 AS DOUBLE) AS moved
        UNION ALL
        SELECT r + 1, new, list_max(list_transform(range(1, len(new) + 1), lambda j: list_distance(c[j], new[j])))
        FROM (SELECT r, c, list_transform(range(1, len(c) + 1), lambda j: CASE WHEN len(list_filter(members, lambda m: m.k = j - 1)) > 0 THEN {mean} ELSE {again} END) AS new
              FROM (SELECT r, c, list({{'id': id, 'f': f, 'k': {nearest.format(c='c', f='f')}}} ORDER BY id) AS members
                    FROM {name}, {points} WHERE moved > 1e-4 AND r < 100 GROUP BY r, c)))""",
        f"{name}_c AS MATERIALIZED (SELECT c FROM {name} ORDER BY r DESC LIMIT 1)",
        f"{name}_a AS MATERIALIZED (SELECT id, f, {nearest.format(c='c', f='f')} AS k FROM {points}, {name}_c)",
    ]


def _stats_sql(name: str, members: str) -> str:
    """``name``: (c, n, m, d), size, mean and deviation of the clusters of ``members`` (id, f, c)."""
    return f"""{name} AS MATERIALIZED (SELECT c, max(n) AS n, list(m ORDER BY i) AS m, list(d ORDER BY i) AS d FROM (
        SELECT c, i, count(*) AS n, avg(x) AS m, stddev_pop(x) AS d FROM (SELECT c, unnest(generate_series(1, {DIM})) AS i, unnest(f) AS x FROM {members}) GROUP BY 1, 2) GROUP BY 1)"""


def _bfr_sql() -> str:
    """The rounds of ``bfr`` with its defaults, table by table."""
    seed, inside = 7, int(0.2 * (1 << 32))
    norm = lambda a, b, s: _NORM.format(a=a, b=b, s=s)
    steps = [
        f"{_POINTS.replace('p AS (', 'p AS MATERIALIZED (', 1)}",
        f"s AS MATERIALIZED (SELECT id, f FROM p WHERE id % 4 = 0 AND {_number(seed, 'id')} < {inside})",
        f"l1 AS MATERIALIZED (SELECT id, f FROM p WHERE id % 4 = 0 AND {_number(seed, 'id')} >= {inside})",
        f"w AS MATERIALIZED (SELECT id, f, row_number() OVER (ORDER BY {_number(seed, chr(39) + 'start' + chr(39), 'id')}, id) AS n FROM s QUALIFY n <= {6 * K})",
        f"""v AS (SELECT g AS k, list(m ORDER BY i) AS f FROM (SELECT g, i, avg(x) AS m FROM (
            SELECT g, unnest(generate_series(1, {DIM})) AS i, unnest(f) AS x FROM (SELECT f, (row_number() OVER (ORDER BY id) - 1) // 6 AS g FROM w)) GROUP BY 1, 2) GROUP BY 1)""",
        f"start1 AS MATERIALIZED (SELECT k, f FROM v WHERE (SELECT count(*) FROM w) = {6 * K} UNION ALL SELECT n - 1, f FROM w WHERE n <= {K} AND (SELECT count(*) FROM w) < {6 * K})",
        *_kmeans_sql("kd", "s", "start1", seed),
        "ds1 AS MATERIALIZED (SELECT id, f, k AS c FROM kd_a)",
        _stats_sql("g", "ds1"),
        f"start2 AS MATERIALIZED (SELECT n - 1 AS k, f FROM (SELECT f, row_number() OVER (ORDER BY {_number(seed, chr(39) + 'start' + chr(39), 'id')}, id) AS n FROM l1) WHERE n <= {2 * K})",
        *_kmeans_sql("kc", "l1", "start2", seed),
        "z1 AS (SELECT k FROM kc_a GROUP BY 1 HAVING count(*) > 1)",
        "cs1 AS MATERIALIZED (SELECT id, f, k AS c FROM kc_a WHERE k IN (SELECT k FROM z1))",
        "rs1 AS MATERIALIZED (SELECT id, f FROM kc_a WHERE k NOT IN (SELECT k FROM z1))",
        _stats_sql("h1", "cs1"),
    ]
    for t in range(2, 5):
        q = t - 1
        steps += [
            f"b{t} AS (SELECT id, f FROM p WHERE id % 4 = {q})",
            f"""y{t} AS MATERIALIZED (SELECT b.id, b.f, (SELECT min(c) FROM g WHERE {norm('b.f', 'g.m', 'g.d')} < {_LIMIT}) AS ds,
                (SELECT min(c) FROM h{q} h WHERE {norm('b.f', 'h.m', 'h.d')} < {_LIMIT}) AS cs FROM b{t} b)""",
            f"ds{t} AS MATERIALIZED (SELECT * FROM ds{q} UNION ALL SELECT id, f, ds FROM y{t} WHERE ds IS NOT NULL)",
            f"cq{t} AS MATERIALIZED (SELECT * FROM cs{q} UNION ALL SELECT id, f, cs FROM y{t} WHERE ds IS NULL AND cs IS NOT NULL)",
            f"rq{t} AS MATERIALIZED (SELECT * FROM rs{q} UNION ALL SELECT id, f FROM y{t} WHERE ds IS NULL AND cs IS NULL)",
            f"l{t} AS MATERIALIZED (SELECT * FROM rq{t} WHERE (SELECT count(*) FROM rq{t}) > {4 * K})",
            f"startl{t} AS MATERIALIZED (SELECT n - 1 AS k, f FROM (SELECT f, row_number() OVER (ORDER BY {_number(seed + t, chr(39) + 'start' + chr(39), 'id')}, id) AS n FROM l{t}) WHERE n <= {2 * K})",
            *_kmeans_sql(f"kl{t}", f"l{t}", f"startl{t}", seed + t),
            f"z{t} AS (SELECT k FROM kl{t}_a GROUP BY 1 HAVING count(*) > 1)",
            f"new{t} AS MATERIALIZED (SELECT id, f, k AS c FROM kl{t}_a WHERE k IN (SELECT k FROM z{t}))",
            _stats_sql(f"e{t}", f"new{t}"),
            f"""hit{t} AS MATERIALIZED (SELECT e.c, (SELECT min(h.c) FROM h{q} h WHERE least({norm('e.m', 'h.m', 'h.d')}, {norm('h.m', 'e.m', 'e.d')}) < {_LIMIT}) AS old FROM e{t} e)""",
            f"to{t} AS MATERIALIZED (SELECT c, coalesce(old, (SELECT count(DISTINCT c) FROM cq{t}) + 99 + row_number() OVER (PARTITION BY old IS NULL ORDER BY c)) AS target FROM hit{t})",
            f"cs{t} AS MATERIALIZED (SELECT * FROM cq{t} UNION ALL SELECT id, f, target FROM new{t} JOIN to{t} USING (c))",
            f"rs{t} AS MATERIALIZED (SELECT * FROM rq{t} WHERE (SELECT count(*) FROM rq{t}) <= {4 * K} UNION ALL SELECT id, f FROM kl{t}_a WHERE k NOT IN (SELECT k FROM z{t}))",
            _stats_sql(f"hn{t}", f"cs{t}"),
            f"h{t} AS MATERIALIZED (SELECT * FROM h{q} WHERE (SELECT count(*) FROM l{t}) = 0 UNION ALL SELECT * FROM hn{t} WHERE (SELECT count(*) FROM l{t}) > 0)",
        ]
    return "WITH RECURSIVE " + ",\n".join(steps)


_BFR = _bfr_sql()
_ROUND = "SELECT {t} AS round, (SELECT count(DISTINCT c) FROM ds{t}) AS ds_clusters, (SELECT count(*) FROM ds{t}) AS ds_points, (SELECT count(DISTINCT c) FROM cs{t}) AS cs_clusters, (SELECT count(*) FROM cs{t}) AS cs_points, (SELECT count(*) FROM rs{t}) AS rs_points"


@CORE.add("bfr_rounds", _BFR + " SELECT CAST(round AS INTEGER) AS round, CAST(ds_clusters AS INTEGER) AS ds_clusters, ds_points, CAST(cs_clusters AS INTEGER) AS cs_clusters, cs_points, rs_points FROM (" + " UNION ALL ".join(_ROUND.format(t=t) for t in range(1, 5)) + ")")
def bfr_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six round statistics."""
    return cluster.round_report(_bfr(spark, sf_dir), spark)


@CORE.add(
    "bfr_final",
    _BFR
    + """, near AS (SELECT h.c, arg_min(g.c, {'d': list_distance(h.m, g.m), 'k': -g.c}) AS ds FROM h4 h, g GROUP BY 1)
    SELECT id AS point_id, CAST(c AS INTEGER) AS cluster FROM ds4 UNION ALL SELECT id, CAST(near.ds AS INTEGER) FROM cs4 JOIN near USING (c) UNION ALL SELECT id, -1 FROM rs4""",
)
def bfr_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with its cluster, -1 for those retained."""
    return cluster.bfr_labels(_bfr(spark, sf_dir))
