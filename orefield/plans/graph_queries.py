"""Queries: co-review graph, label propagation, components, betweenness, modularity, Girvan-Newman."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import graph
from orefield.plans.mining_queries import pairs
from orefield.plans.registry import CORE
from orefield.session import cut_lineage

#: Items two users must share for an edge; more for the graph that is cut.
SHARED, SHARED_CUT, ROUNDS, DEPTH = 3, 5, 5, 12


def _edges_sql(t: int) -> str:
    return f"""
    s AS (SELECT DISTINCT user_id AS n, business_id AS i FROM user_business WHERE user_id <> 'user_id' AND business_id IS NOT NULL),
    h AS (SELECT p.n AS u, q.n AS v FROM s p JOIN s q ON p.i = q.i AND p.n < q.n GROUP BY 1, 2 HAVING count(*) >= {t}),
    e AS (SELECT u AS src, v AS dst FROM h UNION ALL SELECT v, u FROM h)
    """


def edges(spark: SparkSession, sf_dir: str, t: int = SHARED) -> DataFrame:
    return graph.cooccurrence_edges(pairs(spark, sf_dir), "user_id", "business_id", t)


@CORE.add("cooccur_edges", f"WITH {_edges_sql(SHARED)} SELECT src, dst FROM e")
def cooccur_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@CORE.add("graph_vertices", f"WITH {_edges_sql(SHARED)} SELECT DISTINCT src AS node FROM e")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(edges(spark, sf_dir))


def _lpa_sql() -> str:
    steps = [_edges_sql(SHARED), "l0 AS (SELECT DISTINCT src AS node, src AS label FROM e)"]
    for r in range(1, ROUNDS + 1):
        steps.append(f"v{r} AS (SELECT e.dst AS node, l.label, count(*) AS n FROM e JOIN l{r - 1} l ON e.src = l.node GROUP BY 1, 2)")
        steps.append(f"l{r} AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, label) AS k FROM v{r}) WHERE k = 1)")
    return "WITH " + ", ".join(steps)


@CORE.add("lpa_labels", f"{_lpa_sql()} SELECT node, label FROM l{ROUNDS}")
def lpa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(edges(spark, sf_dir), ROUNDS)


@CORE.add("lpa_communities", f"{_lpa_sql()} SELECT string_agg(node, ',' ORDER BY node) AS members, CAST(count(*) AS INTEGER) AS n FROM l{ROUNDS} GROUP BY label")
def lpa_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.communities(graph.label_propagation(edges(spark, sf_dir), ROUNDS))
    return found.select(F.array_join("members", ",").alias("members"), F.size("members").alias("n"))


_COMPONENTS = """
    WITH RECURSIVE {edges}, c AS (SELECT DISTINCT src AS root, src AS node FROM e UNION SELECT c.root, e.dst FROM c JOIN e ON c.node = e.src),
    k AS (SELECT node, min(root) AS component FROM c GROUP BY 1)
"""


@CORE.add("components", _COMPONENTS.format(edges=_edges_sql(SHARED_CUT)) + "SELECT node, component FROM k")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir, SHARED_CUT))


@CORE.add(
    "modularity_components",
    _COMPONENTS.format(edges=_edges_sql(SHARED_CUT))
    + """, t AS (SELECT a.component AS c, CAST(a.component = b.component AS INTEGER) AS i FROM e JOIN k a ON e.src = a.node JOIN k b ON e.dst = b.node),
    p AS (SELECT c, sum(i) AS inside, count(*) AS degree FROM t GROUP BY 1)
    SELECT round(coalesce(sum(inside / (SELECT sum(degree) FROM p) - pow(degree / (SELECT sum(degree) FROM p), 2)), 0), 4) AS modularity FROM p
    """,
)
def modularity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir, SHARED_CUT)
    return spark.createDataFrame([(graph.modularity(e, graph.components(e)),)], "modularity double")


@CORE.add(
    "modularity_lpa",
    _lpa_sql()
    + f""", t AS (SELECT a.label AS c, CAST(a.label = b.label AS INTEGER) AS i FROM e JOIN l{ROUNDS} a ON e.src = a.node JOIN l{ROUNDS} b ON e.dst = b.node),
    p AS (SELECT c, sum(i) AS inside, count(*) AS degree FROM t GROUP BY 1)
    SELECT round(coalesce(sum(inside / (SELECT sum(degree) FROM p) - pow(degree / (SELECT sum(degree) FROM p), 2)), 0), 4) AS modularity FROM p
    """,
)
def modularity_lpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    labels = graph.label_propagation(e, ROUNDS).withColumnRenamed("label", "component")
    return spark.createDataFrame([(graph.modularity(e, labels),)], "modularity double")


def _levels_sql() -> str:
    """Shortest paths over the edges ``e``, level by level."""
    steps = ["f0 AS (SELECT DISTINCT src AS root, src AS node, 0 AS dist, 1.0::DOUBLE AS sigma FROM e)", "s0 AS (SELECT * FROM f0)"]
    for d in range(1, DEPTH + 1):
        steps.append(f"f{d} AS (SELECT f.root, e.dst AS node, {d} AS dist, sum(f.sigma) AS sigma FROM f{d - 1} f JOIN e ON f.node = e.src WHERE NOT EXISTS (SELECT 1 FROM s{d - 1} s WHERE s.root = f.root AND s.node = e.dst) GROUP BY 1, 2)")
        steps.append(f"s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM f{d})")
    return ", ".join(steps)


def _paths_sql(t: int = SHARED) -> str:
    return f"{_edges_sql(t)}, {_levels_sql()}"


@CORE.add("shortest_paths", f"WITH {_paths_sql()} SELECT root, node, dist, sigma FROM s{DEPTH}")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(edges(spark, sf_dir))


@CORE.add(
    "edge_betweenness",
    f"""
    WITH {_paths_sql()}, w AS (SELECT * FROM s{DEPTH})
    SELECT h.u, h.v, round(sum(a.sigma * b.sigma / t.sigma), 6) AS betweenness
    FROM h JOIN w a ON a.node = h.u JOIN w b ON b.root = h.v JOIN w t ON t.root = a.root AND t.node = b.node AND t.dist = a.dist + 1 + b.dist GROUP BY 1, 2
    """,
)
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.edge_betweenness(edges(spark, sf_dir))
    return found.select("u", "v", F.round("betweenness", 6).alias("betweenness"))


_TOP = f"""
    WITH RECURSIVE {_paths_sql(SHARED_CUT)}, w AS (SELECT * FROM s{DEPTH}),
    top AS (SELECT h.u, h.v, round(sum(a.sigma * b.sigma / t.sigma), 6) AS betweenness
            FROM h JOIN w a ON a.node = h.u JOIN w b ON b.root = h.v JOIN w t ON t.root = a.root AND t.node = b.node AND t.dist = a.dist + 1 + b.dist
            GROUP BY 1, 2 ORDER BY betweenness DESC, u, v LIMIT 1)
"""


@CORE.add("top_edge", f"{_TOP} SELECT u, v, betweenness FROM top")
def top_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge of highest betweenness, which a cut removes."""
    return graph.top_edge(edges(spark, sf_dir, SHARED_CUT)).withColumn("betweenness", F.round("betweenness", 6))


@CORE.add(
    "components_after_cut",
    f"""{_TOP}, e2 AS (SELECT e.src, e.dst FROM e, top WHERE NOT (src = u AND dst = v) AND NOT (src = v AND dst = u)),
    c AS (SELECT DISTINCT src AS root, src AS node FROM e UNION SELECT c.root, e2.dst FROM c JOIN e2 ON c.node = e2.src)
    SELECT node, min(root) AS component FROM c GROUP BY 1
    """,
)
def components_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph without that edge."""
    e = cut_lineage(edges(spark, sf_dir, SHARED_CUT))
    top = graph.top_edge(e).first()
    return graph.components(graph.without_edge(e, top["u"], top["v"]) if top else e, graph.vertices(e))


#: The edges that are left after each cut, the components they leave, and the score of those on the graph as it was.
_CUTS = f"""
    WITH RECURSIVE {_edges_sql(SHARED_CUT)},
    cuts AS (
      SELECT 0 AS step, (SELECT list({{'u': u, 'v': v}}) FROM h) AS es
      UNION ALL
      (WITH cur AS MATERIALIZED (SELECT step, unnest(es) AS e FROM cuts), h AS MATERIALIZED (SELECT e.u AS u, e.v AS v FROM cur), e AS MATERIALIZED (SELECT u AS src, v AS dst FROM h UNION ALL SELECT v, u FROM h),
       {_levels_sql()}, w AS MATERIALIZED (SELECT * FROM s{DEPTH}),
       top AS (SELECT h.u, h.v, round(sum(a.sigma * b.sigma / t.sigma), 9) AS betweenness
               FROM h JOIN w a ON a.node = h.u JOIN w b ON b.root = h.v JOIN w t ON t.root = a.root AND t.node = b.node AND t.dist = a.dist + 1 + b.dist
               GROUP BY 1, 2 ORDER BY betweenness DESC, u, v LIMIT 1)
       SELECT any_value(step) + 1, list(cur.e) FILTER (WHERE NOT (cur.e.u = top.u AND cur.e.v = top.v)) FROM cur, top HAVING count(*) > 0)),
    nodes AS (SELECT DISTINCT src AS node FROM e),
    arcs AS (SELECT step, x.u AS src, x.v AS dst FROM (SELECT step, unnest(es) AS x FROM cuts) UNION ALL SELECT step, x.v, x.u FROM (SELECT step, unnest(es) AS x FROM cuts)),
    reach AS (SELECT step, node AS root, node FROM (SELECT step FROM cuts) c, nodes UNION SELECT r.step, r.root, a.dst FROM reach r JOIN arcs a ON a.step = r.step AND a.src = r.node),
    parts AS (SELECT step, node, min(root) AS component FROM reach WHERE step > 0 GROUP BY 1, 2),
    tagged AS (SELECT a.step, a.component AS c, CAST(a.component = b.component AS INTEGER) AS i FROM e JOIN parts a ON e.src = a.node JOIN parts b ON e.dst = b.node AND a.step = b.step),
    per AS (SELECT step, c, sum(i) AS inside, count(*) AS degree FROM tagged GROUP BY 1, 2),
    scores AS (SELECT step, round(sum(inside / (SELECT count(*) FROM e) - pow(degree / (SELECT count(*) FROM e), 2)), 4) AS score, count(*) AS n FROM per GROUP BY 1),
    marked AS (SELECT *, score < max(score) OVER (ORDER BY step) - 0.1 OR n = (SELECT count(*) FROM nodes) AS stops FROM scores),
    best AS (SELECT step, score FROM marked WHERE step <= coalesce((SELECT min(step) FROM marked WHERE stops), (SELECT max(step) FROM marked)) ORDER BY score DESC, step DESC LIMIT 1)
"""


@CORE.add("girvan_newman", f"{_CUTS} SELECT node, component, score AS modularity FROM parts JOIN best USING (step)")
def girvan_newman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of greatest modularity."""
    best, score = graph.girvan_newman(edges(spark, sf_dir, SHARED_CUT))
    return best.withColumn("modularity", F.lit(score))
