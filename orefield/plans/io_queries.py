"""Queries that write with a sink and read the files back: sources and sinks by round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import graph, itemsets
from orefield.plans import graph_queries as gq
from orefield.plans import mining_queries as mq
from orefield.plans.cluster_queries import _POINTS, in_rounds
from orefield.plans.registry import CORE
from orefield.session import ensure_checkpoint_dir
from orefield.sources import readers, writers
from orefield.sources.tables import table
from orefield.streaming import pipelines


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the only text file of a finished report."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return whole.where("value <> ''")


@CORE.add("json_lines_roundtrip", "SELECT review_id, user_id, business_id, stars, date, text FROM review")
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as JSON lines, read with the declared schema."""
    path = _folder(spark)
    writers.json_lines(table(spark, sf_dir, "review").select("review_id", "user_id", "business_id", "stars", "date", "text"), path)
    return readers.read_json_lines(spark, path, readers.REVIEW)


@CORE.add("csv_pairs_roundtrip", "SELECT user_id, business_id FROM user_business WHERE NOT coalesce(user_id = 'user_id' AND business_id = 'business_id', false)")
def csv_pairs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as CSV with the header line repeated in every file and inside them."""
    path = _folder(spark)
    table(spark, sf_dir, "user_business").write.option("header", True).option("quote", "").csv(path)
    return readers.read_pairs_csv(spark, path)


@CORE.add("points_roundtrip", f"WITH {_POINTS} SELECT id AS point_id, CAST(id % 4 + 1 AS INTEGER) AS round, CAST(len(f) AS INTEGER) AS dims, round(list_sum(f), 6) AS total FROM p")
def points_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as headerless CSV files, one for each round, numbered by the names of the files."""
    path = _folder(spark)
    lined = in_rounds(spark, sf_dir).select("round", F.concat_ws(",", F.col("point_id").cast("string"), F.array_join(F.col("features").cast("array<string>"), ",")).alias("value"))
    lined.repartitionById(4, F.col("round") - 1).select("value").write.text(path)
    found = readers.read_points(spark, path)
    return found.select("point_id", "round", F.size("features").alias("dims"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@CORE.add("word_list_roundtrip", "SELECT word FROM stopwords")
def word_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "stopwords").select("word").write.text(path)
    return readers.read_word_list(spark, path)


@CORE.add("rows_in_memory", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(n, word)")
def rows_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.rows_of(spark, [(1, "a"), (2, None)], "n int, word string")


@CORE.add("json_document", "SELECT region, nations FROM (SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished report as one JSON document."""
    path = _folder(spark)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.json_report(nations.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations")), path)
    return spark.read.schema("region string, nations long").json(path, multiLine=True)


@CORE.add("community_file", f"{gq._lpa_sql()} SELECT CAST(row_number() OVER (ORDER BY n, first) - 1 AS INTEGER) AS line_no, value FROM (SELECT count(*) AS n, min(node) AS first, '''' || string_agg(node, ''', ''' ORDER BY node) || '''' AS value FROM l{gq.ROUNDS} GROUP BY label)")
def community_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities as lines, smaller ones first."""
    path = _folder(spark)
    writers.text_file(writers.community_lines(graph.communities(graph.label_propagation(gq.edges(spark, sf_dir), gq.ROUNDS))), path)
    return _lines(spark, path)


@CORE.add(
    "edge_file",
    f"""WITH {gq._paths_sql()}, w AS (SELECT * FROM s{gq.DEPTH}),
    x AS (SELECT h.u, h.v, round(sum(a.sigma * b.sigma / t.sigma), 6) AS betweenness
          FROM h JOIN w a ON a.node = h.u JOIN w b ON b.root = h.v JOIN w t ON t.root = a.root AND t.node = b.node AND t.dist = a.dist + 1 + b.dist GROUP BY 1, 2)
    SELECT CAST(row_number() OVER (ORDER BY betweenness DESC, u, v) - 1 AS INTEGER) AS line_no, '(''' || u || ''', ''' || v || '''), ' || betweenness AS value FROM x""",
)
def edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their betweenness as lines, the highest first."""
    path = _folder(spark)
    found = graph.edge_betweenness(gq.edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 6))
    writers.edge_file(found, path)
    return _lines(spark, path)


@CORE.add(
    "itemset_file",
    f"""WITH sets AS MATERIALIZED ({mq._ITEMSETS}), l AS (SELECT size AS k, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY items) AS value FROM sets GROUP BY 1),
    parts AS (SELECT 0 AS part, 0 AS k, 'Candidates:' AS value UNION ALL SELECT 0, k, value FROM l UNION ALL SELECT 1, 0, 'Frequent Itemsets:' UNION ALL SELECT 1, k, value FROM l)
    SELECT CAST(row_number() OVER (ORDER BY part, k) - 1 AS INTEGER) AS line_no, value FROM parts""",
)
def itemset_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of itemsets, with the frequent ones as their own candidates."""
    path = _folder(spark)
    found = itemsets.levelwise(*mq._rows_and_support(spark, sf_dir))
    writers.itemset_report(found, found, path)
    return _lines(spark, path)


@CORE.add("flags_file", "SELECT CAST(row_number() OVER (ORDER BY record_id) - 1 AS INTEGER) AS place, CASE WHEN city IS NULL THEN '0' ELSE '1' END AS flag FROM business")
def flags_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flag per business in one line, each followed by a blank."""
    path = _folder(spark)
    flags = table(spark, sf_dir, "business").select("record_id", F.col("city").isNotNull().cast("int").alias("flag"))
    writers.flags_file(flags, "record_id", "flag", path)
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), " ")).alias("place", "flag"))


@CORE.add("csv_report_roundtrip", "SELECT n_name, n_regionkey FROM nation")
def csv_report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished table as CSV with a header."""
    path = _folder(spark)
    writers.csv_report(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), path)
    return spark.read.schema("n_name string, n_regionkey int").option("header", True).csv(path)


@CORE.add("stream_csv", "SELECT event_id, user_id, event_type FROM events")
def stream_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream written batch by batch as CSV."""
    path = _folder(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "user_id", "event_type")
    query = stream.writeStream.foreachBatch(writers.batch_csv_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").option("header", True).csv(f"{path}/out/*")


@CORE.add("boxed_stream", "SELECT count(*) AS n FROM events WHERE event_id % 360 - 180 BETWEEN -100 AND 50 AND event_id % 180 - 90 BETWEEN -30 AND 60")
def boxed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with made coordinates, landed as JSON lines and streamed through the bounding box."""
    path = _folder(spark)
    place = F.struct((F.col("event_id") % 360 - 180).cast("double").alias("lon"), (F.col("event_id") % 180 - 90).cast("double").alias("lat"))
    writers.json_lines(table(spark, sf_dir, "events").select("event_id", place.alias("coordinates")), path)
    stream = readers.boxed_stream(spark, path, "event_id LONG, coordinates STRUCT<lon: DOUBLE, lat: DOUBLE>", west=-100.0, south=-30.0, east=50.0, north=60.0)
    return pipelines.run_to_end(stream, f"box_{uuid.uuid4().hex}", "append").agg(F.count(F.lit(1)).alias("n"))


@CORE.add(
    "stream_reports",
    f"""WITH e AS (SELECT event_id + 1 AS n, event_type FROM events),
    q AS (SELECT *, {mq._HEX.format(parts=f"'{mq.SEED}-a-', n")} % n + 1 AS r1, {mq._HEX.format(parts=f"'{mq.SEED}-b-', n")} % {mq.RESERVOIR} + 1 AS r2 FROM e),
    v AS (SELECT *, CASE WHEN n <= {mq.RESERVOIR} THEN n WHEN r1 <= {mq.RESERVOIR} THEN r2 END AS slot FROM q),
    k AS (SELECT tag, count(*) AS n FROM (SELECT slot, arg_max(event_type, n) AS tag FROM v WHERE slot IS NOT NULL GROUP BY 1) GROUP BY 1)
    SELECT tag, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS rank FROM k) WHERE rank <= 3""",
)
def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report a stream writes after its last micro-batch: the most frequent types in the reservoir."""
    path = _folder(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select((F.col("event_id") + 1).alias("n"), F.array("event_type").alias("tags"))
    sample = pipelines.stream_reservoir(events, "n", "tags", mq.RESERVOIR, mq.SEED)
    query = sample.writeStream.foreachBatch(pipelines.top_tags_sink(f"{path}/out", "item")).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("tag string, n long, rank int, batch int").json(f"{path}/out")
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select("tag", "n", "rank")
