"""Readers with declared schemas; nothing is inferred.

Malformed JSON lines become null rows (``PERMISSIVE``), or stop the query with ``mode="FAILFAST"``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REVIEW = "review_id STRING, user_id STRING, business_id STRING, stars DOUBLE, date STRING, text STRING"
BUSINESS = "business_id STRING, city STRING, categories STRING"
PAIRS = "user_id STRING, business_id STRING"
CITY = "city STRING"
TWEET = "entities STRUCT<hashtags: ARRAY<STRUCT<text: STRING>>>, coordinates STRUCT<lon: DOUBLE, lat: DOUBLE>"


def read_json_lines(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One JSON object per line; fields that are absent are null."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_pairs_csv(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    """Unquoted CSV whose header line may be repeated: every row that equals the header is dropped."""
    raw = spark.read.schema(schema).option("header", False).option("quote", "").csv(path)
    return drop_header_rows(raw)


def drop_header_rows(df: DataFrame) -> DataFrame:
    """Without the rows whose values are the column names."""
    is_header = F.lit(True)
    for name in df.columns:
        is_header = is_header & F.coalesce(F.col(name) == name, F.lit(False))
    return df.where(~is_header)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Headerless numeric CSV files of any dimension: (point_id, features, round), round = place of the file by name, from 1."""
    parts = F.split(F.col("value"), ",")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), parts.alias("parts")).where(F.trim(F.col("parts")[0]) != "")
    points = lines.select("file", F.col("parts")[0].cast("long").alias("point_id"), F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), lambda x: x.cast("double")).alias("features"))
    files = points.select("file").distinct().withColumn("round", F.dense_rank().over(Window.orderBy("file")))  # one row per file
    return points.join(F.broadcast(files), "file").drop("file")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word per line."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def rows_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """An in-memory collection as a table."""
    return spark.createDataFrame(rows, schema)


def in_box(lon: str, lat: str, west: float = -180.0, south: float = -90.0, east: float = 180.0, north: float = 90.0):
    """The bounding-box filter of a push source, as a predicate."""
    return F.col(lon).between(west, east) & F.col(lat).between(south, north)


def boxed_stream(spark: SparkSession, folder: str, schema: str = TWEET, **box: float) -> DataFrame:
    """Events pushed with coordinates, landed as JSON lines and read as a replayable stream: those inside the box, in order of arrival."""
    return json_file_stream(spark, folder, schema).where(in_box("coordinates.lon", "coordinates.lat", **box))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a TCP socket; for development only, since a socket cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def json_file_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A replayable stream of JSON-lines files in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
