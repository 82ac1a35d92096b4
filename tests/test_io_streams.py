import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from orefield.functions.hashing import coefficients
from orefield.functions.text import now_text
from orefield.operators.reservoir import reservoir
from orefield.operators.sketches import fm_windows
from orefield.session import ensure_checkpoint_dir, reused
from orefield.sources import readers, writers
from orefield.sources.tables import latest_by
from orefield.streaming.pipelines import run_to_end, stream_fm, stream_reservoir, top_tags_sink


def lines(path):
    return [line for p in sorted(path.glob("part-*")) for line in p.read_text().splitlines()]


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"review_id": "1", "text": "a"}\nnot json\n')
    assert sorted(str(r.review_id) for r in readers.read_json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).collect()) == ["1", "None"]
    (tmp_path / "p.csv").write_text('user_id,business_id\nu1,b1\nuser_id,business_id\nu2,"b2\n')
    assert sorted(map(tuple, readers.read_pairs_csv(spark, str(tmp_path / "p.csv")).collect())) == [("u1", "b1"), ("u2", '"b2')]
    (tmp_path / "points").mkdir()
    (tmp_path / "points/b.txt").write_text("2,3.5,1\n")
    (tmp_path / "points/a.txt").write_text("0,1,2\n1,0.5,0\n")
    got = sorted((r.round, r.point_id, r.features) for r in readers.read_points(spark, str(tmp_path / "points")).collect())
    assert got == [(1, 0, [1.0, 2.0]), (1, 1, [0.5, 0.0]), (2, 2, [3.5, 1.0])]
    (tmp_path / "w").write_text("the\na\n")
    assert {r.word for r in readers.read_word_list(spark, str(tmp_path / "w")).collect()} == {"the", "a"}
    box = readers.rows_of(spark, [(1.0, 2.0), (200.0, 0.0)], "lon double, lat double").where(readers.in_box("lon", "lat"))
    assert box.count() == 1


def test_writers(spark, tmp_path):
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],)], "items array<string>")
    for _ in range(2):  # overwriting, not appending
        writers.itemset_report(sets, sets.limit(1), str(tmp_path / "sets"))
    assert lines(tmp_path / "sets") == ["Candidates:", "('a'),('b')", "('a', 'b')", "Frequent Itemsets:", "('a')"]
    groups = spark.createDataFrame([(["b", "c"],), (["a"],)], "members array<string>")
    writers.text_file(writers.community_lines(groups), str(tmp_path / "groups"))
    assert lines(tmp_path / "groups") == ["'a'", "'b', 'c'"]
    edges = spark.createDataFrame([("a", "b", 1.5), ("a", "c", 3.0)], "u string, v string, betweenness double")
    writers.text_file(writers.edge_lines(edges), str(tmp_path / "edges"))
    assert lines(tmp_path / "edges") == ["('a', 'c'), 3.0", "('a', 'b'), 1.5"]
    flags = spark.createDataFrame([(2, 0), (1, 1), (3, 1)], "i int, f int")
    assert writers.flags_line(flags, "i", "f").first().value == "1 0 1 "
    writers.json_report(flags, str(tmp_path / "report"))
    assert json.loads(lines(tmp_path / "report")[0])[0] == {"i": 1, "f": 1}
    writers.json_lines(flags, str(tmp_path / "jl"))
    assert sorted(json.loads(x)["i"] for x in lines(tmp_path / "jl")) == [1, 2, 3]
    writers.csv_report(flags.orderBy("i"), str(tmp_path / "csv"))
    assert lines(tmp_path / "csv")[0] == "i,f"


def test_edge_lines_are_made_after_the_exchange(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([("b", "c", 1.5), ("a", "c", 3.0), ("a", "b", 1.5)], "u string, v string, betweenness double")
    made, edge_lines = [], writers.edge_lines
    monkeypatch.setattr(writers, "edge_lines", lambda df: made.append(df) or edge_lines(df))
    for _ in range(2):
        writers.edge_file(edges.repartition(3), str(tmp_path / "edges"))
    assert lines(tmp_path / "edges") == ["('a', 'c'), 3.0", "('a', 'b'), 1.5", "('b', 'c'), 1.5"]
    assert [df.rdd.getNumPartitions() for df in made] == [1, 1]


def test_kept_tables_are_given_back(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    with reused(df) as kept:
        assert kept.count() == kept.where("x >= 0").count() == 100
        assert kept.storageLevel.useMemory and kept.storageLevel.useDisk
    assert not df.storageLevel.useMemory


def test_order_of_text_files(spark, tmp_path):
    df = spark.createDataFrame([(k * 37 % 101, f"line {k * 37 % 101:03d}") for k in range(101)], "place int, value string").repartition(7)
    writers.text_file(df, str(tmp_path / "t"))
    assert lines(tmp_path / "t") == [f"line {k:03d}" for k in range(101)]
    writers.flags_file(df.select("place", (F.col("place") % 2).alias("flag")), "place", "flag", str(tmp_path / "f"))
    assert next((tmp_path / "f").glob("part-*")).read_text() == "".join(f"{k % 2} " for k in range(101))
    assert writers.console(df.limit(1)) > 0
    assert len(df.limit(1).select(now_text().alias("t")).first().t) == 19


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(dict)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        ensure_checkpoint_dir(Session)


def test_latest(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("a", 1, t, "x"), ("a", 2, t + dt.timedelta(1), None), ("a", 3, None, "y"), (None, 9, t, "z"), ("b", 5, None, "w")]
    df = spark.createDataFrame(rows, "k string, v int, at timestamp_ntz, extra string")
    assert {(r.k, r.v) for r in latest_by(df, "k", "at", ["k", "v"]).collect()} == {("a", 2), ("b", 5)}


def test_streams_match_batch(spark, tmp_path):
    a, b = coefficients(8, 500, 3)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for f in range(3):
        rows = [{"ts": (start + dt.timedelta(seconds=100 * f + 2 * i)).isoformat(), "k": f"c{(i * 7 + f) % 23}", "n": 50 * f + i + 1} for i in range(50)]
        (tmp_path / f"{f}.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "ts timestamp, k string, n long"
    stream = readers.json_file_stream(spark, str(tmp_path), schema)
    found = {tuple(r) for r in run_to_end(stream_fm(stream, "ts", "k", "30 seconds", "10 seconds", "10 seconds", a, b, 500, 2), "fm_test", "append").collect()}
    batch_rows = spark.read.schema(schema).json(str(tmp_path))
    batch = {tuple(r) for r in fm_windows(batch_rows, "ts", "k", "30 seconds", "10 seconds", a, b, 500, 2).collect()}
    assert found and found <= batch and len(batch) - len(found) <= 5
    sample = {tuple(r) for r in run_to_end(stream_reservoir(readers.json_file_stream(spark, str(tmp_path), schema), "n", "k", 20, 5), "res_test", "complete").collect()}
    assert sample == {tuple(r) for r in reservoir(batch_rows, "n", "k", 20, 5).collect()}
    sink = writers.batch_csv_sink(str(tmp_path / "out"))
    for _ in range(2):
        sink(batch_rows.select("n").limit(5), 0)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5
    tags = batch_rows.select("n", F.array("k").alias("tags"))
    top_tags_sink(str(tmp_path / "tags"), "item")(reservoir(tags, "n", "tags", 20, 5), 3)
    assert spark.read.json(str(tmp_path / "tags")).where("rank = 1").count() >= 1
