"""Report writers. Formatting is done in the plan; only the finished lines of a report are written."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, overwriting."""
    df.write.mode("overwrite").json(path)


def json_report(df: DataFrame, path: str) -> None:
    """A single JSON document with the rows of a small, finished report."""
    row = F.struct(*[F.col(c) for c in df.columns])
    df.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def quoted_tuple(items: Column) -> Column:
    """``('a', 'b')`` for an array of strings; ``('a')`` for one."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """One line per itemset size: the sorted tuples, separated by commas. Column ``items`` holds sorted arrays."""
    lined = itemsets.select(F.size("items").alias("k"), "items").groupBy("k").agg(F.sort_array(F.collect_list("items")).alias("sets"))
    return lined.select("k", F.array_join(F.transform("sets", lambda s: quoted_tuple(s)), ",").alias("value"))


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """Candidates and frequent itemsets in one text, overwriting."""
    parts = []
    for place, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        spark = sets.sparkSession
        parts.append(spark.createDataFrame([(place, 0, title)], "part int, k int, value string"))
        parts.append(itemset_lines(sets).select(F.lit(place).alias("part"), "k", "value"))
    text = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    text_file(text, path)


def community_lines(communities: DataFrame) -> DataFrame:
    """One line per community: quoted members, sorted; smaller communities first. Column ``members`` holds sorted arrays.

    Comes with the columns to order by, as ``text_file`` wants them.
    """
    return communities.select(F.size("members").alias("n"), F.col("members")[0].alias("first"), F.concat(F.lit("'"), F.array_join("members", "', '"), F.lit("'")).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """``('u', 'v'), value`` per edge, by falling value; with the columns to order by."""
    return edges.select((-F.col("betweenness")).alias("falling"), "u", "v", F.format_string("('%s', '%s'), %s", "u", "v", F.col("betweenness").cast("string")).alias("value"))


def edge_file(edges: DataFrame, path: str) -> None:
    """``edge_lines`` as one file, overwriting: lines are made after the exchange, which takes the edges only."""
    ordered = edges.select("u", "v", "betweenness").repartition(1).sortWithinPartitions(F.desc("betweenness"), "u", "v")
    edge_lines(ordered).select("value").write.mode("overwrite").text(path)


def flags_line(flags: DataFrame, ordinal: str, flag: str) -> DataFrame:
    """All flags in input order, each followed by a blank, in one line."""
    ordered = F.sort_array(F.collect_list(F.struct(ordinal, flag)))
    return flags.agg(F.concat(F.array_join(F.transform(ordered, lambda s: s[flag].cast("string")), " "), F.lit(" ")).alias("value"))


def flags_file(flags: DataFrame, ordinal: str, flag: str, path: str) -> None:
    """``flags_line`` as a file: sorted by ``ordinal`` and streamed through one task, never held as a whole."""
    ordered = flags.repartition(1).sortWithinPartitions(ordinal)
    ordered.select(F.col(flag).cast("string").alias("value")).write.mode("overwrite").option("lineSep", " ").text(path)


def text_file(lines: DataFrame, path: str) -> None:
    """The ``value`` column as text in one file, overwriting, ordered by the other columns from left to right."""
    order = [c for c in lines.columns if c != "value"]
    one = lines.repartition(1)
    (one.sortWithinPartitions(*order) if order else one).select("value").write.mode("overwrite").text(path)


def csv_report(df: DataFrame, path: str) -> None:
    """CSV with a header in one file, for finished reports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def batch_csv_sink(path: str):
    """A ``foreachBatch`` function that writes each micro-batch to its own folder; replaying a batch overwrites just that one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch_id}")

    return write


def console(df: DataFrame, rows: int = 20) -> float:
    """Print the first rows of a report and the seconds it took; returns them."""
    began = time.perf_counter()
    df.show(rows, truncate=False)
    took = time.perf_counter() - began
    print(f"Duration: {took:.3f} s")
    return took
