"""Streaming forms of the distinct-count estimate and of the reservoir."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions.hashing import bytes_mod
from orefield.operators.reservoir import reservoir_tags, slot_of, top_frequencies
from orefield.operators.sketches import fm_estimate, fm_maxima
from orefield.session import ensure_checkpoint_dir


def stream_fm(events: DataFrame, ts: str, key: str, window: str, slide: str, lateness: str, a: list[int], b: list[int], m: int, groups: int) -> DataFrame:
    """Per closed sliding event-time window: (window_end, estimate, truth).

    State: one row per (window, key), spread by both and dropped when the window closes, and one small row of maxima per window.
    Windows close ``lateness`` behind the latest event; later rows are dropped. Emits in append mode.
    """
    keyed = events.where(F.col(key).isNotNull()).select(F.col(ts).cast("timestamp").alias("__ts"), F.col(key).alias("__key"), bytes_mod(F.col(key), m).alias("__x"))
    once = keyed.withWatermark("__ts", lateness).select(F.window("__ts", window, slide).alias("__w"), "__key", "__x").dropDuplicates(["__w", "__key"])
    per = once.groupBy("__w").agg(*fm_maxima(F.col("__x"), a, b, m), F.count(F.lit(1)).alias("truth"))
    return per.select(F.col("__w.end").alias("window_end"), fm_estimate(len(a), groups).alias("estimate"), "truth")


def stream_reservoir(events: DataFrame, n: str, item: str, size: int, seed: int) -> DataFrame:
    """The reservoir of a stream of numbered events as a running aggregate: (slot, n, item); at most ``size`` rows of state."""
    placed = events.select(F.col(n).cast("long").alias("n"), F.col(item).alias("item")).withColumn("slot", slot_of(F.col("n"), size, seed)).where("slot IS NOT NULL")
    return placed.groupBy("slot").agg(F.max("n").alias("n"), F.max_by("item", "n").alias("item"))


def top_tags_sink(path: str, item: str, ranks: int = 3):
    """A ``foreachBatch`` function for ``stream_reservoir`` in complete mode: after each micro-batch, the tags of highest frequency.

    Each batch has its own folder, so replaying it after a failure overwrites the same report.
    """

    def report(sample: DataFrame, batch_id: int) -> None:
        top_frequencies(reservoir_tags(sample, item), "tag", ranks).orderBy("rank", "tag").write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return report


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over everything that is available and return its result as a table.

    Each micro-batch is written to its own folder in the shared checkpoint folder, overwriting what a failed attempt left; the result is
    their union in append mode, and the last one in complete mode. Nothing but the numbers of the batches is kept on the driver.
    """
    base = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    done: set[int] = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        done.add(batch_id)

    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = sorted(done)[-1:] if mode == "complete" else sorted(done)
    spark = stream.sparkSession
    parts = [spark.read.schema(stream.schema).parquet(f"{base}/out/batch={i}") for i in wanted]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], stream.schema)
