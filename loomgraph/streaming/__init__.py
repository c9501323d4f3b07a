"""Graphs that grow while dialogues arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DIALOGUE = "chat_id string, ts timestamp, turn int, cause string, effect string, question string"


def relations(rows: DataFrame) -> DataFrame:
    """Relations of dialogue rows, by normal labels, without loops."""
    from ..functions.text import normal_label

    named = rows.select("chat_id", "ts", normal_label(F.col("cause")).alias("src"), normal_label(F.col("effect")).alias("dst"))
    return named.where("src <> dst AND src <> '' AND dst <> ''")


def ingest(stream: DataFrame, path: str, checkpoint: str, trigger_now: bool = True) -> StreamingQuery:
    """Adds each micro-batch's relations, counted by graph and edge, to the table below path.

    A batch has a folder of its own, which a repeated batch overwrites, so edges count once; sums over batches commute, so their
    order does not matter.
    """

    def merge(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy("chat_id", "src", "dst").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = relations(stream).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_now else writer).start()


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(chat_id, src, dst, n, first_ts) of all batches so far."""
    held = spark.read.parquet(path)
    return held.groupBy("chat_id", "src", "dst").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"))


def windowed(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums of value by tumbling windows and key; rows later than ``late`` are left out. An addition to the batch operators."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key that end after ``gap`` without rows."""
    w = stream.withWatermark(time, gap).groupBy(F.session_window(time, gap).alias("w"), key)
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")
