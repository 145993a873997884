"""Resumable appends: what is done is skipped, a success wins over an error, and counts are topped up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(prompts: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts without an output that has a text and no error."""
    done = outputs.where(F.coalesce(F.col("error"), F.lit("")) == "").where("text <> ''").select(*keys).distinct()
    return prompts.join(done, keys, "left_anti")


def settled(outputs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row for each key: its first success, else its last error."""
    ok = (F.coalesce(F.col("error"), F.lit("")) == "") & (F.coalesce(F.col("text"), F.lit("")) != "")
    rank = F.struct(ok.cast("int"), F.when(ok, -F.col(order)).otherwise(F.col(order)))
    return outputs.groupBy(*keys).agg(F.max_by(F.struct("text", "error"), rank).alias("r")).select(*keys, "r.*")


def short_of(candidates: DataFrame, wanted: DataFrame, key: str, k: int, most: int) -> DataFrame:
    """key + (have, state): 'more' below k, 'given_up' below k at the cap, else 'full'."""
    have = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("have"), F.count_if("good").alias("good"))
    x = wanted.select(key).distinct().join(have, key, "left").na.fill(0, ["have", "good"])
    return x.withColumn("state", F.when(F.col("good") >= k, "full").when(F.col("have") >= most, "given_up").otherwise("more"))


def stream_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: list[str], step: Callable[[DataFrame], DataFrame] | None = None, time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """JSON lines that arrive in a folder, each key once, through `step`, appended to another folder. A restart
    with the same checkpoint goes on where the last run ended. With a time column, a key is remembered until the
    watermark has passed it by `late`, which bounds the state; without one, all keys are."""
    rows = spark.readStream.schema(schema).json(source)
    rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else rows.dropDuplicates(keys)
    out = step(rows) if step else rows
    return out.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window; works on a table and, with its watermark, on a stream."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")
