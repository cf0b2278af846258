"""Record feeds as streams: first-wins duplicate suppression within a watermark and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch


def files(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    """New parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_deliveries(stream: DataFrame, ids: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each id once within the watermark; rows later than that are dropped by the stream, not by us."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n_events) of tumbling windows."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), by, "n_events")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, its state and result in the shared folder, and gives the result."""
    scratch = Scratch(stream.sparkSession, "stream")
    out = f"{scratch.base}/result"
    # complete results replace each other, appended ones add up
    write = lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(out)
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def counted_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events table, read as a stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = files(spark, f"{path}*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(windowed_counts(events, "ts", "event_type"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
