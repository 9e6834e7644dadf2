"""Request rates of users as a stream of windows."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.activity import USER_PER_MINUTE
from sieveline.sources.sinks import claim, stream_name

DELAY = "10 minutes"


def timed(events: DataFrame) -> DataFrame:
    """Event time as a time-zone aware timestamp, which watermarks require."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, width: str = "1 minute", slide: str = None, delay: str = DELAY) -> DataFrame:
    """Requests per user and window.  The counts are reduced before the shuffle, so one very
    active user costs one row per window and task."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (timed(events).withWatermark("ts", delay).groupBy(window, "user_id")
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.unix_seconds("window.start").alias("window_start"), "user_id", "requests"))


def over_limit(windows: DataFrame, limit: int = USER_PER_MINUTE) -> DataFrame:
    return windows.filter(F.col("requests") > limit)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a table; runs over what is there and stops."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def counts_to_table(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every count whenever it changes, so windows still open are there too.  A batch of a
    stream has a folder of its own (``sinks.claim``) and replaces only itself when repeated."""
    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = claim(spark, f"{path}/_claims", f"{stream_name(spark, checkpoint)}/{batch_id}")
        batch.write.mode("overwrite").parquet(f"{path}/batch={run}")

    return (windows.writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last count of every user and window."""
    return spark.read.parquet(path).groupBy("window_start", "user_id").agg(F.max_by("requests", "batch").alias("requests"))
