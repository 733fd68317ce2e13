"""Streams of ticks: minute bars with late data, deliveries seen before, sessions, and results kept up to date in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Ticks as a stream of files, with the schema of those there now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream watches folders: the folder of the file, and only files of its name
        stream = reader.option("pathGlobFilter", at.getName()).parquet(path.rsplit("/", 1)[0])
    return stream.withColumn("time", F.col("time").cast("timestamp"))  # a watermark needs a time with a zone


def without_redelivered(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """Ticks whose source, kind, time, value and size came before are dropped, as far back as the watermark reaches."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["stock_code", "event_type", "time", "value", "size"])


def minute_bars(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """Minute bars of trades; a bar is final, and comes out once, when the watermark has passed it. Later ticks are dropped.

    The state is one row per source and open minute, combined on the map side.
    """
    t = stream.where("event_type = 'TRADE' and value > 0 and not isnan(value)").withWatermark("time", delay)
    at = F.struct("time", "tick_id")
    bars = t.groupBy("stock_code", F.window("time", "1 minute").alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    return bars.select("stock_code", F.col("w.start").alias("minute"), "open", "high", "low", "close", "volume", "trades")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "3 days") -> DataFrame:
    """Runs of ticks of a source without a longer gap: first and last time, and how many."""
    s = stream.withWatermark("time", delay).groupBy("stock_code", F.session_window("time", gap).alias("s")).agg(F.count(F.lit(1)).alias("ticks"), F.min("time").alias("first"), F.max("time").alias("last"))
    return s.select("stock_code", "first", "last", "ticks")


def run_to_end(result: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; a repeated run goes on after the last finished batch, so each row is written once."""
    query = result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_daily_counts(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Counts per source and day kept in a table of versions: each batch writes its own counts under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("stock_code", "trading_date").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("stock_code", "trading_date").agg(F.sum("n").alias("n"))


def carried_quotes(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Quotes carried forward over a finished day, from the day's rows and the last quotes of the day before.

    For days closed by the watermark; `before` has stock_code, bid and ask.
    """
    w = Window.partitionBy("stock_code").orderBy("time", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(F.col("event_type") == k, F.col("value")), True).over(w)
    out = batch.withColumns({"bid": last("BID"), "ask": last("ASK")})
    if before is None:
        return out
    old = before.select("stock_code", F.col("bid").alias("b_"), F.col("ask").alias("a_"))
    return out.join(old, "stock_code", "left").withColumns({"bid": F.coalesce("bid", "b_"), "ask": F.coalesce("ask", "a_")}).drop("b_", "a_")
