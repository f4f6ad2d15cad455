"""Documents that arrive as files, page by page: Structured Streaming over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import pages as P
from folioscope.sources import typeset as S


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, source string", files: int = 1) -> DataFrame:
    """A stream of documents from Parquet files as they come, ``files`` of them at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def line_counts(docs: DataFrame) -> DataFrame:
    """(source, n_lines, n_chrome), kept up to date: state holds one row a source."""
    lines = S.lines(docs)
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(T.is_chrome_pattern(F.col("line")).cast("long")).alias("n_chrome"))


def event_windows(events: DataFrame, minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of windows of (ts, event_type, value); rows later than
    ``late`` are left out and their windows' state is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_batches(docs: DataFrame, folder: str, checkpoint: str, size: int = 25, most: int = 1000):
    """Starts a query that writes each batch's documents as runs of pages, a folder a batch, so
    that a batch that is run again replaces what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        items = S.items(batch)
        runs = P.page_batches(items.select("doc_id", "page_number").distinct(), size, most)
        runs.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
