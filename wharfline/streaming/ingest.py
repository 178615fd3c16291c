"""New normalised invoices as a stream: each micro-batch is priced against the contract and appended, and late copies are dropped.

The stateless part of an audit (pricing against the effective card and the fuel index) runs on arrival; supersession and
duplicates need the whole history and stay in the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.books import Books
from ..operators.rerate import rerate_invoices


def invoice_stream(spark: SparkSession, folder: str, schema, watermark: str = "30 days") -> DataFrame:
    """Invoices from Parquet files as they arrive, each id once within the watermark of its receipt."""
    d = spark.readStream.schema(schema).parquet(folder)
    return d.withColumn("event_time", F.col("received_date").cast("timestamp")).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["invoice_id"]).drop("event_time")


def price_batch(batch: DataFrame, books: Books, config: Config) -> DataFrame:
    """The re-rated rows of one micro-batch."""
    return rerate_invoices(books.with_(invoices=batch), config)


def start(stream: DataFrame, books: Books, config: Config, out: str, checkpoint: str):
    """Re-rate every micro-batch into ``out/batch=N`` (rewritten when a batch is retried, so each row lands once); runs on what is available and stops."""

    def write(batch: DataFrame, epoch: int) -> None:
        price_batch(batch, books, config).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def receipts_per_week(stream: DataFrame) -> DataFrame:
    """Invoices and dollars by carrier and week of receipt, emitted once the watermark has passed."""
    t = stream.withColumn("t", F.col("received_date").cast("timestamp")).withWatermark("t", "14 days")
    return t.groupBy(F.window("t", "7 days", startTime="4 days"), "carrier_id").agg(F.count(F.lit(1)).alias("invoices"), F.sum("total").alias("dollars")).select(F.col("window.start").cast("date").alias("week_start"), "carrier_id", "invoices", "dollars")
