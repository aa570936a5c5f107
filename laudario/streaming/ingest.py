"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laudario.functions import text as T


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a stream of its files; the schema is read from the table, never inferred by the stream."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def normalized_lines(lines: DataFrame) -> DataFrame:
    """Stateless: normal text and label key of each line, usable on batches and streams alike."""
    return lines.select("line_key", "document_id", "page_number", T.normalize_text(F.col("original_text")).alias("normalized"), T.normalize_label(T.literal_label(F.col("text"))).alias("label_key"))


def first_deliveries(observations: DataFrame, delay: str = "400 days") -> DataFrame:
    """Each observation once: repeated deliveries within the delay are dropped by state that the watermark bounds."""
    return observations.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["observation_id"])


def daily_counts(observations: DataFrame, delay: str = "400 days") -> DataFrame:
    """Deliveries by source and day of receipt, closed when the watermark passes the day."""
    return observations.withWatermark("received_at", delay).groupBy(F.window("received_at", "1 day"), "source_lab").agg(F.count("*").alias("deliveries"))


def run_to_folder(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs over all that is there, exactly once into parquet files; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
