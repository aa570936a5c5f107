"""Admission of input files, with everything that was refused on the record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.session import numbered

MOST_BYTES = 256 * 1024 * 1024
SIGNATURE = b"%PDF-"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, modificationTime, input_index) of the PDF files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    order = numbered(files.select("path"), "path", name="input_index").withColumn("input_index", (F.col("input_index") - 1).cast("int"))
    return files.join(order, "path")


def admit(paths: DataFrame, path: str = "path", order: str = "input_index") -> DataFrame:
    """Adds `admission`: Accepted, Invalid (no .pdf name) or Duplicate (a name that came before, in any letter case).

    NULL paths are Invalid. The order of the input decides which one came first.
    """
    lower = F.lower(F.col(path))
    valid = F.coalesce(lower.endswith(".pdf"), F.lit(False))
    first = F.row_number().over(W.partitionBy(lower).orderBy(order)) == 1
    return paths.withColumn("admission", F.when(~valid, "Invalid").when(first, "Accepted").otherwise("Duplicate"))


def inspect(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds `document_id` (doc- and twelve hex digits of the SHA-256) and `error`; never fails the job.

    Errors: Empty, TooLarge, NoSignature. A row with an error has no document id.
    """
    c = F.col(content)
    error = F.when(c.isNull() | (F.octet_length(c) == 0), "Empty").when(F.octet_length(c) > MOST_BYTES, "TooLarge").when(F.substring(c, 1, 5) != F.lit(SIGNATURE), "NoSignature")
    return files.withColumn("error", error).withColumn("document_id", F.when(F.col("error").isNull(), F.concat(F.lit("doc-"), F.substring(F.sha2(c, 256), 1, 12))))


def counters(admitted: DataFrame) -> DataFrame:
    """One row: inputs that were accepted, invalid, and duplicate."""
    return admitted.agg(*[F.count_if(F.col("admission") == a).alias(a.lower()) for a in ("Accepted", "Invalid", "Duplicate")])


def whole_ledger(ledger: DataFrame, failed: DataFrame) -> DataFrame:
    """The ledger of read documents and of those that failed, one row an input. No input, and failures alone, are errors."""
    rows = ledger.select("document_id", "input_index", "status", F.col("pages").cast("bigint").alias("pages"), "reason")
    if rows.isEmpty():
        raise ValueError("all inputs failed" if not failed.isEmpty() else "there is no input")
    return rows.unionByName(failed.select("document_id", "input_index", "status", "pages", "reason"))


def ledger_rows(inspected: DataFrame) -> DataFrame:
    """Failed inputs as ledger rows: id `failed-` and the input's number, no pages, the reason."""
    return inspected.where("error IS NOT NULL").select(F.format_string("failed-%04d", F.col("input_index") + 1).alias("document_id"), "input_index", F.lit("Failed").alias("status"), F.lit(None).cast("bigint").alias("pages"), F.col("error").alias("reason"))
