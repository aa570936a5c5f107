"""What a reader of the results must know: pages without lines, words on none, headers and footers that are incomplete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ("document_id", "page_number")


def reconstruction_notices(words: DataFrame, lines: DataFrame) -> DataFrame:
    """(document_id, page_number, severity, code): a page without a line is a Warning, a page with words on no line an Error."""
    placed = lines.groupBy(*PAGE).agg(F.count_distinct("word_id").alias("placed"))
    pages = words.groupBy(*PAGE).agg(F.count_distinct("word_id").alias("words")).join(placed, list(PAGE), "left").na.fill(0, ["placed"])
    empty = pages.where("placed = 0").select(*PAGE, F.lit("Warning").alias("severity"), F.lit("PageWithoutLines").alias("code"))
    lost = pages.where("placed < words").select(*PAGE, F.lit("Error").alias("severity"), F.lit("UnresolvedWords").alias("code"))
    return empty.unionByName(lost)


def sanitization_notices(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """(document_id, page_number, severity, code): missing identity or request fields, unresolved header fragments, no footer."""
    need = ("patient_name", "birth_date", "request_number", "request_date", "request_time")
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull() | (F.trim(c) == "")
    row = lambda df, code: df.select(*PAGE, F.lit("Warning").alias("severity"), F.lit(code).alias("code"))
    footed = lines.groupBy(*PAGE).agg(F.max((F.col("disposition") == "Footer").cast("int")).alias("f")).where("f = 0")
    return row(headers.where(missing), "HeaderIncomplete").unionByName(row(headers.where(F.coalesce(F.size("unresolved_fragments"), F.lit(0)) > 0), "UnresolvedFragments")).unionByName(row(footed, "FooterUnrecognized"))


def document_counters(words: DataFrame, lines: DataFrame, cells: DataFrame, losses: DataFrame) -> DataFrame:
    """Pages, words, lines, cells, attached scripts, words on no line and glyphs of no word, of each document."""
    w = words.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages"), F.count("*").alias("words"))
    by_page = lines.groupBy(*PAGE).agg((F.max("line_no") + 1).alias("lines"), F.count("attached_to").alias("attachments"))
    n = by_page.groupBy("document_id").agg(F.sum("lines").alias("lines"), F.sum("attachments").alias("attachments"))
    c = cells.groupBy("document_id").agg(F.count("*").alias("cells"))
    return w.join(n, "document_id", "left").join(c, "document_id", "left").join(losses, "document_id", "left").na.fill(0)
