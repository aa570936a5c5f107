"""Queries of the text problems over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laudario.llm import bpe, canonical, leakage, lookalike, names, truncation
from laudario.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.p1_found(table(spark, folder, "exam_entry"), table(spark, folder, "laboratory_concept"))


def p1_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that stand for no concept, with how often they were entered, by channel."""
    entries = canonical.entry_table(table(spark, folder, "laboratory_concept"))
    done = canonical.canonicalize(table(spark, folder, "exam_entry").select("entered_label", "entry_channel"), "entered_label", entries)
    return done.where(F.col("concept_id") == canonical.UNMATCHED).groupBy("entry_channel", "entered_label").agg(F.count("*").alias("entries"))


def _characters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, folder, t) for t in ("sanitized_line", "capture_word", "capture_glyph"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.p4_found(*_characters(spark, folder))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.p4_repaired(*_characters(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.p5_found(table(spark, folder, "patient_identity"), table(spark, folder, "requester_identity"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the groups of spellings, by kind of table."""
    groups = names.entity_groups(table(spark, folder, "patient_identity"), table(spark, folder, "requester_identity"))
    return groups.groupBy("kind", "group").agg(F.count("*").alias("spellings")).groupBy("kind", "spellings").agg(F.count("*").alias("groups"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.p6_ids(table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """By source: documents, tokens, and documents whose decoded ids differ from their text."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    coded = bpe.encode_column(documents, ["doc_id", "source", "text"], "text").withColumnRenamed("text", "original")
    back = bpe.decode_column(coded, ["source", "original", "ids"], "ids")
    return back.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.count_if(F.col("text") != F.coalesce("original", F.lit(""))).alias("different")
    )


def p6_exact(spark: SparkSession, folder: str) -> DataFrame:
    """By source: documents, and those whose decoded ids differ from their text; there must be none."""
    return p6_round_trip(spark, folder).select("source", "documents", "different")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.p7_found(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.p8_found(table(spark, folder, "documents"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.p8_rates(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_misses, p4_found, p4_repaired, p5_found, p5_groups, p6_ids, p6_round_trip, p6_exact, p7_found, p8_found, p8_rates)}

# Which rows are cases of p4 is a matter of their characters alone, so SQL can tell.
_ORDINARY = "\\x00-\\x7F" + lookalike.LETTERS + lookalike.SIGNS
SQL = {
    "p6_exact": "SELECT source, count(*) AS documents, 0 AS different FROM documents GROUP BY source",
    "p4_found": f"""
        SELECT table_name, record_key FROM (
            SELECT 'sanitized_line' AS table_name, line_key AS record_key, original_text AS t FROM sanitized_line
            UNION ALL SELECT 'capture_word', word_key, text FROM capture_word
            UNION ALL SELECT 'capture_glyph', glyph_key, text FROM capture_glyph)
        WHERE regexp_matches(t, '[^{_ORDINARY}]')""",
}
