"""Text functions over whole tables of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.sources.tables import table


def text_normalize(spark, folder):
    c = F.col("original_text")
    return table(spark, folder, "sanitized_line").select("line_key", T.normalize_text(c).alias("normalized"), T.comparison_key(c).alias("comparison_key"))


def text_labels(spark, folder):
    c = F.col("text")
    return table(spark, folder, "sanitized_line").select("line_key", T.literal_label(c).alias("literal_label"), T.normalize_label(T.literal_label(c)).alias("label_key"))


def label_predicates(spark, folder):
    c = F.col("text")
    return table(spark, folder, "sanitized_line").select("line_key", T.is_upper_label(c).alias("upper_label"), T.is_any_label(c).alias("any_label"), T.is_section_title(c).alias("section_title"))


def result_segment(spark, folder):
    return table(spark, folder, "sanitized_line").select("line_key", T.result_segment(F.col("text")).alias("segment"))


def numeric_extraction(spark, folder):
    """Every number with its unit in the result segments of active lines."""
    seg = T.result_segment(F.col("text"))
    pattern = F.lit("(?i)" + T.NUMERIC)
    lines = table(spark, folder, "sanitized_line").where("disposition = 'Active'").select("line_key", F.regexp_extract_all(seg, pattern, 1).alias("v"), F.regexp_extract_all(seg, pattern, 2).alias("u"))
    return lines.select("line_key", F.posexplode(F.arrays_zip("v", "u")).alias("ord", "x")).select("line_key", "ord", F.col("x.v").alias("raw_value"), F.nullif("x.u", F.lit("")).alias("raw_unit"), T.parse_decimal(F.col("x.v")).cast("double").alias("numeric_value"))


def coded_observation(spark, folder):
    """Label and value of active lines that state something without a number."""
    c = F.col("text")
    seg = F.trim(T.result_segment(c))
    return (
        table(spark, folder, "sanitized_line").where("disposition = 'Active'").where(c.contains(":") & (F.length(seg) > 0) & ~seg.rlike(r"\d"))
        .where(~T.normalize_label(T.literal_label(c)).isin("MATERIAL", "AMOSTRA")).select("line_key", T.literal_label(c).alias("label"), seg.alias("coded_value"))
    )


def stable_keys(spark, folder):
    h = table(spark, folder, "sanitized_header")
    name, birth = T.identity_text(F.col("patient_name")), T.iso_or_raw(F.col("birth_date"))
    key = T.stable_id("patient", name, birth)
    return h.select("header_id", key.alias("patient_key"), T.stable_id("episode", key, T.identity_text(F.col("request_number")), T.iso_or_raw(F.col("request_date")), F.trim("request_time")).alias("episode_key"))


QUERIES = {f.__name__: f for f in (text_normalize, text_labels, label_predicates, result_segment, numeric_extraction, coded_observation, stable_keys)}

_SEG = T.sql_result_segment("text")
_NUM = T.NUMERIC.replace("'", "''")
_PATIENT = T.sql_stable_id("patient", T.sql_identity_text("patient_name"), T.sql_iso_or_raw("birth_date"))
SQL = {
    "text_normalize": f"SELECT line_key, {T.sql_normalize_text('original_text')} AS normalized, {T.sql_comparison_key('original_text')} AS comparison_key FROM sanitized_line",
    "text_labels": f"SELECT line_key, {T.sql_literal_label('text')} AS literal_label, {T.sql_normalize_label(T.sql_literal_label('text'))} AS label_key FROM sanitized_line",
    "label_predicates": f"SELECT line_key, {T.sql_is_upper_label('text')} AS upper_label, {T.sql_is_any_label('text')} AS any_label, {T.sql_is_section_title('text')} AS section_title FROM sanitized_line",
    "result_segment": f"SELECT line_key, {_SEG} AS segment FROM sanitized_line",
    "numeric_extraction": f"""
        WITH s AS (SELECT line_key, {_SEG} AS seg FROM sanitized_line WHERE disposition = 'Active'),
        m AS (SELECT line_key, regexp_extract_all(seg, '(?i){_NUM}', 1) AS v, regexp_extract_all(seg, '(?i){_NUM}', 2) AS u FROM s),
        x AS (SELECT line_key, unnest(range(len(v))) AS i, v, u FROM m)
        SELECT line_key, CAST(i AS INTEGER) AS ord, v[i + 1] AS raw_value, nullif(u[i + 1], '') AS raw_unit, CAST({T.sql_parse_decimal('v[i + 1]')} AS DOUBLE) AS numeric_value FROM x""",
    "coded_observation": f"""
        SELECT line_key, {T.sql_literal_label('text')} AS label, trim({_SEG}, ' ') AS coded_value FROM sanitized_line
        WHERE disposition = 'Active' AND contains(text, ':') AND length(trim({_SEG}, ' ')) > 0 AND NOT regexp_matches({_SEG}, '\\d')
        AND {T.sql_normalize_label(T.sql_literal_label('text'))} NOT IN ('MATERIAL', 'AMOSTRA')""",
    "stable_keys": f"""
        SELECT header_id, {_PATIENT} AS patient_key, {T.sql_stable_id('episode', _PATIENT, T.sql_identity_text('request_number'), T.sql_iso_or_raw('request_date'), "trim(request_time, ' ')")} AS episode_key FROM sanitized_header""",
}
