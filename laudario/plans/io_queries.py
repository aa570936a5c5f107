"""Admission, exports, pipeline and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.plans.pipeline import reports
from laudario.session import checkpoint_dir
from laudario.sources import admission, sinks
from laudario.sources.tables import table
from laudario.streaming import ingest


def file_admission(spark, folder):
    files = table(spark, folder, "sanitized_header").groupBy("document_id").agg(F.min("input_index").alias("input_index"), F.min("file_name").alias("path"))
    return admission.admit(files).select("document_id", "path", "admission")


def content_inspection(spark, folder):
    """All texts taken for files, the signature in front of what isn't empty: fingerprint, or the reason why they are refused."""
    files = table(spark, folder, "documents").select("doc_id", F.encode(F.concat(F.when(F.length("text") > 0, F.lit("%PDF-")).otherwise(""), "text"), "UTF-8").alias("content"))
    return admission.inspect(files).select("doc_id", "error", "document_id")


def export_names(spark, folder):
    files = table(spark, folder, "sanitized_header").groupBy("document_id").agg(F.min("input_index").alias("input_index"), F.min("file_name").alias("file_name"))
    return sinks.unique_names(files).select("document_id", "output_name")


def page_dump(spark, folder):
    return sinks.page_dump(table(spark, folder, "sanitized_line"))


def pipeline_text_counts(spark, folder):
    """Texts and observations of the whole pipeline, each stage composed once."""
    inputs = {n: table(spark, folder, t) for n, t in (("headers", "sanitized_header"), ("lines", "sanitized_line"), ("concepts", "laboratory_concept"), ("derived_inputs", "derived_input"), ("lab_observations", "lab_observation"))}
    made = reports().run(inputs, ["observations", "texts", "blocks"])
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, df in made.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _run(spark, stream):
    """Runs a stream into a fresh folder of the shared checkpoint directory and reads it back."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    ingest.run_to_folder(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_first_deliveries(spark, folder):
    done = _run(spark, ingest.first_deliveries(ingest.stream_of(spark, folder, "lab_observation").select("observation_id", "source_lab", F.col("received_at").cast("timestamp").alias("received_at"))))
    return done.groupBy("source_lab").agg(F.count("*").alias("observations"))


def stream_lines(spark, folder):
    return _run(spark, ingest.normalized_lines(ingest.stream_of(spark, folder, "sanitized_line"))).select("line_key", "normalized", "label_key")


QUERIES = {f.__name__: f for f in (file_admission, content_inspection, export_names, page_dump, pipeline_text_counts, stream_first_deliveries, stream_lines)}
_FILES = "WITH f AS (SELECT document_id, min(input_index) AS input_index, min(file_name) AS file_name FROM sanitized_header GROUP BY ALL)"
SQL = {
    "file_admission": _FILES + """ SELECT document_id, file_name AS path, CASE WHEN NOT coalesce(ends_with(lower(file_name), '.pdf'), FALSE) THEN 'Invalid'
        WHEN row_number() OVER (PARTITION BY lower(file_name) ORDER BY input_index) = 1 THEN 'Accepted' ELSE 'Duplicate' END AS admission FROM f""",
    "content_inspection": """
        WITH c AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN '%PDF-' || text ELSE text END AS t FROM documents),
        e AS (SELECT doc_id, t, CASE WHEN t IS NULL OR strlen(t) = 0 THEN 'Empty' WHEN strlen(t) > 268435456 THEN 'TooLarge' WHEN NOT starts_with(t, '%PDF-') THEN 'NoSignature' END AS error FROM c)
        SELECT doc_id, error, CASE WHEN error IS NULL THEN 'doc-' || substr(sha256(t), 1, 12) END AS document_id FROM e""",
    "export_names": _FILES + """
        , s AS (SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' '), ''), 'document') AS stem FROM f),
        n AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY input_index, document_id) AS n FROM s)
        SELECT document_id, stem || CASE WHEN n > 1 THEN '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') ELSE '' END || '.json' AS output_name FROM n""",
    "page_dump": """
        SELECT document_id, page_number, '== ' || document_id || ' / ' || page_number || ' ==' || chr(10) || string_agg('[' || lpad(CAST(source_index AS VARCHAR), CAST(greatest(3, length(CAST(source_index AS VARCHAR))) AS INTEGER), '0') || '] ' || rpad(disposition, CAST(greatest(16, length(disposition)) AS INTEGER), ' ') || ' ' || coalesce(text, ''), chr(10) ORDER BY source_index, line_id) AS text
        FROM sanitized_line GROUP BY document_id, page_number""",
    "stream_first_deliveries": "SELECT source_lab, count(DISTINCT observation_id) AS observations FROM lab_observation GROUP BY ALL",
    "stream_lines": f"SELECT line_key, {T.sql_normalize_text('original_text')} AS normalized, {T.sql_normalize_label(T.sql_literal_label('text'))} AS label_key FROM sanitized_line",
}
