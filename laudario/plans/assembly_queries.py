"""Assembly of patients and episodes over the page headers and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.operators import assemble as A
from laudario.operators import derived as D
from laudario.sources import admission
from laudario.sources.tables import table


def _h(spark, folder):
    return table(spark, folder, "sanitized_header")


def _l(spark, folder):
    return table(spark, folder, "sanitized_line")


def assembly_ledger(spark, folder):
    return A.ledger(_h(spark, folder))


def assembly_documents(spark, folder):
    return A.document_identity(_h(spark, folder))


def assembly_episodes(spark, folder):
    return A.episodes(_h(spark, folder))


def assembly_order(spark, folder):
    return A.ordered_episodes(_h(spark, folder))


def patient_order(spark, folder):
    return A.ordered_patients(_h(spark, folder))


def page_order(spark, folder):
    return A.ordered_pages(_h(spark, folder))


def canonical_blocks(spark, folder):
    return A.content_blocks(_h(spark, folder), _l(spark, folder))


def assembly_coverage(spark, folder):
    return A.coverage(_h(spark, folder), _l(spark, folder))


def age_at_request(spark, folder):
    return A.ages(_h(spark, folder))


def egfr_provenance(spark, folder):
    return D.provenance(table(spark, folder, "derived_input"), A.accepted_pages(_h(spark, folder)))


def assembly_whole_ledger(spark, folder):
    """The ledger with failed inputs; documents without a text stand for files that could not be read."""
    files = table(spark, folder, "documents").where(F.coalesce(F.length("text"), F.lit(0)) == 0).select((F.col("doc_id") + 1_000_000_000).alias("input_index"), F.lit("Empty").alias("error"))
    return admission.whole_ledger(A.ledger(_h(spark, folder)), admission.ledger_rows(files))


def assembly_totals(spark, folder):
    """Patients, episodes and pages of the batch, with refused documents and pages without an episode."""
    h = _h(spark, folder)
    led = A.ledger(h).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "Rejected").alias("rejected_documents"), F.sum("pages").alias("pages"))
    pages = A.accepted_pages(h).agg(F.count_distinct("patient_key").alias("patients"), F.count_distinct("episode_key").alias("episodes"), F.count("*").alias("assigned_pages"))
    return led.crossJoin(pages)  # two rows of totals


QUERIES = {f.__name__: f for f in (assembly_ledger, assembly_documents, assembly_episodes, assembly_order, patient_order, page_order, canonical_blocks, assembly_coverage, age_at_request, egfr_provenance, assembly_whole_ledger, assembly_totals)}

_KEY = T.sql_stable_id("patient", T.sql_identity_text("patient_name"), T.sql_iso_or_raw("birth_date"))
_NO = "({0} IS NULL OR trim({0}, ' ') = '')"
_BASE = f"""
    WITH keyed AS (SELECT *, lower(trim(sex, ' ')) AS sex_key,
        CASE WHEN NOT {_NO.format('patient_name')} AND NOT {_NO.format('birth_date')} THEN {_KEY} END AS patient_key FROM sanitized_header),
    paged AS (SELECT *, CASE WHEN patient_key IS NOT NULL AND NOT {_NO.format('request_number')} AND NOT {_NO.format('request_date')} AND NOT {_NO.format('request_time')}
        THEN {T.sql_stable_id('episode', 'patient_key', T.sql_identity_text('request_number'), T.sql_iso_or_raw('request_date'), "trim(request_time, ' ')")} END AS episode_key FROM keyed),
    w AS (SELECT *, first_value(patient_key) OVER (PARTITION BY document_id ORDER BY page_number, header_id) AS first_key,
        first_value(sex_key IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, header_id ROWS UNBOUNDED PRECEDING) AS first_sex FROM paged),
    r AS (SELECT *, CASE WHEN patient_key IS NULL THEN 'MissingIdentity' WHEN patient_key <> first_key THEN 'ConflictingIdentity' WHEN sex_key <> first_sex THEN 'ConflictingSex' END AS reason FROM w),
    docs AS (SELECT document_id, min(input_index) AS input_index, first(file_name ORDER BY page_number, header_id) AS file_name, first(patient_key ORDER BY page_number, header_id) AS patient_key,
        first(sex_key ORDER BY page_number, header_id) FILTER (sex_key IS NOT NULL) AS sex_key, count(*) AS pages, count(*) FILTER (episode_key IS NULL) AS unassigned_pages,
        first(reason ORDER BY page_number, header_id) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY document_id),
    firsts AS (SELECT patient_key, first(sex_key ORDER BY input_index, document_id) AS patient_sex FROM docs WHERE reason IS NULL GROUP BY patient_key),
    led AS (SELECT document_id, input_index, file_name, docs.patient_key,
        CASE WHEN coalesce(reason, CASE WHEN sex_key <> patient_sex THEN 'SexIncompatible' END) IS NOT NULL THEN 'Rejected' WHEN unassigned_pages > 0 THEN 'AssignedWithUnassignedPages' ELSE 'Assigned' END AS status,
        pages, unassigned_pages, coalesce(reason, CASE WHEN sex_key <> patient_sex THEN 'SexIncompatible' END) AS reason FROM docs LEFT JOIN firsts USING (patient_key)),
    acc AS (SELECT * FROM paged WHERE episode_key IS NOT NULL AND document_id IN (SELECT document_id FROM led WHERE status <> 'Rejected')),
    content AS (SELECT document_id, page_number, sha256(string_agg(text, chr(31) ORDER BY source_index, line_id, text)) AS fingerprint, count(*) AS lines FROM sanitized_line WHERE disposition = 'Active' GROUP BY ALL),
    grouped AS (SELECT episode_key, fingerprint, min((input_index, document_id, page_number, header_id)) AS o, count(*) AS sources, any_value(lines) AS lines FROM acc JOIN content USING (document_id, page_number) GROUP BY ALL),
    blocks AS (SELECT episode_key, fingerprint, row_number() OVER (PARTITION BY episode_key ORDER BY o) - 1 AS ordinal, sources, lines FROM grouped),
    eps AS (SELECT patient_key, episode_key, first(request_number ORDER BY input_index, document_id, page_number, header_id) AS request_number, first(request_date ORDER BY input_index, document_id, page_number, header_id) AS request_date,
        first(request_time ORDER BY input_index, document_id, page_number, header_id) AS request_time, count(*) AS pages, count(DISTINCT document_id) AS documents FROM acc GROUP BY ALL),
    spelled AS (SELECT episode_key, lower(origin) AS k, min((input_index, document_id, page_number, header_id)) AS o, first(origin ORDER BY input_index, document_id, page_number, header_id) AS origin FROM acc WHERE NOT {_NO.format('origin')} GROUP BY ALL),
    origins AS (SELECT episode_key, string_agg(origin, ' | ' ORDER BY o) AS origins FROM spelled GROUP BY ALL)
"""
SQL = {
    "egfr_provenance": _BASE + """
        , hp AS (SELECT episode_key, count(*) AS header_pages, CAST(sum(coalesce(len(source_line_ids), 0)) AS BIGINT) AS header_lines FROM acc GROUP BY ALL),
        dv AS (SELECT derived_observation_id, coalesce(string_agg(DISTINCT source_observation_id, ',' ORDER BY source_observation_id), '') AS sources, min(episode_key) AS episode_key FROM derived_input GROUP BY ALL)
        SELECT derived_observation_id, sources, coalesce(header_pages, 0) AS header_pages, coalesce(header_lines, 0) AS header_lines FROM dv LEFT JOIN hp USING (episode_key)""",
    "assembly_whole_ledger": _BASE + """
        SELECT document_id, input_index, status, pages, reason FROM led
        UNION ALL SELECT 'failed-' || CAST(doc_id + 1000000001 AS VARCHAR), doc_id + 1000000000, 'Failed', NULL, 'Empty' FROM documents WHERE coalesce(length(text), 0) = 0""",
    "assembly_documents": _BASE + "SELECT * FROM docs",
    "assembly_ledger": _BASE + "SELECT * FROM led",
    "assembly_episodes": _BASE + "SELECT eps.*, origins FROM eps LEFT JOIN origins USING (episode_key)",
    "assembly_order": _BASE + "SELECT patient_key, episode_key, row_number() OVER (PARTITION BY patient_key ORDER BY try_strptime(request_date || ' ' || request_time, '%d/%m/%Y %H:%M:%S') DESC NULLS FIRST, request_number, episode_key) AS place FROM eps",
    "patient_order": _BASE + f"""
        , ps AS (SELECT patient_key, first(patient_name ORDER BY input_index, document_id, page_number, header_id) AS patient_name, first(birth_date ORDER BY input_index, document_id, page_number, header_id) AS birth_date FROM acc GROUP BY ALL)
        SELECT *, row_number() OVER (ORDER BY {T.sql_identity_text('patient_name')}, birth_date, patient_key) AS place FROM ps""",
    "page_order": _BASE + "SELECT episode_key, header_id, CAST(row_number() OVER (PARTITION BY episode_key ORDER BY input_index, page_number, document_id, header_id) AS INTEGER) AS place FROM acc",
    "canonical_blocks": _BASE + f"SELECT episode_key, fingerprint, ordinal, sources, lines, {T.sql_stable_id('block', 'episode_key', 'fingerprint', 'ordinal')} AS block_id FROM blocks",
    "assembly_coverage": _BASE + """
        , src AS (SELECT episode_key, count(*) AS pages, count(fingerprint) AS active_pages, coalesce(sum(lines), 0) AS source_lines FROM acc LEFT JOIN content USING (document_id, page_number) GROUP BY ALL),
        b AS (SELECT episode_key, count(*) AS blocks, sum(lines) AS canonical_lines, sum(sources) AS block_sources, sum(lines * (sources - 1)) AS saved_lines FROM blocks GROUP BY ALL)
        SELECT episode_key, pages, active_pages, CAST(source_lines AS BIGINT) AS source_lines, coalesce(blocks, 0) AS blocks, CAST(coalesce(canonical_lines, 0) AS BIGINT) AS canonical_lines, CAST(coalesce(block_sources, 0) AS BIGINT) AS block_sources,
        CAST(coalesce(saved_lines, 0) AS BIGINT) AS saved_lines, coalesce(block_sources, 0) = active_pages AND coalesce(canonical_lines, 0) + coalesce(saved_lines, 0) = source_lines AS lossless FROM src LEFT JOIN b USING (episode_key)""",
    "assembly_totals": _BASE + """
        SELECT (SELECT count(*) FROM led) AS documents, (SELECT count(*) FROM led WHERE status = 'Rejected') AS rejected_documents, (SELECT CAST(sum(pages) AS BIGINT) FROM led) AS pages,
        (SELECT count(DISTINCT patient_key) FROM acc) AS patients, (SELECT count(DISTINCT episode_key) FROM acc) AS episodes, (SELECT count(*) FROM acc) AS assigned_pages""",
    "age_at_request": """
        WITH d AS (SELECT header_id, CASE WHEN regexp_matches(birth_date, '^\\d{2}/\\d{2}/\\d{4}$') THEN CAST(try_strptime(birth_date, '%d/%m/%Y') AS DATE) END AS b,
            CASE WHEN regexp_matches(request_date, '^\\d{2}/\\d{2}/\\d{4}$') THEN CAST(try_strptime(request_date, '%d/%m/%Y') AS DATE) END AS r FROM sanitized_header)
        SELECT header_id, CASE WHEN b IS NULL THEN 'BirthDateInvalid' WHEN r IS NULL THEN 'RequestDateInvalid' WHEN r < b THEN 'RequestBeforeBirth' ELSE 'Computed' END AS age_status,
        CASE WHEN b IS NOT NULL AND r >= b THEN CAST(year(r) - year(b) - CASE WHEN r < b + to_years(CAST(year(r) - year(b) AS INTEGER)) THEN 1 ELSE 0 END AS INTEGER) END AS age FROM d""",
}
