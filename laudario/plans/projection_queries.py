"""Clinical text over laboratory observations."""

from __future__ import annotations

from laudario.operators import derived as D
from laudario.operators import project as P
from laudario.operators import render as R
from laudario.plans.measure_queries import _ASSESSED
from laudario.sources.tables import table


def _rendered(spark, folder, **options):
    rates = D.assess(D.with_candidates(table(spark, folder, "derived_input")))
    return P.occurrences(table(spark, folder, "lab_observation"), table(spark, folder, "laboratory_concept"), rates, **options)


def concept_rank(spark, folder):
    return P.ranked(_rendered(spark, folder))


def occurrence_pieces(spark, folder):
    return _rendered(spark, folder, units=True).select("occurrence_id", "concept_id", "piece", "disposition", "notice")


def clinical_text(spark, folder):
    return P.episode_texts(_rendered(spark, folder)).select("patient_key", "episode_key", "text")


def clinical_text_without_cultures(spark, folder):
    return P.episode_texts(_rendered(spark, folder, cultures=False)).select("patient_key", "episode_key", "text")


def patient_text(spark, folder):
    """The texts of each patient's episodes in their order, under a heading with the name."""
    return P.patient_texts(_rendered(spark, folder), table(spark, folder, "patient_identity"))


def culture_notices(spark, folder):
    return P.culture_notices(_rendered(spark, folder))


def culture_review(spark, folder):
    return P.culture_review(_rendered(spark, folder))


def projection_coverage(spark, folder):
    return P.coverage(_rendered(spark, folder, cultures=False))


def projection_totals(spark, folder):
    done = _rendered(spark, folder, cultures=False)
    return P.coverage_totals(done, P.fields(done, cultures=False))


def field_locations(spark, folder):
    """Every field of every occurrence with the line that shows it, cultures hidden."""
    return P.fields(_rendered(spark, folder, cultures=False), cultures=False).select("occurrence_id", "kind", "field", "disposition", "reason", "line")


QUERIES = {f.__name__: f for f in (concept_rank, occurrence_pieces, clinical_text, clinical_text_without_cultures, patient_text, culture_notices, culture_review, projection_coverage, projection_totals, field_locations)}

_RANK = "(VALUES " + ", ".join(f"('{c}', {g}, {o}, {'NULL' if s is None else repr(s)})" for c, g, o, s in P.rank_rows()) + ") AS rank(concept_id, grp, ord, short)"
_MICRO = "coalesce(form IN ('microbiology-culture', 'susceptibility-panel'), FALSE)"
_OWN = "(concept_id IN ('lab.urina-tipo-i', 'lab.gasometria-arterial', 'lab.gasometria-venosa') OR contains(concept_id, 'cultura') OR contains(concept_id, 'antibiograma'))"


def _sql(units: bool = False, cultures: bool = True) -> str:
    """In the table an occurrence is one observation, delivered once or more often."""
    shown = "raw_value || CASE WHEN trim(coalesce(raw_unit, ''), ' ') <> '' THEN ' ' || raw_unit ELSE '' END" if units else "raw_value"
    hidden = "FALSE" if cultures else _MICRO
    return _ASSESSED + f"""
    , rates AS (SELECT source_observation_id AS observation_id, max(e.value) AS r FROM e JOIN derived_input USING (derived_observation_id) WHERE reason IS NULL GROUP BY ALL),
    once AS (SELECT * FROM lab_observation QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY received_at, patient_key, episode_key, occurrence_id, concept_id, label, raw_value, raw_unit, requested_at) = 1),
    named AS (SELECT once.* EXCLUDE (label, raw_value), coalesce(label, '') AS label, coalesce(raw_value, '') AS raw_value, structural_form_id AS form, coalesce(grp, {P.LAST}) AS grp, coalesce(ord, {P.LAST}) AS ord, coalesce(short, {R.sql_title_case('display_name')}, {R.sql_title_case('once.label')}, '') AS name,
        CAST(CAST(floor(r) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(r * 10) AS BIGINT) % 10 AS VARCHAR) AS rate
        FROM once LEFT JOIN rates USING (observation_id) LEFT JOIN {_RANK} USING (concept_id) LEFT JOIN laboratory_concept USING (concept_id)),
    made AS (SELECT *, CASE WHEN {_MICRO} THEN name || ':' || CASE WHEN trim(raw_value, ' ') <> '' THEN ' ' || raw_value ELSE '' END WHEN trim(raw_value, ' ') = '' THEN NULL
        WHEN coalesce(form IN ('key-value-panel', 'sectioned-panel', 'multi-analyte-panel', 'indexed-assay'), FALSE) THEN name || ': ' || {R.sql_component('label')} || ' ' || {shown} ELSE name || ' ' || {shown} || coalesce(' | TFG ' || rate, '') END AS line FROM named),
    rendered AS (SELECT *, CASE WHEN {hidden} THEN NULL WHEN line IS NOT NULL THEN line ELSE 'Resultado não estruturado: ' || label END AS piece,
        CASE WHEN {hidden} THEN 'SuppressedByExplicitPolicy' WHEN line IS NULL THEN 'SafeFallback' ELSE 'Rendered' END AS disposition,
        CASE WHEN {hidden} THEN NULL WHEN line IS NULL THEN 'safe-fallback' WHEN form = 'susceptibility-panel' THEN 'unlinked-susceptibility-preserved' END AS notice FROM made),
    g AS (SELECT patient_key, episode_key, min(requested_at) AS ts, string_agg(piece, ' | ' ORDER BY grp, ord, occurrence_id) FILTER (piece IS NOT NULL AND NOT {_OWN}) AS plain,
        string_agg(piece, chr(10) ORDER BY grp, ord, occurrence_id) FILTER (piece IS NOT NULL AND {_OWN}) AS own, bool_or(disposition = 'SuppressedByExplicitPolicy' AND {_OWN}) AS hid FROM rendered GROUP BY ALL),
    t AS (SELECT patient_key, episode_key, ts, 'Laboratoriais (' || coalesce(strftime(ts, '%d/%m/%Y – %H:%M'), 'sem data') || '):' || CASE WHEN plain IS NOT NULL THEN ' ' || plain WHEN own IS NOT NULL THEN '' WHEN hid THEN ' {P.HIDDEN}' ELSE ' {P.EMPTY}' END
        || coalesce(chr(10) || own, '') AS text FROM g),
    fields AS (SELECT occurrence_id, 'Observation' AS kind, observation_id AS field, piece, disposition <> 'SuppressedByExplicitPolicy' AS shows, trim(raw_value, ' ') <> '' AND contains(lower(piece), lower(raw_value)) AS found, 'culture-review-only' AS reason FROM rendered
        UNION ALL SELECT occurrence_id, 'DerivedObservation', 'derived[0]', piece, disposition <> 'SuppressedByExplicitPolicy', contains(piece, 'TFG ' || rate), 'not-computed-audit-only' FROM rendered WHERE rate IS NOT NULL),
    located AS (SELECT occurrence_id, kind, field, CASE WHEN shows AND found THEN 'Projected' ELSE 'AuditOnly' END AS disposition, CASE WHEN shows AND found THEN 'rendered' WHEN shows THEN 'not-selected-by-editorial-policy' ELSE reason END AS reason, CASE WHEN shows AND found THEN 0 END AS line FROM fields)
    """


SQL = {
    "concept_rank": _sql() + "SELECT episode_key, occurrence_id, grp, ord, row_number() OVER (PARTITION BY episode_key ORDER BY grp, ord, occurrence_id) AS place FROM rendered",
    "occurrence_pieces": _sql(units=True) + "SELECT occurrence_id, concept_id, piece, disposition, notice FROM rendered",
    "clinical_text": _sql() + "SELECT patient_key, episode_key, text FROM t",
    "clinical_text_without_cultures": _sql(cultures=False) + "SELECT patient_key, episode_key, text FROM t",
    "patient_text": _sql() + """
        SELECT patient_key, row_number() OVER (PARTITION BY patient_key ORDER BY ts DESC NULLS LAST, episode_key) AS place, episode_key, text FROM t
        UNION ALL SELECT patient_key, 0, NULL, 'Paciente: ' || coalesce(first(patient_name ORDER BY first_input_index NULLS FIRST, patient_name NULLS FIRST), '') FROM patient_identity WHERE patient_key IN (SELECT patient_key FROM t) GROUP BY patient_key""",
    "culture_notices": _sql() + f"SELECT patient_key, count(*) AS occurrences, count(DISTINCT episode_key) AS episodes FROM rendered WHERE {_MICRO} GROUP BY ALL",
    "culture_review": _sql() + f"SELECT patient_key, episode_key, occurrence_id, piece AS lines FROM rendered WHERE {_MICRO} AND piece IS NOT NULL",
    "projection_coverage": _sql(cultures=False) + "SELECT disposition, count(*) AS occurrences, count(*) AS fields FROM rendered GROUP BY ALL",
    "projection_totals": _sql(cultures=False) + """
        , o AS (SELECT count(*) AS occurrences, count(DISTINCT episode_key) AS episodes, count(DISTINCT patient_key) AS patients, count(*) FILTER (disposition = 'Rendered') AS rendered, count(*) FILTER (disposition = 'SafeFallback') AS safe_fallbacks,
            count(*) FILTER (disposition = 'SuppressedByExplicitPolicy') AS suppressed, count(*) AS observations, count(notice) AS notices FROM rendered),
        f AS (SELECT count(*) AS fields, count(*) FILTER (kind = 'Observation') AS observation_fields, count(*) FILTER (disposition = 'Projected') AS projected_fields, count(*) FILTER (disposition = 'AuditOnly') AS audit_fields, 0 AS suppressed_fields FROM located)
        SELECT *, rendered + safe_fallbacks + suppressed = occurrences AND observation_fields = observations AND projected_fields + audit_fields + suppressed_fields = fields AS is_complete FROM o, f""",
    "field_locations": _sql(cultures=False) + "SELECT occurrence_id, kind, field, disposition, reason, CAST(line AS INTEGER) AS line FROM located",
}
