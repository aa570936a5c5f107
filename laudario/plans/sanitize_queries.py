"""Line classification over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.operators import sanitize as S
from laudario.operators.notes import BLOCK_STARTS, FOOTER_REST, FOOTER_START, NOTE_RULES
from laudario.sources.tables import table


def _l(spark, folder):
    return table(spark, folder, "sanitized_line")


def line_predicates(spark, folder):
    return S.predicates(_l(spark, folder)).select("line_key", "hist", "method", "calc", "boundary", "marker", "fragment", "balance", "empty_label")


def note_rules(spark, folder):
    return S.predicates(_l(spark, folder)).where("rule IS NOT NULL").select("line_key", "rule", "long")


def page_bounds(spark, folder):
    return S.bounds(S.predicates(_l(spark, folder))).groupBy(*S.PAGE).agg(F.min("header_end").alias("header_end"), F.min("footer_start").alias("footer_start"), F.count("*").alias("lines"))


def line_states(spark, folder):
    return S.classify(_l(spark, folder)).select("line_key", "class")


def line_state_counts(spark, folder):
    """Lines by given disposition and computed class."""
    return S.classify(_l(spark, folder)).groupBy("disposition", "class").agg(F.count("*").alias("lines"))


def header_fields(spark, folder):
    return S.parse_header(_l(spark, folder)).withColumn("source_line_ids", F.array_join("source_line_ids", ",")).withColumn("unresolved_fragments", F.array_join("unresolved_fragments", "\n"))


def parenthesis_joins(spark, folder):
    return S.parenthesis_joins(_l(spark, folder))


def sanitize_counters(spark, folder):
    return S.counters(_l(spark, folder))


QUERIES = {f.__name__: f for f in (line_predicates, note_rules, page_bounds, line_states, line_state_counts, header_fields, parenthesis_joins, sanitize_counters)}


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_RULE = "CASE " + " ".join(f"WHEN starts_with(key, {_s(p)}) THEN {_s(r)}" for r, p, _ in NOTE_RULES) + " END"
_BLOCK = "CASE " + " ".join(f"WHEN regexp_replace(key, ':+$', '') = {_s(h)} AND starts_with(coalesce(next_key, ''), {_s(p)}) THEN {_s(r)}" for r, h, p in BLOCK_STARTS) + " END"
_LONG = " OR ".join(f"starts_with(key, {_s(p)})" for _, p, long in NOTE_RULES if long)
_PRED = f"""
    WITH n AS (SELECT *, {T.sql_normalize_text('text')} AS norm FROM sanitized_line),
    k AS (SELECT *, {T.sql_comparison_key('norm')} AS key FROM n),
    p0 AS (SELECT *, lead(key) OVER (PARTITION BY document_id, page_number ORDER BY source_index, line_id) AS next_key,
        starts_with(lower(norm), 'resultados anteriores') OR starts_with(lower(norm), 'resultado anterior') AS hist,
        starts_with(lower(norm), 'método') OR starts_with(lower(norm), 'metodo') AS method, regexp_matches(norm, '(?i)^Idade:\\s*\\d+\\s+Sexo:\\s*\\S+$') AS calc,
        regexp_replace(key, ':+$', '') IN ('VALOR DE', 'VALORES DE', 'REFERENCIA', 'REFERENCIAS') AS fragment, starts_with(lower(norm), 'material') AS material,
        regexp_matches(key, '^(NOTA|ATENCAO|OBSERVACAO|OBSERVACOES)') AS marker, CAST(len(regexp_extract_all(norm, '\\(')) - len(regexp_extract_all(norm, '\\)')) AS INTEGER) AS balance,
        replace(key, '.', '') IN ('OBSERVACAO:', 'OBSERVACOES:') AS empty_label FROM k),
    p AS (SELECT *, coalesce({_RULE}, {_BLOCK}) AS rule, ({_LONG}) AS long, balance > 0 OR regexp_matches(norm, '[-=]\\s*$') AS open_end,
        method OR material OR hist OR regexp_matches(norm, '{S.REFERENCE.replace("'", "''")}') OR fragment OR {T.sql_is_upper_label('norm')} OR {T.sql_is_any_label('norm')} OR {T.sql_is_section_title('norm')} AS boundary FROM p0)
"""
_FOOT = " AND ".join(f"coalesce(max(CASE WHEN starts_with(lower(norm), {_s(p.lower())}) THEN 1 ELSE 0 END) OVER after, 0) = 1" for p in FOOTER_REST)
_BOUNDS = _PRED + f"""
    , b0 AS (SELECT *, CAST(row_number() OVER pg - 1 AS INTEGER) AS i, starts_with(lower(norm), {_s(FOOTER_START.lower())}) AND {_FOOT} AS can_foot FROM p
        WINDOW pg AS (PARTITION BY document_id, page_number ORDER BY source_index, line_id), after AS (PARTITION BY document_id, page_number ORDER BY source_index, line_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    b AS (SELECT *, min(CASE WHEN starts_with(lower(norm), 'data col') THEN i END) OVER (PARTITION BY document_id, page_number) AS header_end, min(CASE WHEN can_foot THEN i END) OVER (PARTITION BY document_id, page_number) AS footer_start FROM b0)
"""
_W = "(PARTITION BY document_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"


def _last(test: str, end: str = "CURRENT ROW") -> str:
    return f"coalesce(max(CASE WHEN body AND ({test}) THEN i END) OVER {_W.format(end)}, -1)"


_STATES = _BOUNDS + f"""
    , c0 AS (SELECT *, NOT coalesce(i <= header_end, FALSE) AND NOT coalesce(i >= footer_start, FALSE) AS body FROM b),
    c1 AS (SELECT *, {_last('hist')} AS last_hist, {_last('boundary AND NOT hist')} AS last_break FROM c0),
    c2 AS (SELECT *, body AND last_hist > last_break AS in_hist FROM c1),
    c3 AS (SELECT *, rule IS NOT NULL AND NOT in_hist AS start FROM c2),
    c4 AS (SELECT *, {_last('start')} AS last_note, last_value(CASE WHEN body AND start THEN long END IGNORE NULLS) OVER {_W.format('CURRENT ROW')} AS note_long, {_last('(boundary OR marker) AND NOT start AND NOT in_hist')} AS note_end FROM c3),
    c5 AS (SELECT *, body AND NOT in_hist AND last_note > last_hist AND (coalesce(note_long, FALSE) OR note_end < last_note) AS in_note FROM c4),
    c6 AS (SELECT *, NOT in_hist AND NOT in_note AS free FROM c5),
    c7 AS (SELECT *, {_last('method AND free', '1 PRECEDING')} AS last_method, {_last('free AND NOT calc AND NOT open_end', '1 PRECEDING')} AS last_closed, {_last('free AND NOT calc AND NOT method AND (boundary OR marker)')} AS last_other FROM c6),
    s AS (SELECT *, CASE WHEN coalesce(i <= header_end, FALSE) THEN 'Header' WHEN coalesce(i >= footer_start, FALSE) THEN 'Footer' WHEN in_hist THEN 'History' WHEN in_note THEN 'BoilerplateNote'
        WHEN free AND (method OR calc OR (last_method >= 0 AND last_method > last_hist AND last_method > last_note AND last_closed < last_method AND last_other < last_method)) THEN 'Method'
        WHEN empty_label THEN 'EmptyLabel' WHEN fragment THEN 'Reference' WHEN NOT material AND regexp_matches(norm, '^{S.REFERENCE.replace("'", "''")}') THEN 'Reference' ELSE 'Active' END AS class FROM c7)
"""
_KNOWN = " OR ".join(f"starts_with(lower({{0}}), {_s(p.lower())})" for p in S.HEADER_LABELS)


def _at(test: str) -> str:
    return f"coalesce(list_max(list_filter(range(n), lambda i: {test.format('t[i + 1]')})), -1)"


def _group(name: str, pattern: str, g: int) -> str:
    return f"nullif(trim(regexp_extract(t[at_{name} + 1], {_s(pattern)}, {g}), ' '), '')"


def _content(name: str) -> str:
    return f"regexp_extract(t[at_{name} + 1], '^[^:]*:(.*)$', 1)"


def _parted(name: str, label: str) -> tuple[str, str]:
    c = _content(name)
    at = f"strpos(lower({c}), {_s(label.lower() + ':')})"
    return f"nullif(trim(CASE WHEN {at} > 0 THEN substr({c}, 1, {at} - 1) ELSE {c} END, ' '), '')", f"nullif(trim(CASE WHEN {at} > 0 THEN substr({c}, {at} + {len(label) + 1}) END, ' '), '')"


def _run_on(first: str, begin: str, stop: str) -> str:
    more = f"list_filter(range(n), lambda i: i > {begin} AND i < {stop} AND NOT ({_KNOWN.format('t[i + 1]')}))"
    return f"nullif(array_to_string(list_concat(CASE WHEN {first} IS NULL THEN [] ELSE [{first}] END, list_transform({more}, lambda i: t[i + 1])), ' '), '')"


_REQ, _REG = _parted("requester", "Registro")
_ORI, _HOUR = _parted("source", "Hora Req")
_HEADER = f"""
    WITH n0 AS (SELECT document_id, page_number, source_index, line_id, {T.sql_normalize_text("coalesce(text, '')")} AS norm FROM sanitized_line),
    n1 AS (SELECT *, row_number() OVER w AS r FROM n0 WINDOW w AS (PARTITION BY document_id, page_number ORDER BY source_index, line_id)),
    n2 AS (SELECT *, min(CASE WHEN starts_with(lower(norm), 'data col') THEN r END) OVER (PARTITION BY document_id, page_number) AS last_r FROM n1),
    h0 AS (SELECT document_id, page_number, coalesce(list(norm ORDER BY r) FILTER (r <= last_r), []) AS t, coalesce(list(line_id ORDER BY r) FILTER (r <= last_r), []) AS ids FROM n2 GROUP BY ALL),
    h1 AS (SELECT *, len(t) AS n FROM h0),
    h2 AS (SELECT *, {_at(f"regexp_matches({{0}}, {_s(S.PATIENT)})")} AS at_patient, {_at(f"regexp_matches({{0}}, {_s(S.BIRTH)})")} AS at_birth, {_at("starts_with(lower({0}), 'solicitante')")} AS at_requester, {_at("starts_with(lower({0}), 'registro')")} AS at_registry,
        {_at(f"regexp_matches({{0}}, {_s(S.REQUEST)})")} AS at_request, {_at("starts_with(lower({0}), 'origem')")} AS at_source, {_at("starts_with(lower({0}), 'hora req')")} AS at_hour, {_at(f"regexp_matches({{0}}, {_s(S.COLLECTION)})")} AS at_collection FROM h1),
    h3 AS (SELECT *, {_REQ} AS requester0, {_REG} AS registration0, {_ORI} AS origin0, {_HOUR} AS hour0 FROM h2)
    SELECT document_id, page_number, t[1] AS issuer, t[2] AS laboratory, {_group('patient', S.PATIENT, 1)} AS patient_name, {_group('patient', S.PATIENT, 2)} AS sex, {_group('birth', S.BIRTH, 1)} AS birth_date, {_group('birth', S.BIRTH, 2)} AS reported_age,
        CASE WHEN at_requester >= 0 AND at_request > at_requester THEN {_run_on('requester0', 'at_requester', 'at_request')} ELSE requester0 END AS requester,
        CASE WHEN at_registry > at_requester THEN trim({_content('registry')}, ' ') ELSE registration0 END AS requester_registration, {_group('request', S.REQUEST, 1)} AS request_number, {_group('request', S.REQUEST, 2)} AS request_date,
        CASE WHEN at_hour > at_source THEN trim({_content('hour')}, ' ') ELSE hour0 END AS request_time, CASE WHEN at_source >= 0 AND n - 1 > at_source THEN {_run_on('origin0', 'at_source', 'n - 1')} ELSE origin0 END AS origin,
        {_group('collection', S.COLLECTION, 1)} AS collection_date, {_group('collection', S.COLLECTION, 2)} AS collection_time, array_to_string(ids, ',') AS source_line_ids,
        CASE WHEN n > 0 THEN array_to_string(list_transform(list_filter(range(n), lambda i: i >= 4 AND NOT ({_KNOWN.format('t[i + 1]')}) AND t[i + 1] <> '' AND NOT (at_requester >= 0 AND i > at_requester AND i < at_request) AND NOT (at_source >= 0 AND i > at_source AND i < n - 1)), lambda i: t[i + 1]), chr(10))
            ELSE {_s(S.NO_HEADER)} END AS unresolved_fragments FROM h3
"""
SQL = {
    "line_predicates": _PRED + "SELECT line_key, hist, method, calc, boundary, marker, fragment, balance, empty_label FROM p",
    "note_rules": _PRED + "SELECT line_key, rule, long FROM p WHERE rule IS NOT NULL",
    "page_bounds": _BOUNDS + "SELECT document_id, page_number, min(header_end) AS header_end, min(footer_start) AS footer_start, count(*) AS lines FROM b GROUP BY ALL",
    "line_states": _STATES + "SELECT line_key, class FROM s",
    "line_state_counts": _STATES + "SELECT disposition, class, count(*) AS lines FROM s GROUP BY ALL",
    "header_fields": _HEADER,
    "parenthesis_joins": """
        WITH a AS (SELECT *, len(regexp_extract_all(text, '\\(')) - len(regexp_extract_all(text, '\\)')) AS b FROM sanitized_line WHERE disposition = 'Active'),
        x AS (SELECT line_key, text, b, lead(b) OVER w AS nb, lead(text) OVER w AS nt, lead(line_key) OVER w AS next_key FROM a WINDOW w AS (PARTITION BY document_id, page_number ORDER BY source_index, line_id))
        SELECT line_key, next_key, text || ' ' || nt AS joined FROM x WHERE b > 0 AND nb < 0""",
    "sanitize_counters": "SELECT document_id, count(*) FILTER (disposition = 'Active') AS active_lines, count(*) FILTER (disposition <> 'Active') AS suppressed_lines FROM sanitized_line GROUP BY ALL",
}
