"""Derived measurements and time series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from laudario.operators import curves as C
from laudario.operators import derived as D
from laudario.sources.tables import table

TODAY = date(2025, 6, 30)


def _assessed(spark, folder):
    return D.assess(D.with_candidates(table(spark, folder, "derived_input")))


def egfr_values(spark, folder):
    return _assessed(spark, folder).select("derived_observation_id", "status", "reason", F.round("value", 6).alias("value"))


def egfr_coverage(spark, folder):
    return D.coverage(_assessed(spark, folder))


def egfr_truncated(spark, folder):
    """Computed values as curves show them: cut to one decimal."""
    return _assessed(spark, folder).where("reason IS NULL").select("derived_observation_id", F.floor(F.col("value") * 10).cast("bigint").alias("tenths"))


def _o(spark, folder):
    return table(spark, folder, "lab_observation")


def curve_points(spark, folder):
    return C.points(_o(spark, folder)).select("patient_key", "series_key", "ts", "episode_key", "observation_id", F.col("value").cast("double").alias("value"))


def curve_delta(spark, folder):
    return C.sequence(C.points(_o(spark, folder))).select("patient_key", "series_key", "observation_id", "n", "repeated_day", F.round(F.col("delta").cast("double"), 6).alias("delta"))


def curve_last_days(spark, folder):
    return C.points(_o(spark, folder), C.DateFilter(days=365, today=TODAY)).groupBy("series_key").agg(F.count("*").alias("points"), F.count_distinct("patient_key").alias("patients"))


def curve_range(spark, folder):
    return C.points(_o(spark, folder), C.DateFilter(date(2024, 1, 1), date(2024, 12, 31)), ["creatinine", "sodium"]).select("patient_key", "series_key", "observation_id", F.col("value").cast("double").alias("value"))


def curve_options(spark, folder):
    """Series that have points, by patient."""
    return C.points(_o(spark, folder)).select("patient_key", "series_key").distinct()


def curve_include_year(spark, folder):
    return C.points(_o(spark, folder)).groupBy("patient_key").agg((F.min(F.year("ts")) != F.max(F.year("ts"))).alias("with_year"))


def curve_rates(spark, folder):
    """Filtration rates of each patient over time."""
    return C.rate_points(_assessed(spark, folder)).select("patient_key", "day", "episode_key", F.col("value").cast("double").alias("value"), F.col("delta").cast("double").alias("delta"))


def curve_text(spark, folder):
    """The text of every point of every series."""
    return C.texts(C.all_series(_o(spark, folder), _assessed(spark, folder)))


QUERIES = {f.__name__: f for f in (egfr_values, egfr_coverage, egfr_truncated, curve_points, curve_delta, curve_last_days, curve_range, curve_options, curve_include_year, curve_rates, curve_text)}

_R = D.REASONS
_BLANK = "coalesce(trim({0}, ' '), '') = ''"
_ASSESSED = f"""
    WITH n AS (SELECT derived_observation_id, count(DISTINCT source_observation_id) AS candidates FROM derived_input GROUP BY ALL),
    i AS (SELECT *, CAST(numeric_creatinine_value AS DOUBLE) AS v, lower(trim(raw_sex, ' ')) AS sx FROM derived_input JOIN n USING (derived_observation_id)),
    a AS (SELECT *, CASE WHEN episode_key IS NULL OR patient_key IS NULL THEN '{_R[0]}' WHEN age_at_request_years IS NULL THEN '{_R[1]}' WHEN age_at_request_years < 18 THEN '{_R[2]}'
        WHEN {_BLANK.format('raw_sex')} THEN '{_R[3]}' WHEN sx NOT IN ('feminino', 'masculino') THEN '{_R[4]}' WHEN coalesce(upper(trim(raw_specimen, ' ')), '') <> 'SORO' THEN '{_R[5]}'
        WHEN source_observation_id IS NULL THEN '{_R[6]}' WHEN candidates > 1 THEN '{_R[7]}' WHEN v IS NULL THEN '{_R[8]}' WHEN v <= 0 THEN '{_R[9]}'
        WHEN {_BLANK.format('raw_creatinine_unit')} THEN '{_R[10]}' WHEN lower(trim(raw_creatinine_unit, ' ')) <> 'mg/dl' THEN '{_R[11]}' END AS reason,
        v / CASE WHEN sx = 'feminino' THEN 0.7 ELSE 0.9 END AS ratio FROM i),
    e AS (SELECT derived_observation_id, reason, CASE WHEN reason IS NULL THEN 142 * pow(least(ratio, 1.0), CASE WHEN sx = 'feminino' THEN -0.241 ELSE -0.302 END) * pow(greatest(ratio, 1.0), -1.2)
        * pow(0.9938, age_at_request_years) * CASE WHEN sx = 'feminino' THEN 1.012 ELSE 1.0 END END AS value FROM a)
"""
_RATES = _ASSESSED + r"""
    , d AS (SELECT DISTINCT derived_observation_id, a.patient_key, a.episode_key, CASE WHEN regexp_matches(raw_request_date, '^\d{2}/\d{2}/\d{4}$') THEN CAST(try_strptime(raw_request_date, '%d/%m/%Y') AS DATE) END AS day,
        floor(CAST(e.value AS DECIMAL(20,10)) * 10) / 10 AS value FROM e JOIN a USING (derived_observation_id) WHERE e.reason IS NULL),
    o AS (SELECT patient_key, episode_key, any_value(day) AS day, any_value(value) AS value FROM d GROUP BY ALL HAVING count(*) = 1)
    SELECT patient_key, day, episode_key, CAST(value AS DOUBLE) AS value, round(CAST(value - lag(value) OVER (PARTITION BY patient_key ORDER BY day, episode_key) AS DOUBLE), 1) AS delta FROM o WHERE day IS NOT NULL"""
_DEF = "(VALUES " + ", ".join(f"('{k}', '{c}', '{u}', '{label}', {o})" for k, label, c, u, o in C.SERIES) + ") AS d(series_key, concept_id, unit, series_label, place)"
_UNIT = "translate(upper(replace(trim({0}, ' '), ' ', '')), '³²', '32')"


def _points(where: str = "TRUE") -> str:
    return f"""
    WITH h AS (SELECT o.*, d.series_key, d.unit, d.series_label, d.place FROM lab_observation o JOIN {_DEF} USING (concept_id)
        WHERE NOT regexp_matches(ltrim(raw_value, ' '), '^[<>]') AND numeric_value IS NOT NULL AND requested_at IS NOT NULL AND ({where})
        AND {_UNIT.format('coalesce(normalized_unit, raw_unit)')} = {_UNIT.format('unit')}),
    once AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY patient_key, series_key, observation_id ORDER BY received_at, requested_at, episode_key, occurrence_id, numeric_value) = 1),
    p AS (SELECT patient_key, series_key, requested_at AS ts, episode_key, observation_id, numeric_value AS value, unit, series_label, place FROM once QUALIFY count(*) OVER (PARTITION BY patient_key, series_key, occurrence_id) = 1)
    """


SQL = {
    "egfr_values": _ASSESSED + "SELECT derived_observation_id, CASE WHEN reason IS NULL THEN 'Computed' ELSE 'NotComputed' END AS status, reason, round(value, 6) AS value FROM e",
    "egfr_coverage": _ASSESSED + f"""
        SELECT r AS reason, count(e.derived_observation_id) AS n FROM (SELECT unnest(['Computed', {', '.join(f"'{r}'" for r in _R)}]) AS r) LEFT JOIN e ON coalesce(e.reason, 'Computed') = r GROUP BY ALL""",
    "curve_rates": _RATES,
    "egfr_truncated": _ASSESSED + "SELECT derived_observation_id, CAST(floor(value * 10) AS BIGINT) AS tenths FROM e WHERE reason IS NULL",
    "curve_points": _points() + "SELECT patient_key, series_key, ts, episode_key, observation_id, CAST(value AS DOUBLE) AS value FROM p",
    "curve_delta": _points() + """SELECT patient_key, series_key, observation_id, CAST(row_number() OVER w AS INTEGER) AS n, count(*) OVER (PARTITION BY patient_key, series_key, CAST(ts AS DATE)) > 1 AS repeated_day,
        round(CAST(value - lag(value) OVER w AS DOUBLE), 6) AS delta FROM p WINDOW w AS (PARTITION BY patient_key, series_key ORDER BY ts, episode_key, observation_id)""",
    "curve_last_days": _points(f"CAST(requested_at AS DATE) BETWEEN DATE '{TODAY}' - 364 AND DATE '{TODAY}'") + "SELECT series_key, count(*) AS points, count(DISTINCT patient_key) AS patients FROM p GROUP BY ALL",
    "curve_range": _points("CAST(requested_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND series_key IN ('creatinine', 'sodium')") + "SELECT patient_key, series_key, observation_id, CAST(value AS DOUBLE) AS value FROM p",
    "curve_options": _points() + "SELECT DISTINCT patient_key, series_key FROM p",
    "curve_text": _points() + f"""
        , e0 AS ({_RATES}),
        every AS (SELECT patient_key, series_key, ts, episode_key, observation_id, value, unit, series_label, place, {C.sql_shown('value')} AS body FROM p
            UNION ALL SELECT patient_key, '{C.BILIRUBINS[0]}', ts, episode_key, min(observation_id), NULL, '{C.BILIRUBINS[2]}', '{C.BILIRUBINS[1]}', {C.BILIRUBINS[3]}, '(' || string_agg(series_label || ' ' || {C.sql_shown('value')}, ' | ' ORDER BY place, series_label || ' ' || {C.sql_shown('value')}) || ')' FROM p WHERE starts_with(series_key, 'bilirubin-') GROUP BY patient_key, episode_key, ts
            UNION ALL SELECT patient_key, '{C.RATE[0]}', CAST(day AS TIMESTAMP), episode_key, '', CAST(value AS DECIMAL(28,10)), '{C.RATE[2]}', '{C.RATE[1]}', {C.RATE[3]}, replace(format('{{:.1f}}', value), '.', ',') FROM e0),
        y AS (SELECT patient_key, min(year(ts)) <> max(year(ts)) AS with_year FROM every GROUP BY ALL),
        q AS (SELECT every.*, with_year, CAST(row_number() OVER w AS INTEGER) AS n, lag(value) OVER w AS before, count(*) OVER (PARTITION BY patient_key, series_key, CAST(ts AS DATE)) > 1 AS rep FROM every JOIN y USING (patient_key) WINDOW w AS (PARTITION BY patient_key, series_key ORDER BY ts, episode_key, observation_id)),
        d AS (SELECT *, value - before AS delta, greatest(length(regexp_extract({C.sql_shown('value')}, ',(\\d+)$', 1)), length(regexp_extract({C.sql_shown('before')}, ',(\\d+)$', 1))) AS most FROM q)
        SELECT patient_key, place, series_key, n, '#' || series_label || ' (' || unit || '):' AS heading, strftime(ts, '%d/%m') || CASE WHEN with_year THEN strftime(ts, '/%y') ELSE '' END || CASE WHEN rep THEN strftime(ts, ' %H:%M') ELSE '' END || ' - ' || body
            || CASE WHEN delta IS NULL THEN '' WHEN delta = 0 THEN ' (±0)' ELSE ' (' || CASE WHEN delta > 0 THEN '+' ELSE '' END || CASE WHEN series_key = '{C.RATE[0]}' THEN replace(format('{{:.1f}}', CAST(round(delta, 1) AS DOUBLE)), '.', ',')
                WHEN most = 0 THEN {C.sql_shown('round(delta, 0)')} WHEN most = 1 THEN {C.sql_shown('round(delta, 1)')} ELSE {C.sql_shown('delta')} END || ')' END AS piece FROM d""",
    "curve_include_year": _points() + "SELECT patient_key, min(year(ts)) <> max(year(ts)) AS with_year FROM p GROUP BY ALL",
}
