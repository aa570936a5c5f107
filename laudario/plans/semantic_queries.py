"""Typed content of the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.operators import semantic as S
from laudario.sources.tables import table


def _owned(spark, folder):
    return S.continued(S.anchored(table(spark, folder, "sanitized_line"), table(spark, folder, "laboratory_concept")))


def catalog_aliases(spark, folder):
    return S.aliases(table(spark, folder, "laboratory_concept"))


def anchor_segmentation(spark, folder):
    return _owned(spark, folder).select("line_key", "opens", "anchor_key", "concept_id", "reason")


def line_routes(spark, folder):
    return S.routed(_owned(spark, folder)).groupBy("concept_id", "route").agg(F.count("*").alias("lines"))


def exam_observations(spark, folder):
    return S.observations(S.routed(_owned(spark, folder))).select("anchor_key", "concept_id", "line_key", "ordinal", "label", "raw_value", "raw_unit", "coded_value", F.col("numeric_value").cast("double").alias("numeric_value"))


def exam_records(spark, folder):
    return S.records(S.routed(_owned(spark, folder)), table(spark, folder, "sanitized_line"), table(spark, folder, "laboratory_concept"))


def exam_evidence(spark, folder):
    return S.evidence(_owned(spark, folder), table(spark, folder, "sanitized_line"))


def semantic_coverage(spark, folder):
    return S.coverage(_owned(spark, folder))


QUERIES = {f.__name__: f for f in (catalog_aliases, anchor_segmentation, line_routes, exam_observations, exam_records, exam_evidence, semantic_coverage)}

_SEG = T.sql_result_segment("text")
_KEYS = f"""
    WITH RECURSIVE keys AS (SELECT DISTINCT {T.sql_normalize_label('n')} AS key, concept_id, structural_form_id FROM (SELECT concept_id, structural_form_id, unnest(list_append(coalesce(observed_aliases, []), display_name)) AS n FROM laboratory_concept) WHERE n IS NOT NULL)
"""
_OWNED = _KEYS + f"""
    , a AS (SELECT document_id, page_number, line_id, line_key, source_index, text, {T.sql_normalize_label(T.sql_literal_label('text'))} AS label_key FROM sanitized_line WHERE disposition = 'Active'),
    h AS (SELECT a.*, keys.concept_id AS own_concept, keys.structural_form_id AS own_form FROM a LEFT JOIN keys ON label_key = key),
    l AS (SELECT *, count(CASE WHEN label_key = 'MATERIAL' THEN 1 END) OVER (PARTITION BY document_id, page_number ORDER BY source_index, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS material FROM h),
    parts AS (SELECT DISTINCT concept_id, {T.sql_normalize_label('p')} AS part FROM (SELECT concept_id, unnest(observed_components) AS p FROM laboratory_concept)),
    hits AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY source_index, line_id) AS k, regexp_matches(text, '(?s)^[^:]*:.*\\S') AS result FROM l WHERE own_concept IS NOT NULL),
    f AS (SELECT document_id, page_number, k, line_key, TRUE AS opens, own_concept AS cur, own_form AS cur_form, material AS cur_material, result AS cur_result FROM hits WHERE k = 1
        UNION ALL SELECT document_id, page_number, k, line_key, takes, CASE WHEN takes THEN own_concept ELSE cur END, CASE WHEN takes THEN own_form ELSE cur_form END, CASE WHEN takes THEN material ELSE cur_material END, CASE WHEN takes THEN result ELSE cur_result END
        FROM (SELECT hits.document_id, hits.page_number, hits.k, hits.line_key, own_concept, own_form, material, result, cur, cur_form, cur_material, cur_result,
            NOT (EXISTS (SELECT 1 FROM parts WHERE parts.concept_id = cur AND part = label_key) OR cur_form = '{S.CULTURE}' AND label_key = 'CULTURAL' OR cur = own_concept AND material = cur_material AND NOT cur_result) AS takes
            FROM f JOIN hits ON hits.document_id = f.document_id AND hits.page_number = f.page_number AND hits.k = f.k + 1)),
    o AS (SELECT l.*, coalesce(f.opens, FALSE) AS opens FROM l LEFT JOIN (SELECT line_key, opens FROM f) AS f USING (line_key)),
    n AS (SELECT *, last_value(CASE WHEN opens THEN line_key END IGNORE NULLS) OVER u AS anchor0, last_value(CASE WHEN opens THEN own_concept END IGNORE NULLS) OVER u AS concept0, last_value(CASE WHEN opens THEN own_form END IGNORE NULLS) OVER u AS form0 FROM o
        WINDOW u AS (PARTITION BY document_id, page_number ORDER BY source_index, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    pg AS (SELECT document_id, page_number, last(anchor0 ORDER BY source_index, line_id) AS ta, last(concept0 ORDER BY source_index, line_id) AS tc, last(form0 ORDER BY source_index, line_id) AS tf, first(label_key ORDER BY source_index, line_id) AS fl, bool_or(opens) AS any_anchor FROM n GROUP BY ALL),
    pv AS (SELECT *, lag(ta) OVER w AS pa, lag(tc) OVER w AS pc, lag(tf) OVER w AS pf, lag(page_number) OVER w AS pp FROM pg WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
    cr AS (SELECT document_id, page_number, any_anchor, pa IS NOT NULL AND pp = page_number - 1 AND (pf = '{S.PANEL}' OR fl = 'MATERIAL') AS can, pa, pc FROM pv),
    own AS (SELECT document_id, page_number, line_id, line_key, source_index, text, label_key, opens, coalesce(anchor0, CASE WHEN can THEN pa END) AS anchor_key, coalesce(concept0, CASE WHEN can THEN pc END) AS concept_id, any_anchor FROM n JOIN cr USING (document_id, page_number)),
    owned AS (SELECT *, CASE WHEN anchor_key IS NULL THEN CASE WHEN any_anchor THEN 'PrefixWithoutSafeContext' ELSE 'NoKnownAnchor' END END AS reason FROM own),
    routed AS (SELECT *, {_SEG} AS seg, CASE WHEN label_key IN ('MATERIAL', 'AMOSTRA') AND NOT (label_key = 'AMOSTRA' AND coalesce(concept_id = 'lab.tempo-tromboplastina', FALSE)) THEN 'Specimen' WHEN regexp_matches({_SEG}, '\\d') THEN 'Numeric'
        WHEN contains(text, ':') AND length(trim({_SEG}, ' ')) > 0 THEN 'Coded' WHEN opens OR contains(text, ':') THEN 'Title' ELSE 'Narrative' END AS route FROM owned)
"""
_NUM = T.NUMERIC.replace("'", "''")
SQL = {
    "catalog_aliases": _KEYS + "SELECT * FROM keys",
    "anchor_segmentation": _OWNED + "SELECT line_key, opens, anchor_key, concept_id, reason FROM owned",
    "line_routes": _OWNED + "SELECT concept_id, route, count(*) AS lines FROM routed GROUP BY ALL",
    "exam_observations": _OWNED + f"""
        , v AS (SELECT *, regexp_extract_all(seg, '(?i){_NUM}', 1) AS vs, regexp_extract_all(seg, '(?i){_NUM}', 2) AS us FROM routed WHERE route = 'Numeric' AND anchor_key IS NOT NULL),
        e AS (SELECT *, unnest(range(len(vs))) AS k FROM v),
        b AS (SELECT anchor_key, concept_id, line_key, line_id, page_number, source_index, {T.sql_literal_label('text')} AS label, k, vs[k + 1] AS raw_value, nullif(us[k + 1], '') AS raw_unit, CAST(NULL AS VARCHAR) AS coded_value FROM e
            UNION ALL SELECT anchor_key, concept_id, line_key, line_id, page_number, source_index, {T.sql_literal_label('text')}, 0, trim(seg, ' '), CAST(NULL AS VARCHAR), trim(seg, ' ') FROM routed WHERE route = 'Coded' AND anchor_key IS NOT NULL)
        SELECT anchor_key, concept_id, line_key, CAST(row_number() OVER (PARTITION BY anchor_key ORDER BY page_number, source_index, line_id, k) - 1 AS INTEGER) AS ordinal, label, raw_value, raw_unit, coded_value,
        CASE WHEN coded_value IS NULL THEN CAST({T.sql_parse_decimal('raw_value')} AS DOUBLE) END AS numeric_value FROM b""",
    "exam_records": _OWNED + f"""
        , j AS (SELECT r.*, s.applied_rule_ids, coalesce(len(s.source_word_ids), 0) AS nw FROM routed r JOIN sanitized_line s USING (line_key) WHERE anchor_key IS NOT NULL),
        g AS (SELECT anchor_key, concept_id, count(*) AS lines, CAST(sum(nw) AS BIGINT) AS words, count(*) FILTER (route = 'Specimen') AS specimens, count(*) FILTER (route = 'Narrative' AND line_key <> anchor_key) AS narratives, flatten(list(coalesce(applied_rule_ids, []))) AS own FROM j GROUP BY ALL)
        SELECT anchor_key, concept_id, CASE WHEN narratives > 0 THEN 'StructuredWithResidual' ELSE 'FullyStructured' END AS status,
        array_to_string(list_sort(list_distinct(list_filter(list_concat(['{S.SEGMENTATION_RULE}', extraction_strategy_id], own), lambda x: x IS NOT NULL))), ' ') AS rules, lines, words, specimens, narratives FROM g LEFT JOIN laboratory_concept USING (concept_id)""",
    "exam_evidence": _OWNED + """
        SELECT anchor_key, line_key, CAST(row_number() OVER (PARTITION BY anchor_key ORDER BY o.page_number, o.source_index, o.line_id) - 1 AS INTEGER) AS position, o.document_id, o.page_number, o.line_id, array_to_string(s.source_word_ids, ',') AS words, coalesce(len(s.suppressed_segments), 0) AS suppressed
        FROM owned o JOIN sanitized_line s USING (line_key) WHERE anchor_key IS NOT NULL""",
    "semantic_coverage": _OWNED + "SELECT document_id, page_number, count(*) AS lines, count(anchor_key) AS owned, count(reason) AS unsupported, count(DISTINCT anchor_key) AS exams, count(*) - count(DISTINCT line_key) AS multiply_owned, count(anchor_key) + count(reason) = count(*) AND count(*) = count(DISTINCT line_key) AS lossless FROM owned GROUP BY ROLLUP (document_id, page_number)",
}
