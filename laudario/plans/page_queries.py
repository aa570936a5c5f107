"""Lines, cells and losses of captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from laudario.operators import bands as B
from laudario.operators import notices as N
from laudario.operators import reconstruct as R
from laudario.operators import sanitize as S
from laudario.sources.tables import table


def _w(spark, folder):
    return table(spark, folder, "capture_word")


def page_tolerance(spark, folder):
    return R.page_tolerance(_w(spark, folder)).select(*R.PAGE, F.round("tolerance", 6).alias("tolerance"), "words")


def line_clustering(spark, folder):
    return R.lines_of_words(_w(spark, folder))


def page_cells(spark, folder):
    return R.cells(_w(spark, folder), R.lines_of_words(_w(spark, folder)))


def page_lines(spark, folder):
    return R.line_texts(page_cells(spark, folder))


def cell_split(spark, folder):
    """Cells where words of one baseline are a line: the windowed part alone."""
    words = _w(spark, folder)
    flat = words.select(*R.PAGE, "word_id", F.dense_rank().over(R.W.partitionBy(*R.PAGE).orderBy(F.bround("baseline_y", 4).desc())).alias("line_no"), F.lit(None).cast("string").alias("attached_to"))
    return R.cells(words, flat).select(*R.PAGE, "line_no", "cell_no", "text", "words", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))


def page_losses(spark, folder):
    words = _w(spark, folder)
    return R.losses(words, R.lines_of_words(words), table(spark, folder, "capture_glyph"))


def glyph_links(spark, folder):
    return R.glyph_links(_w(spark, folder), table(spark, folder, "capture_glyph"))


def reference_bands(spark, folder):
    """Lines of the captured pages without what their reference column holds."""
    widths = _w(spark, folder).groupBy(*R.PAGE).agg(F.max("page_width").alias("page_width"))
    return B.reference_bands(page_cells(spark, folder), widths).select("document_id", "page_number", "line_no", "text", "disposition", F.size("suppressed").alias("suppressed"))


def _sanitized(spark, folder):
    cells = page_cells(spark, folder)
    lines = R.line_texts(cells).withColumn("source_index", F.col("line_no")).withColumn("line_id", F.format_string("p%04d-l%04d", "page_number", "line_no"))
    widths = _w(spark, folder).groupBy(*R.PAGE).agg(F.max("page_width").alias("page_width"))
    return B.sanitized_pages(S.classify(lines, "display_text"), cells, widths)


def sanitized_pages(spark, folder):
    """Lines of the captured pages through reconstruction and the whole classification."""
    return _sanitized(spark, folder).select("document_id", "page_number", "line_no", "text", "disposition", F.array_join("rules", " ").alias("rules"), F.size("suppressed").alias("suppressed"))


def sanitized_page_words(spark, folder):
    """By page: words that the reconstructed lines hold; each word with text and place is on one line."""
    return page_lines(spark, folder).groupBy(*R.PAGE).agg(F.sum("words").alias("words"))


def page_notices(spark, folder):
    """Notices of reconstruction and line classification, counted."""
    words = _w(spark, folder)
    made = N.reconstruction_notices(words, R.lines_of_words(words)).unionByName(N.sanitization_notices(table(spark, folder, "sanitized_header"), table(spark, folder, "sanitized_line")))
    return made.groupBy("document_id", "severity", "code").agg(F.count("*").alias("pages"))


def document_counters(spark, folder):
    words = _w(spark, folder)
    lines = R.lines_of_words(words)
    return N.document_counters(words, lines, R.cells(words, lines), R.losses(words, lines, table(spark, folder, "capture_glyph")))


QUERIES = {f.__name__: f for f in (page_tolerance, line_clustering, page_cells, page_lines, cell_split, page_losses, glyph_links, reference_bands, sanitized_pages, sanitized_page_words, page_notices, document_counters)}
_P = "document_id, page_number"
SQL = {
    "sanitized_page_words": f"SELECT {_P}, count(*) AS words FROM capture_word WHERE NOT (left_x IS NULL OR bottom_y IS NULL OR right_x IS NULL OR top_y IS NULL OR baseline_y IS NULL OR text IS NULL OR idx IS NULL OR word_id IS NULL OR isnan(left_x) OR isnan(baseline_y)) GROUP BY ALL",
    "page_notices": f"""
        WITH w AS (SELECT {_P}, word_id, left_x IS NULL OR bottom_y IS NULL OR right_x IS NULL OR top_y IS NULL OR baseline_y IS NULL OR text IS NULL OR isnan(left_x) OR isnan(baseline_y) AS lost FROM capture_word),
        g AS (SELECT {_P}, bool_and(lost) AS all_lost, bool_or(lost) AS any_lost FROM w GROUP BY ALL),
        n AS (SELECT {_P}, 'Warning' AS severity, 'PageWithoutLines' AS code FROM g WHERE all_lost UNION ALL SELECT {_P}, 'Error', 'UnresolvedWords' FROM g WHERE any_lost
            UNION ALL SELECT {_P}, 'Warning', 'HeaderIncomplete' FROM sanitized_header WHERE coalesce(trim(patient_name, ' '), '') = '' OR coalesce(trim(birth_date, ' '), '') = '' OR coalesce(trim(request_number, ' '), '') = '' OR coalesce(trim(request_date, ' '), '') = '' OR coalesce(trim(request_time, ' '), '') = ''
            UNION ALL SELECT {_P}, 'Warning', 'UnresolvedFragments' FROM sanitized_header WHERE len(unresolved_fragments) > 0
            UNION ALL SELECT {_P}, 'Warning', 'FooterUnrecognized' FROM sanitized_line GROUP BY {_P} HAVING count(*) FILTER (disposition = 'Footer') = 0)
        SELECT document_id, severity, code, count(*) AS pages FROM n GROUP BY ALL""",
    "page_tolerance": f"SELECT {_P}, round(least(2.5, greatest(0.75, 0.25 * coalesce(median(CASE WHEN top_y > bottom_y THEN top_y - bottom_y END), 1.0))), 6) AS tolerance, count(*) AS words FROM capture_word GROUP BY ALL",
    "cell_split": f"""
        WITH l AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY {_P} ORDER BY round_even(baseline_y, 4) DESC) AS INTEGER) AS line_no FROM capture_word),
        h AS (SELECT {_P}, line_no, 1.8 * coalesce(median(CASE WHEN top_y > bottom_y THEN top_y - bottom_y END), 1.0) AS hm FROM l GROUP BY ALL),
        f AS (SELECT l.*, greatest(coalesce(page_width * 0.02, 0), hm) AS lim, lag(right_x) OVER (PARTITION BY {_P}, line_no ORDER BY left_x, idx, word_id) AS far FROM l JOIN h USING ({_P}, line_no)),
        c AS (SELECT *, sum(CASE WHEN left_x - far > lim THEN 1 ELSE 0 END) OVER (PARTITION BY {_P}, line_no ORDER BY left_x, idx, word_id ROWS UNBOUNDED PRECEDING) AS cell_no FROM f)
        SELECT {_P}, line_no, CAST(cell_no AS BIGINT) AS cell_no, trim(string_agg(' ' || text, '' ORDER BY left_x, idx, word_id), ' ') AS text, count(*) AS words, round(min(left_x), 4) AS left, round(max(right_x), 4) AS right FROM c GROUP BY ALL""",
    "page_losses": f"""
        WITH lost AS (SELECT document_id, count(*) AS n FROM capture_word WHERE left_x IS NULL OR bottom_y IS NULL OR right_x IS NULL OR top_y IS NULL OR baseline_y IS NULL OR text IS NULL OR isnan(left_x) OR isnan(baseline_y) GROUP BY ALL),
        used AS (SELECT DISTINCT {_P}, unnest(glyph_ids) AS glyph_id FROM capture_word), free AS (SELECT document_id, count(*) AS n FROM capture_glyph g WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.document_id = g.document_id AND u.page_number = g.page_number AND u.glyph_id = g.glyph_id) GROUP BY ALL)
        SELECT document_id, coalesce(lost.n, 0) AS unresolved_words, coalesce(free.n, 0) AS unassigned_glyphs FROM (SELECT DISTINCT document_id FROM capture_word) LEFT JOIN lost USING (document_id) LEFT JOIN free USING (document_id)""",
    "glyph_links": f"""
        WITH k AS (SELECT {_P}, text, round_even(left_x, 4) AS a, round_even(bottom_y, 4) AS b, round_even(right_x, 4) AS c, round_even(top_y, 4) AS d, idx, glyph_id FROM capture_glyph),
        f AS (SELECT {_P}, text, a, b, c, d, first(glyph_id ORDER BY idx, glyph_id) AS first_glyph_id FROM k GROUP BY ALL),
        l AS (SELECT {_P}, word_id, unnest(glyph_ids) AS glyph_id, unnest(range(len(glyph_ids))) AS n FROM capture_word)
        SELECT l.document_id, l.page_number, word_id, CAST(n AS INTEGER) AS n, l.glyph_id, first_glyph_id FROM l JOIN k ON l.document_id = k.document_id AND l.page_number = k.page_number AND l.glyph_id = k.glyph_id
        JOIN f ON f.document_id = k.document_id AND f.page_number = k.page_number AND f.text = k.text AND f.a = k.a AND f.b = k.b AND f.c = k.c AND f.d = k.d""",
}
