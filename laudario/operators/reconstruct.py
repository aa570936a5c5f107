"""Words with coordinates put together into lines and cells, page by page.

A page is bounded, so its words form the group of a grouped map where a step depends on what came
before (line clustering by a running median, attached superscripts, moved label parts). What doesn't is
left to windows and aggregates: tolerances, cells, texts, losses.
"""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.operators.bands import reorder_staggered

PAGE = ("document_id", "page_number")
LINES = "document_id string, page_number int, word_id string, idx int, line_no int, attached_to string, script string"


def tolerance(heights: list[float]) -> float:
    """A quarter of the median height, between 0.75 and 2.5; a page without heights counts as one of height 1."""
    hs = [h for h in heights if h > 0] or [1.0]
    return min(2.5, max(0.75, 0.25 * median(hs)))


class _Line:
    __slots__ = ("words", "baseline", "first")

    def __init__(self, word):
        self.words = [word]
        self.baseline = word["baseline"]
        self.first = word["idx"]

    def add(self, word):
        self.words.append(word)
        self.baseline = median(w["baseline"] for w in self.words)
        self.first = min(self.first, word["idx"])


def cluster(words: list[dict]) -> list[list[dict]]:
    """Lines of words: from the top, each word joins the nearest line within the tolerance, or opens one.

    A line's baseline is the median of its words' and moves with them; of equally near lines the one with
    the smallest word index wins.
    """
    tol = tolerance([w["top"] - w["bottom"] for w in words])
    lines: list[_Line] = []
    open_: list[_Line] = []
    for word in sorted(words, key=lambda w: (-w["baseline"], w["left"], w["idx"])):
        # Words come from the top and a line's median is never below the word at hand, so a line once out of reach stays so.
        open_ = [line for line in open_ if line.baseline - word["baseline"] <= tol]
        near = [(abs(line.baseline - word["baseline"]), line.first, line) for line in open_]
        if near:
            min(near, key=lambda x: x[:2])[2].add(word)
        else:
            lines.append(_Line(word))
            open_.append(lines[-1])
    out = [sorted(line.words, key=lambda w: (w["left"], w["idx"])) for line in lines]
    return out


def _box(line: list[dict]) -> tuple[float, float, float, float]:
    """Left, right, bottom and top of a line."""
    return min(w["left"] for w in line), max(w["right"] for w in line), min(w["bottom"] for w in line), max(w["top"] for w in line)


def _base(line: list[dict]) -> float:
    return median(w["baseline"] for w in line)


def attach_scripts(lines: list[list[dict]]) -> dict[str, tuple[str, str]]:
    """Lines of one or two digits that belong to a word beside them, as word id -> (base word id, kind); they leave their lines.

    The digit's height, overlap and gap are measured against the base word's whole line; the nearest
    word wins, then the greater overlap, then the nearer baseline.
    """
    found: dict[str, tuple[str, str]] = {}
    for line in [x for x in lines if len(x) == 1 and x[0]["text"].isascii() and x[0]["text"].isdigit() and len(x[0]["text"]) <= 2]:
        s = line[0]
        height = s["top"] - s["bottom"]
        best = None
        for other in lines if height > 0 else ():
            if other is line or not other:
                continue
            _, right, bottom, top = _box(other)
            tall = top - bottom
            overlap = max(0.0, min(s["top"], top) - max(s["bottom"], bottom))
            # only a line that the digit lies beside can hold its base
            if overlap / height < 0.4 or height / max(tall, 0.001) > 0.75:
                continue
            for b in other:
                gap = s["left"] - b["right"]
                apart = abs(s["baseline"] - b["baseline"])
                if -0.5 <= gap <= max(4, 0.75 * tall) and apart >= 1:
                    rank = (gap, -overlap, apart)
                    if best is None or rank < best[0]:
                        best = (rank, b, other)
        if best:
            _, b, other = best
            found[s["word_id"]] = (b["word_id"], "superscript" if s["baseline"] > b["baseline"] else "subscript")
            line.remove(s)
            other.append(s)
            other.sort(key=lambda w: (w["left"], w["idx"]))
    lines[:] = [x for x in lines if x]
    return found


def dotted_label(line: list[dict]) -> dict | None:
    """The first word that ends a field label with dots and a colon."""
    return next((w for w in line if w["text"].endswith(":") and "..." in w["text"]), None)


def order_wrapped(lines: list[list[dict]]) -> list[list[dict]]:
    """A label that runs on below its content: label part, content at its right, end of the label; the end moves up.

    Only the end has the dotted label; both parts share their left and right edges, the content is wholly
    right of them, and the three lie closely below each other.
    """
    lines, i = list(lines), 0
    while i + 2 < len(lines):
        a, b, c = lines[i : i + 3]
        (a_left, a_right, a_low, a_top), (b_left, _, b_low, b_top), (c_left, c_right, c_low, c_top) = _box(a), _box(b), _box(c)
        tall_a, tall_b, tall_c = a_top - a_low, b_top - b_low, c_top - c_low
        aside, down = max(2.0, 0.5 * max(tall_a, tall_c)), max(tall_a, tall_b, tall_c)
        first, second = _base(a) - _base(b), _base(b) - _base(c)
        fits = dotted_label(a) is None and dotted_label(c) is not None and abs(a_left - c_left) <= aside and abs(a_right - c_right) <= aside
        if fits and b_left > c_right + 2 and 0 < first <= down and 0 < second <= down:
            lines[i + 1], lines[i + 2] = c, b
            i += 3
        else:
            i += 1
    return lines


def close_bracket(lines: list[list[dict]]) -> list[list[dict]]:
    """A short line with an open bracket takes a line of one or two words up to three below that closes it; once a page."""
    lines = list(lines)
    for i, line in enumerate(lines):
        text = " ".join(w["text"] for w in line)
        if len(line) <= 5 and text.count("(") > text.count(")"):
            for j in range(i + 1, min(i + 4, len(lines))):
                other = " ".join(w["text"] for w in lines[j])
                if len(lines[j]) <= 2 and other.count(")") > other.count("("):
                    lines.insert(i + 1, lines.pop(j))
                    return lines
    return lines


def order_lines(lines: list[list[dict]]) -> list[list[dict]]:
    """Lines from the top and left, then labels and brackets moved to what they belong to."""
    lines = sorted(lines, key=lambda x: (-_base(x), _box(x)[0]))
    return close_bracket(order_wrapped(reorder_staggered(lines)))


def lines_of_words(words: DataFrame) -> DataFrame:
    """Every word with its line number on the page, and the word it is a script of, if any.

    Words without text or coordinates are on no line. Repeated words of one id stay repeated.
    """
    need = ["left_x", "bottom_y", "right_x", "top_y", "baseline_y", "text", "idx", "word_id"]
    sound = words.where(" AND ".join(f"{c} IS NOT NULL" for c in need) + " AND NOT isnan(left_x) AND NOT isnan(baseline_y)")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{"word_id": r.word_id, "idx": int(r.idx), "text": r.text, "left": r.left_x, "right": r.right_x, "bottom": r.bottom_y, "top": r.top_y, "baseline": r.baseline_y} for r in pdf.itertuples(index=False)]
        lines = cluster(rows)
        scripts = attach_scripts(lines)
        out = []
        for n, line in enumerate(order_lines(lines)):
            for w in line:
                base, kind = scripts.get(w["word_id"], (None, None))
                out.append((pdf["document_id"].iloc[0], int(pdf["page_number"].iloc[0]), w["word_id"], w["idx"], n, base, kind))
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in LINES.split(", ")])

    return sound.select(*PAGE, *need).groupBy(*PAGE).applyInPandas(run, LINES)


def page_tolerance(words: DataFrame) -> DataFrame:
    """Tolerance of each page by an exact median."""
    h = F.col("top_y") - F.col("bottom_y")
    m = F.median(F.when(h > 0, h))
    return words.groupBy(*PAGE).agg(F.least(F.lit(2.5), F.greatest(F.lit(0.75), F.coalesce(m, F.lit(1.0)) * 0.25)).alias("tolerance"), F.count("*").alias("words"))


def cells(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of lines: a new one where the gap exceeds 2 % of the page and 1.8 median heights of the line; with text and bounds."""
    w = W.partitionBy(*PAGE, "line_no").orderBy("left_x", "idx", "word_id")
    whole = W.partitionBy(*PAGE, "line_no")
    df = words.join(lines.select(*PAGE, "word_id", "line_no", "attached_to"), [*PAGE, "word_id"])
    height = F.median(F.when(F.col("top_y") > F.col("bottom_y"), F.col("top_y") - F.col("bottom_y"))).over(whole)
    df = df.withColumn("limit", F.greatest(F.coalesce(F.col("page_width") * 0.02, F.lit(0.0)), F.coalesce(height, F.lit(1.0)) * 1.8)).withColumn("far", F.lag("right_x").over(w))
    df = df.withColumn("cell_no", F.sum(F.when(F.col("left_x") - F.col("far") > F.col("limit"), 1).otherwise(0)).over(w)).withColumn("piece", F.concat(F.when(F.col("attached_to").isNotNull(), "").otherwise(" "), F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("left_x", "idx", "word_id", "piece"))), lambda x: x["piece"])
    return df.groupBy(*PAGE, "line_no", "cell_no").agg(F.trim(F.array_join(parts, "")).alias("text"), F.count("*").alias("words"), F.min("left_x").alias("left"), F.min("bottom_y").alias("bottom"), F.max("right_x").alias("right"), F.max("top_y").alias("top"))


def line_texts(cell_table: DataFrame) -> DataFrame:
    """Lines with their text, and the text that shows cells apart."""
    by = F.array_sort(F.collect_list(F.struct("cell_no", "text")))
    return cell_table.groupBy(*PAGE, "line_no").agg(
        F.array_join(F.transform(by, lambda x: x["text"]), " ").alias("text"), F.array_join(F.transform(by, lambda x: x["text"]), " | ").alias("display_text"), F.count("*").alias("cells"), F.sum("words").alias("words"),
        F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"),
    )


def losses(words: DataFrame, lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Words on no line and glyphs of no word, by document; anti-joins on their ids."""
    lost = words.join(lines.select(*PAGE, "word_id"), [*PAGE, "word_id"], "left_anti").groupBy("document_id").agg(F.count("*").alias("unresolved_words"))
    used = words.select(*PAGE, F.explode("glyph_ids").alias("glyph_id"))
    free = glyphs.join(used, [*PAGE, "glyph_id"], "left_anti").groupBy("document_id").agg(F.count("*").alias("unassigned_glyphs"))
    return words.select("document_id").distinct().join(lost, "document_id", "left").join(free, "document_id", "left").na.fill(0)


def glyph_links(words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Words whose listed glyphs exist, glyph by glyph, with the first glyph of equal text and place."""
    key = lambda: [F.bround(c, 4).alias(c) for c in ("left_x", "bottom_y", "right_x", "top_y")]
    first = glyphs.select(*PAGE, "text", *key(), "idx", "glyph_id").groupBy(*PAGE, "text", "left_x", "bottom_y", "right_x", "top_y").agg(F.min(F.struct("idx", "glyph_id")).alias("g"))
    listed = words.select(*PAGE, "word_id", F.posexplode("glyph_ids").alias("n", "glyph_id"))
    own = glyphs.select(*PAGE, "glyph_id", "text", *key())
    return listed.join(own, [*PAGE, "glyph_id"]).join(first, [*PAGE, "text", "left_x", "bottom_y", "right_x", "top_y"]).select(*PAGE, "word_id", "n", "glyph_id", F.col("g.glyph_id").alias("first_glyph_id"))
