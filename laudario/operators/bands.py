"""The reference column of a page: cells at its right are no results, wherever it begins and until it ends.

Where the column stands is known only from the lines above, so the cells of a page are walked in a
grouped map; a page is bounded.
"""

from __future__ import annotations

import re
import unicodedata
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laudario.functions import text as T

PAGE = ("document_id", "page_number")
SLACK = 2.0  # a cell this far left of the column still belongs to it
MARKER = re.compile(r"\bValor(?:es)?\s+de\s+Refer[eê]ncia\s*:?", re.I)
OUT = "document_id string, page_number int, line_no int, text string, disposition string, suppressed array<string>"


def _letters(text: str) -> str:
    return "".join(c for c in text if c.isalpha())


def capital_label(text: str) -> bool:
    """A field label in capitals before a colon."""
    head, colon, _ = text.partition(":")
    letters = _letters(head)
    return bool(colon) and 2 <= len(head) <= 90 and head[0].isalpha() and len(letters) >= 2 and letters.isupper()


def section_title(text: str) -> bool:
    letters = _letters(text)
    return 0 < len(text) <= 100 and ":" not in text and len(letters) >= 4 and letters.isupper()


def empty_observation(text: str) -> bool:
    key = "".join(c for c in unicodedata.normalize("NFD", text.upper()) if unicodedata.category(c) != "Mn").replace(".", "").strip()
    return key in ("OBSERVACAO:", "OBSERVACOES:")


def join_parts(parts: list[str]) -> str:
    """Parts with bars between them, but none after a colon."""
    return re.sub(r":\s*\|\s*", ": ", " | ".join(p for p in parts if p))


class Column:
    """Left edge of the reference column, if there is one."""

    def __init__(self, width: float):
        self.width = width
        self.left: float | None = None

    def holds(self, left: float) -> bool:
        return self.left is not None and left >= self.left - SLACK

    def end_before(self, text: str, left: float) -> None:
        """A title left of the column ends it; so does a capital label while the column lies in the left half."""
        if self.left is None:
            return
        if section_title(text) and left < self.left - SLACK or capital_label(text) and self.left < self.width / 2:
            self.left = None

    def take(self, text: str, left: float) -> tuple[str, str]:
        """(kept, suppressed) parts of a cell; a marker or an empty label in the right half opens the column."""
        if empty_observation(text) and left >= self.width / 2:
            self.left = left
            return "", text
        if found := MARKER.search(text):
            self.left = left
            return text[: found.start()].rstrip(" |"), text[found.start() :].strip()
        return ("", text) if self.holds(left) else (text, "")


def walk(lines: list[list[tuple[str, float]]], width: float) -> list[tuple[str, str, list[str]]]:
    """(text, disposition, suppressed) of each line of (cell text, left edge), from the top."""
    column, out = Column(width), []
    for cells in lines:
        whole = " ".join(t for t, _ in cells).strip()
        first = min((x for _, x in cells), default=0.0)
        if whole.lower().startswith("material"):
            # material is always kept; what stands in the column beside it is not
            parts = [(t, "") if t.lower().startswith("material") or not column.holds(x) else ("", t) for t, x in cells]
        else:
            column.end_before(whole, first)
            parts = [column.take(t, x) for t, x in cells]
        kept, gone = join_parts([k for k, _ in parts]), [s for _, s in parts if s]
        out.append((kept or whole, "Active" if kept or not gone else "Reference", gone))
    return out


def reference_bands(cells: DataFrame, widths: DataFrame) -> DataFrame:
    """Lines of cells with what the reference column suppresses. `widths` has page_width by page.

    Pages without cells have no rows; NULL cell texts count as empty.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, lines = [], []
        for n, part in pdf.sort_values(["line_no", "cell_no"]).groupby("line_no"):
            numbers.append(int(n))
            lines.append([(t or "", float(x)) for t, x in zip(part["text"], part["left"])])
        done = walk(lines, float(pdf["page_width"].iloc[0]))
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "page_number": int(pdf["page_number"].iloc[0]), "line_no": numbers, "text": [d[0] for d in done], "disposition": [d[1] for d in done], "suppressed": [d[2] for d in done]})

    return cells.select(*PAGE, "line_no", "cell_no", "text", "left").join(widths, list(PAGE)).groupBy(*PAGE).applyInPandas(run, OUT)


# The rules that a line's classification is traced to.
RULES = {
    "Header": "structure.header.standard.v1", "Footer": "structure.footer.standard.v1", "Reference": "content.reference-column.v1", "History": "content.previous-results.v1", "Method": "content.method.v1",
    "EmptyLabel": "content.empty-label.v1", "Text": "text.normalize-technical.v1", "TypographicAttachment": "text.attach-numeric-script.v1", "TextContinuation": "text.join-parenthetical-continuation.v1", "Calculation": "content.calculation-input.v1",
}
PAGE_LINES = "document_id string, page_number int, line_no int, original_text string, text string, disposition string, rules array<string>, suppressed array<struct<text:string,disposition:string,rule_id:string>>"


class Line:
    """A line under way: its cells as (text, left, right), and what becomes of it."""

    def __init__(self, number: int, original: str, norm: str, cells: list[tuple[str, float, float]]):
        self.number, self.original, self.cells = number, original, cells
        self.text, self.disposition, self.rules, self.gone = norm, "Active", [], []

    def whole(self, disposition: str, rule: str) -> None:
        self.disposition, self.rules = disposition, [rule]

    def drop(self, text: str, kind: str) -> None:
        self.gone.append((text, kind, RULES[kind]))
        self.rule(RULES[kind])

    def rule(self, name: str) -> None:
        if name not in self.rules:
            self.rules.append(name)


def attach_raised(lines: list[Line]) -> None:
    """A line that is only `2` or `3` is the exponent of the line below if it stands right behind the cell that ends it."""
    for script, target in zip(lines, lines[1:]):
        if script.disposition != "Active" or script.text not in ("2", "3") or target.disposition != "Active" or target.number != script.number + 1:
            continue
        own = next((c for c in script.cells if c[0] == script.text), None)
        near = sorted((abs(c[2] - own[1]), i) for i, c in enumerate(target.cells) if abs(c[2] - own[1]) <= 4) if own else []
        if near and target.text.endswith(target.cells[near[0][1]][0]):
            target.text += "²" if script.text == "2" else "³"
            target.rule(RULES["TypographicAttachment"])
            script.drop(script.text, "TypographicAttachment")
            script.disposition = "TypographicAttachment"


def join_brackets(lines: list[Line]) -> None:
    """An active line with an open bracket takes the next active line that closes one."""
    balance = lambda t: t.count("(") - t.count(")")
    for opener, rest in zip(lines, lines[1:]):
        if opener.disposition == rest.disposition == "Active" and rest.number == opener.number + 1 and balance(opener.text) > 0 > balance(rest.text):
            opener.text = f"{opener.text} {rest.text}"
            opener.rule(RULES["TextContinuation"])
            rest.drop(rest.text, "TextContinuation")
            rest.disposition = "TextContinuation"


def sanitize_page(rows: list[tuple], width: float) -> list[Line]:
    """The lines of a page, in order, as (number, display text, normalized text, class, rule of a note, calculation, fragment, cells).

    Classes that windows have told are kept. What is left goes cell by cell past the reference column;
    exponents and brackets are joined at the end.
    """
    column, out = Column(width), []
    for number, display, norm, kind, note, calculation, fragment, cells in rows:
        line = Line(number, display, norm, cells)
        out.append(line)
        if kind in ("Header", "Footer"):
            line.whole(kind, RULES[kind])
            continue
        left = min((c[1] for c in cells), default=0.0)
        if column.left is not None and section_title(norm) and left < column.left - SLACK:
            column.left = None
        if kind == "BoilerplateNote":
            line.whole(kind, note)
        elif kind in ("History", "Method", "EmptyLabel"):
            line.whole(kind, RULES["Calculation" if kind == "Method" and calculation else kind])
        elif fragment:
            column.left = None
            line.whole("Reference", RULES["Reference"])
        else:
            material = norm.lower().startswith("material")
            if not material and column.left is not None and capital_label(norm) and column.left < width / 2:
                column.left = None
            kept = []
            for text, x, _ in cells:
                if material:
                    part, gone = (text, "") if text.lower().startswith("material") or not column.holds(x) else ("", text)
                    what = "Reference"
                else:
                    what = "EmptyLabel" if empty_observation(text) and x >= width / 2 else "Reference"
                    part, gone = column.take(text, x)
                if part:
                    kept.append(part)
                if gone:
                    line.drop(gone, what)
            text = join_parts(kept)
            if not text and line.gone and not material:
                line.disposition = "Reference"
            if material or text != display:
                line.rule(RULES["Text"])
            line.text = text or norm
    attach_raised(out)
    join_brackets(out)
    return out


def sanitized_pages(classified: DataFrame, cells: DataFrame, widths: DataFrame) -> DataFrame:
    """Every reconstructed line with its text, disposition, rules and suppressed parts.

    `classified` are the lines of `sanitize.classify` with `line_no` and `display_text`; `cells` the
    cells of these lines; `widths` has page_width by page. All are grouped by page, which is bounded.
    """
    normal = T.normalize_text(F.coalesce("text", F.lit("")))
    by_line = cells.select(*PAGE, "line_no", F.struct("cell_no", normal.alias("text"), "left", "right").alias("c")).groupBy(*PAGE, "line_no").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    whole = classified.select(*PAGE, "line_no", "display_text", "norm", "class", "note_rule", "calc", "fragment").join(by_line, [*PAGE, "line_no"], "left").join(widths, list(PAGE))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, display, norm, kind, note, calc, fragment, own in pdf.sort_values("line_no")[["line_no", "display_text", "norm", "class", "note_rule", "calc", "fragment", "cells"]].to_numpy().tolist():
            rows.append((int(n), display or "", norm or "", kind, note, bool(calc), bool(fragment), [(c["text"], c["left"], c["right"]) for c in (own if own is not None else [])]))
        done = sanitize_page(rows, float(pdf["page_width"].iloc[0]))
        return pd.DataFrame({
            "document_id": pdf["document_id"].iloc[0], "page_number": int(pdf["page_number"].iloc[0]), "line_no": [x.number for x in done], "original_text": [x.original for x in done], "text": [x.text for x in done],
            "disposition": [x.disposition for x in done], "rules": [x.rules for x in done], "suppressed": [[{"text": t, "disposition": d, "rule_id": r} for t, d, r in x.gone] for x in done],
        })

    return whole.groupBy(*PAGE).applyInPandas(run, PAGE_LINES)


def reorder_staggered(lines: list[list[dict]]) -> list[list[dict]]:
    """A dotted field label below its own content goes above it; words behind the label become a line after it.

    The content is the line before, wholly right of the label: beside it, or aligned with the words
    behind the label.
    """
    out = [list(x) for x in lines]
    i = 1
    while i < len(out):
        line, above = out[i], out[i - 1]
        label = next((w for w in line if w["text"].endswith(":") and "..." in w["text"]), None)
        if label and min(w["left"] for w in above) > label["right"] + 2:
            behind = [w for w in line if w["left"] > label["right"]]
            top, bottom = max(w["top"] for w in line), min(w["bottom"] for w in line)
            a_top, a_bottom = max(w["top"] for w in above), min(w["bottom"] for w in above)
            tall = max(top - bottom, a_top - a_bottom)
            if behind:
                fits = abs(min(w["left"] for w in above) - min(w["left"] for w in behind)) <= 5 and max(0.0, a_bottom - top) <= tall * 0.5
            else:
                shared = min(label["top"], a_top) - max(label["bottom"], a_bottom)
                low = max(min(label["top"] - label["bottom"], a_top - a_bottom), 0.001)
                fits = shared / low >= 0.15 and abs(median(w["baseline"] for w in line) - median(w["baseline"] for w in above)) <= tall
            if fits:
                keep = [w for w in line if w not in behind]
                out[i - 1 : i + 1] = [keep, above]
                if behind:
                    out.insert(i + 1, sorted(behind, key=lambda w: (w["left"], w["idx"])))
        i += 1
    return out
