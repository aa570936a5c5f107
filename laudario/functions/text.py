"""Text functions of the report pipeline, as Spark columns and as the same expressions in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
# Fixed value: white space beyond ASCII that trimming removes.
WIDE = "\u0085   -     　"
EDGE = f"^[\\s{WIDE}]+|[\\s{WIDE}]+$"
DOTTED = r"([\p{L}\p{M}\p{N}\)])(?:\s*\.)+\s*:"
# Fixed value: numbers in Brazilian notation with the units that reports use.
NUMERIC = (
    r"((?:[<>]=?\s*)?-?\d+(?:\.\d{3})*(?:,\d+)?)(?:\s*(mg\s*/\s*dl|ng\s*/\s*m?l|pg\s*/\s*ml|mEq\s*/\s*l|mmol\s*/\s*l|U\s*/\s*l|UI\s*/\s*ml|uUI\s*/\s*ml|mUI\s*/\s*ml"
    r"|g\s*/\s*dl|mg\s*/\s*l|%|mmHg|segundos?|UFC\s*/\s*mL|mL/min/1,73m[²2]|mm[³3]|/mm[³3]|/uL|fl|pg))?"
)


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def normalize_text(c: Column) -> Column:
    """Ligatures apart, plain spaces, no soft hyphens, one space in a row, dotted labels closed. NULL stays NULL."""
    c = F.replace(F.replace(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit(" "), F.lit(" ")), F.lit("­"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), EDGE, "")
    return F.regexp_replace(F.regexp_replace(c, DOTTED, "$1:"), r"\s+:", ":")


def sql_normalize_text(e: str) -> str:
    e = f"replace(replace(replace(replace({e}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(160), ' '), chr(173), '')"
    e = f"regexp_replace(regexp_replace({e}, '[ \\t]+', ' ', 'g'), {_q(EDGE)}, '', 'g')"
    return f"regexp_replace(regexp_replace({e}, {_q(DOTTED)}, '\\1:', 'g'), '\\s+:', ':', 'g')"


def plain(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def sql_plain(e: str) -> str:
    return f"regexp_replace(translate({e}, '{ACCENTED}', '{PLAIN}'), '\\p{{Mn}}+', '', 'g')"


def comparison_key(c: Column) -> Column:
    """Upper case without accents, one space in a row: for prefix rules."""
    c = F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.upper(F.regexp_replace(F.regexp_replace(plain(c), f"[\\s{WIDE}]+", " "), "^ | $", ""))


def sql_comparison_key(e: str) -> str:
    e = sql_plain(f"replace(replace({e}, 'ﬁ', 'fi'), 'ﬂ', 'fl')")
    return f"upper(regexp_replace(regexp_replace({e}, {_q(f'[\\s{WIDE}]+')}, ' ', 'g'), '^ | $', '', 'g'))"


def literal_label(c: Column) -> Column:
    """The label of a line: before the first colon; else before a bar that a digit follows; else all of it."""
    t = F.regexp_replace(F.regexp_replace(c, f"[\\s{WIDE}]+", " "), "^ | $", "")
    out = F.when(t.contains(":"), F.regexp_extract(t, "^([^:]*):", 1)).when(t.rlike(r"\|.*\d"), F.regexp_extract(t, r"^([^|]*)\|", 1)).otherwise(t)
    return F.regexp_replace(out, r"^[ .]+|[ .]+$", "")


def sql_literal_label(e: str) -> str:
    t = f"regexp_replace(regexp_replace({e}, {_q(f'[\\s{WIDE}]+')}, ' ', 'g'), '^ | $', '', 'g')"
    out = f"CASE WHEN contains({t}, ':') THEN regexp_extract({t}, '^([^:]*):', 1) WHEN regexp_matches({t}, '\\|.*\\d') THEN regexp_extract({t}, '^([^|]*)\\|', 1) ELSE {t} END"
    return f"regexp_replace({out}, '^[ .]+|[ .]+$', '', 'g')"


def normalize_label(c: Column) -> Column:
    """Letters and digits in upper case without accents, every other run one space."""
    return F.regexp_replace(F.upper(F.regexp_replace(plain(c), r"[^\p{L}\p{Nd}]+", " ")), "^ | $", "")


def sql_normalize_label(e: str) -> str:
    return f"regexp_replace(upper(regexp_replace({sql_plain(e)}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), '^ | $', '', 'g')"


def result_segment(c: Column) -> Column:
    """What a line states: after the colon; else after a bar if a number follows; else the line if it begins with one; else nothing."""
    after_bar = F.regexp_extract(c, r"^[^|]*\|(.*)$", 1)
    return F.when(c.contains(":"), F.regexp_extract(c, r"^[^:]*:(.*)$", 1)).when(c.contains("|") & after_bar.rlike(r"^\s*[0-9<>-]"), after_bar).when(c.rlike(r"^\s*[0-9<>-]"), c).otherwise(F.lit(""))


def sql_result_segment(e: str) -> str:
    bar = f"regexp_extract({e}, '^[^|]*\\|(.*)$', 1)"
    return f"CASE WHEN contains({e}, ':') THEN regexp_extract({e}, '^[^:]*:(.*)$', 1) WHEN contains({e}, '|') AND regexp_matches({bar}, '^\\s*[0-9<>-]') THEN {bar} WHEN regexp_matches({e}, '^\\s*[0-9<>-]') THEN {e} ELSE '' END"


def parse_decimal(c: Column) -> Column:
    """A Brazilian decimal as DECIMAL(28,10); a space after a comparison sign makes it NULL."""
    t = F.replace(F.replace(F.regexp_replace(c, "^[<>=]+", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("decimal(28,10)"))


def sql_parse_decimal(e: str) -> str:
    t = f"replace(replace(regexp_replace({e}, '^[<>=]+', ''), '.', ''), ',', '.')"
    return f"CASE WHEN regexp_matches({t}, '^-?\\d+(\\.\\d+)?$') THEN TRY_CAST({t} AS DECIMAL(28,10)) END"


def is_upper_label(c: Column) -> Column:
    """A field label in capitals: a colon at place 2 to 90, a letter first, two letters or more, all capital."""
    prefix = F.regexp_extract(c, "^([^:]{2,90}):", 1)
    return prefix.rlike(r"^\p{L}") & prefix.rlike(r"\p{L}.*\p{L}") & ~prefix.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def sql_is_upper_label(e: str) -> str:
    p = f"regexp_extract({e}, '^([^:]{{2,90}}):', 1)"
    return f"(regexp_matches({p}, '^\\p{{L}}') AND regexp_matches({p}, '\\p{{L}}.*\\p{{L}}') AND NOT regexp_matches({p}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))"


def is_any_label(c: Column) -> Column:
    """A field label: a letter first, two letters or more, twelve words at most, no point."""
    prefix = F.regexp_extract(c, "^([^:]{2,90}):", 1)
    return prefix.rlike(r"^\p{L}") & prefix.rlike(r"\p{L}.*\p{L}") & ~prefix.contains(".") & (F.regexp_count(prefix, F.lit("[^ ]+")) <= 12)


def sql_is_any_label(e: str) -> str:
    p = f"regexp_extract({e}, '^([^:]{{2,90}}):', 1)"
    return f"(regexp_matches({p}, '^\\p{{L}}') AND regexp_matches({p}, '\\p{{L}}.*\\p{{L}}') AND NOT contains({p}, '.') AND len(regexp_extract_all({p}, '[^ ]+')) <= 12)"


def is_section_title(c: Column) -> Column:
    """A title: up to 100 characters, no colon, four letters or more, all capital."""
    return c.rlike(r"^[^:]{1,100}$") & c.rlike(r"(?:\p{L}[^\p{L}]*){4}") & ~c.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def sql_is_section_title(e: str) -> str:
    return f"(regexp_matches({e}, '^[^:]{{1,100}}$') AND regexp_matches({e}, '(?:\\p{{L}}[^\\p{{L}}]*){{4}}') AND NOT regexp_matches({e}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-<16 hex digits> of the SHA-256 of the parts, joined by U+001F; NULL parts count as empty."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def sql_stable_id(prefix: str, *parts: str) -> str:
    joined = " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"'{prefix}-' || substr(sha256({joined}), 1, 16)"


def identity_text(c: Column) -> Column:
    """Upper case, one space in a row, trimmed: for keys."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, f"[\\s{WIDE}]+", " "), "^ | $", ""))


def sql_identity_text(e: str) -> str:
    return f"upper(regexp_replace(regexp_replace({e}, {_q(f'[\\s{WIDE}]+')}, ' ', 'g'), '^ | $', '', 'g'))"


def iso_or_raw(c: Column) -> Column:
    """dd/MM/yyyy as an ISO date; anything else as key text."""
    return F.coalesce(F.date_format(F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))), "yyyy-MM-dd"), identity_text(c))


def sql_iso_or_raw(e: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({e}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN strftime(try_strptime({e}, '%d/%m/%Y'), '%Y-%m-%d') END, {sql_identity_text(e)})"


def compact_number(c: Column) -> Column:
    """pt-BR with up to two decimals and thousands in groups; halves away from zero."""
    return F.translate(F.call_function("format_number", F.round(c, 2), F.lit("#,##0.##")), ",.", ".,")
