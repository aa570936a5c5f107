"""Visually identical text with different characters, brought to one form.

Ordinary writing is ASCII, the accented letters of Portuguese as single code points, and a few signs.
The JVM finds the rows that hold anything else by one pattern; only those go on. Characters with a
plain counterpart of their own (full-width forms, ligatures, exotic spaces and hyphens, invisible
characters, combining accents) are folded. Letters of other scripts that look like Latin ones are
repaired by token. The dominant script of a token is that of most of its letters. A token that holds
letters of other scripts than its dominant one is mixed and becomes its Latin reading if that reading
occurs in the vocabulary of the corpus's ordinary rows. A token that is foreign as a whole is taken for
mixed with its text, and read likewise, where Latin dominates the text: tokens of another dominant
script that have no Latin reading don't outnumber those of Latin. The vocabulary is never collected:
the readings, which are few, meet the words of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laudario.session import cut, small_side

# The letters and signs beyond ASCII that ordinary writing uses.
LETTERS = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ"
SIGNS = "ªº±²³µβγ≥"
ORDINARY = "\\x00-\\x7F" + LETTERS + SIGNS
STRANGE = f"[^{ORDINARY}]"

# Look-alike letters of other scripts and the Latin letters they resemble.
LOOKS = dict(zip(
    "аеорсухіѕјһԁԛԝкԍ" "АВЕКМНОРСТХІЅЈУԌ" "αορνικυχϲε" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" "ɑɡıօցհոսՕՍ",
    "aeopcyxisjhdqwkg" "ABEKMHOPCTXISJYG" "aopvikuxce" "ABEZHIKMNOPTYXC" "agiogh" "nuOU",
))
# Characters that show nothing.
INVISIBLE = "​‌‍‎‏⁠⁡⁢⁣﻿᠎­͏؜‪‫‬‭‮"
# Hyphens and dashes.
HYPHENS = "‐‑‒–—−﹣"
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_DASH = dict.fromkeys(map(ord, HYPHENS), "-")
_KEEP = set(SIGNS)
_WORD = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+")


def fold(text: str) -> str:
    """Folds characters with a plain counterpart: invisible ones vanish, spaces become plain, compatibility forms and accents compose."""
    text = text.translate(_DROP).translate(_DASH)
    out = []
    for c in text:
        if c in _KEEP or c in LOOKS or c < "\x80":
            out.append(c)
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        elif c in "  \u0085":
            out.append("\n")
        elif c == "μ":
            out.append("µ")
        elif unicodedata.decomposition(c).startswith("<"):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def script(c: str) -> str:
    """Latin, another script's name, or `` for what is no letter."""
    if c < "\x80":
        return "LATIN" if c.isalpha() else ""
    if c in _KEEP or not unicodedata.category(c).startswith("L"):
        return ""
    name = unicodedata.name(c, "")
    if c in "ɑɡı":  # look-alikes that Unicode counts as Latin
        return "LATIN ALIKE"
    return name.split(" ")[0]


def dominant(token: str) -> str:
    """The script of most letters of the token; Latin wins ties."""
    counts = Counter(s for c in token if (s := script(c)))
    return max(counts, key=lambda s: (counts[s], s == "LATIN"), default="")


def latin_reading(token: str) -> str | None:
    """The token with look-alikes replaced, or None if a letter of another script has no Latin look."""
    out = unicodedata.normalize("NFC", "".join(LOOKS.get(c, c) for c in unicodedata.normalize("NFD", token)))
    return out if all(script(c) in ("", "LATIN") for c in out) else None


def amid_latin(tokens: list[str]) -> bool:
    """Whether the tokens are Latin text; those of another script that have a Latin reading tell nothing."""
    latin = sum(dominant(t) == "LATIN" for t in tokens)
    return latin >= sum(dominant(t) != "LATIN" and latin_reading(t) is None for t in tokens)


def pieces(text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The folded text, and (start, end, reading, vocabulary key) of each token that may be repaired.

    A token of mixed scripts is a candidate whatever script dominates it. A token of one foreign script
    alone is mixed with its text at most: it is a candidate where Latin dominates the text's tokens.
    """
    folded = fold(text)
    out, latin = [], None
    for m in _WORD.finditer(folded):
        token = m[0]
        if token.isascii():
            continue
        main = dominant(token)
        mixed = any(s != main for c in token if (s := script(c)))
        if mixed or main not in ("", "LATIN"):
            reading = latin_reading(token)
            if reading is None:
                continue
            if not mixed:
                latin = amid_latin(_WORD.findall(folded)) if latin is None else latin
            if mixed or latin:
                out.append((m.start(), m.end(), reading, reading.lower()))
    return folded, out


def mend(folded: str, parts: list[tuple[int, int, str, str]], accepted: set[str]) -> str:
    out, at = [], 0
    for start, end, reading, key in parts:
        out.append(folded[at:start])
        out.append(reading if key in accepted else folded[start:end])
        at = end
    return "".join(out) + folded[at:]


def strange(text: Column) -> Column:
    """Whether a text holds anything but ordinary writing; texts of ASCII alone are told by their lengths."""
    return (F.length(text) != F.octet_length(text)) & text.rlike(STRANGE)


def flagged(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text holds anything but ordinary writing; NULL and empty texts never do."""
    return df.where(strange(F.col(text)))


def known_words(corpus: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Those of the `wanted` words (column `key`, distinct) that occur, in any letter case, in the corpus's rows of ordinary writing."""
    plain = corpus.where(~strange(F.col(text)))
    words = plain.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-záàâãéêíóôõúüç]+")).alias("key"))
    return words.join(small_side(wanted), "key", "left_semi").distinct()


def repair(df: DataFrame, keys: list[str], text: str, corpus: DataFrame) -> DataFrame:
    """(keys, text, folded, repaired, residual) of the flagged rows of df.

    `repaired` is the text in its one form; `residual` tells that strange characters are left because
    no reading was in the vocabulary, which is the words of the ordinary rows of `corpus` (its column `text`).
    `keys` identify a row; rows repeated under one key are repaired alike and come out once. The table
    is read once for its flagged rows, which are few and kept, and once for its vocabulary.
    """
    rows = flagged(df.select(*keys, F.col(text).alias("text")), "text")

    @F.pandas_udf("struct<folded:string,parts:array<struct<s:int,e:int,reading:string,key:string>>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done = [pieces(t) for t in texts]
            yield pd.DataFrame({"folded": [d[0] for d in done], "parts": [[{"s": s, "e": e, "reading": r, "key": k} for s, e, r, k in d[1]] for d in done]})

    done = cut(rows.select(*keys, "text", read("text").alias("c")).select(*keys, "text", "c.folded", "c.parts"))
    simple = done.where(F.size("parts") == 0).select(*keys, "text", "folded", F.col("folded").alias("repaired"))
    parts = done.where(F.size("parts") > 0).select(*keys, "text", "folded", F.explode("parts").alias("p"))
    wanted = cut(parts.select(F.col("p.key").alias("key")).distinct())
    known = known_words(corpus, "text", wanted).withColumn("known", F.lit(True))
    judged = parts.withColumn("key", F.col("p.key")).join(known, "key", "left")

    @F.pandas_udf("string")
    def join_up(folded: pd.Series, list_: pd.Series) -> pd.Series:
        out = []
        for f, ps in zip(folded, list_):
            ps = sorted(((p["s"], p["e"], p["reading"], p["known"]) for p in ps), key=lambda x: x[0])
            out.append(mend(f, [(s, e, r, "y" if k else "n") for s, e, r, k in ps], {"y"}))
        return pd.Series(out)

    whole = judged.groupBy(*keys).agg(
        F.first("text").alias("text"), F.first("folded").alias("folded"),
        F.collect_set(F.struct("p.s", "p.e", "p.reading", F.coalesce("known", F.lit(False)).alias("known"))).alias("list_"),
    ).select(*keys, "text", "folded", join_up("folded", "list_").alias("repaired"))
    return simple.dropDuplicates(keys).unionByName(whole).withColumn("residual", strange(F.col("repaired")))


def gather(lines: DataFrame, words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The three tables' texts under one schema: table_name, record_key, text."""
    return (
        lines.select(F.lit("sanitized_line").alias("table_name"), F.col("line_key").alias("record_key"), F.col("original_text").alias("text"))
        .unionByName(words.select(F.lit("capture_word").alias("table_name"), F.col("word_key").alias("record_key"), "text"))
        .unionByName(glyphs.select(F.lit("capture_glyph").alias("table_name"), F.col("glyph_key").alias("record_key"), "text"))
    )


def p4_repaired(lines: DataFrame, words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(table_name, record_key, text, folded, repaired, residual) of all rows with strange characters."""
    every = gather(lines, words, glyphs)
    return repair(every, ["table_name", "record_key"], "text", every)


def p4_found(lines: DataFrame, words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Rows that the repair changed, or in which it left strange characters."""
    done = p4_repaired(lines, words, glyphs)
    return done.where((F.col("repaired") != F.col("text")) | F.col("residual")).select("table_name", "record_key")
