"""Texts cut off before their end, by hashed logistic regression on how texts close.

The limits of a source are read from the lengths of all its different texts: a limit shows as a pile of
texts at one length with hardly any longer ones, in characters or in UTF-8 bytes. Training data are made from intact texts: as they
are (not cut), and cut by hand at the source's limit, or anywhere where it has none (cut). Cuts that
fall between two sentences or lines leave nothing to see and are not used. Features are hashed: closing
characters and words with digits masked, the shape of the last line, punctuation and open brackets, and
how near the length is to a limit. As some texts taken for intact are not, the sample is judged by cross
fitting first, and the final fit leaves out texts that models of other texts took for cut.

Features see the whole last line. The classifier is fitted on a bounded sample of `SAMPLE` different texts;
limits cover, and scores are for, every record.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laudario.session import cut, small_side, spread

SAMPLE = 30_000  # texts that the classifier is fitted on, at most
TAIL = 240  # closing characters that are looked at where the last line is shorter; longer last lines are looked at whole
BITS = 18
SEED = 5
PILE_LEAST, PILE_RATIO, PILE_SPAN, PILE_ABOVE = 5, 6.0, 100, 5

_DIGIT = re.compile(r"\d")
_CAPS, _LOWER, _NUM = re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[a-zß-ÿ]+"), re.compile(r"9+")
_INNER = re.compile(r"(\S)[ \t]*\n+(?![a-zà-ÿ])|([.!?])\s+(?=[A-ZÀ-Þ])")
ENDS = ".!?…"


def features(tail: str, whole: bool, chars: int, bytes_: int, source: str) -> list[str]:
    """Features of a closing. `whole`: the tail is the text itself; `chars`, `bytes_`: 0 far from a limit, 1 at it, -1 no limit."""
    text = tail.rstrip()
    masked = _DIGIT.sub("9", text)
    line = masked[masked.rfind("\n") + 1 :]
    words = line.split()
    out = [f"s{k}:{masked[-k:]}" for k in (1, 2, 3, 4, 5, 6, 8)]
    last = words[-1] if words else ""
    out += [f"w1:{last}", f"w2:{' '.join(words[-2:])}", f"w3:{' '.join(words[-3:])}", f"w4:{' '.join(words[-4:])}"]
    closed = text[-1:] in ENDS or text[-2:-1] in ENDS and text[-1:] in ")\"'»”"
    shape = _NUM.sub("9", _LOWER.sub("a", _CAPS.sub("A", line)))
    begin = "text" if whole and len(line) == len(masked) else "line" if len(line) < len(masked) else "far"
    out += [f"lead:{begin}:{words[0] if words else ''}:{len(words) if len(words) < 6 else 6}", f"shape:{shape[:60]}" if len(shape) <= 60 else "shape:long", f"lineshape:{begin}:{shape[-16:]}"]
    if len(line) <= 48 and begin == "line":
        out.append(f"line:{line}")
    sentence = re.split(r"(?<=[.!?])\s+", line)[-1]
    out += [f"sent:{sentence[:40]}" if len(sentence) <= 40 else "sent:long", f"sentwords:{min(len(sentence.split()), 12)}:{closed}"]
    kind = "end" if closed else "letter" if text[-1:].isalpha() else "digit" if text[-1:].isdigit() else f"other{text[-1:]}"
    out += [f"kind:{kind}", f"open:{line.count('(') > line.count(')')}", f"dots:{text[-3:] == '...' or text[-1:] == '…'}", f"broken:{text[-1:] == chr(0xFFFD)}", f"space:{tail != text}"]
    at = "c" if chars == 1 else "b" if bytes_ == 1 else "-"
    out += [f"limit:{at}", f"limit:{at}:{kind}", f"src:{source}:{kind}", f"bias"]
    return out


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names]


class Logistic:
    """Logistic regression over hashed features, fitted by Adam on all rows at once."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(1 << BITS, np.float32) if weights is None else weights

    def fit(self, rows: list[list[int]], labels: np.ndarray, rounds: int = 200, rate: float = 0.08, l2: float = 2e-6) -> Logistic:
        index = np.concatenate([np.asarray(r, np.int64) for r in rows])
        size = np.array([len(r) for r in rows])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        used, index = np.unique(index, return_inverse=True)
        w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[index], start), -30, 30)))
            g = np.bincount(index, np.repeat(p - labels, size), len(used)) / len(rows) + l2 * w
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights[:] = 0
        self.weights[used] = w
        return self

    def score(self, rows: list[list[int]]) -> np.ndarray:
        total = np.array([self.weights[r].sum() for r in rows]) if rows else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def last_line(text: Column) -> Column:
    """The end of a text from its last line on, or its `TAIL` last characters if these are more."""
    body = F.rtrim(text, F.lit(" \t\r\n\f\v\u00a0"))
    line = F.instr(F.reverse(body), F.lit("\n"))
    line = F.when(line == 0, F.length(body)).otherwise(line)
    return F.right(text, F.greatest(F.lit(TAIL), F.length(text) - F.length(body) + line))


def measured(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, the lengths and the closing of each text; the closing is NULL for NULL, empty and blank texts."""
    body = F.regexp_replace(F.col(text), "�+$", "")
    there = F.col(text).rlike(r"\S")
    return df.select(
        F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.length(text).alias("chars"), F.octet_length(body).alias("bytes"),
        F.when(there, last_line(F.col(text))).alias("tail"), F.when(there, F.xxhash64(F.lit(SEED), F.coalesce(F.col(source), F.lit("")), F.col(text))).alias("h"),
    )


def lengths(rows: DataFrame) -> DataFrame:
    """source, chars, bytes, n: the different texts of each length; copies are one, so that they make no pile."""
    once = rows.where("h is not null").groupBy("source", "chars", "bytes", "h").agg(F.lit(1).alias("one"))
    return once.groupBy("source", "chars", "bytes").agg(F.count("*").alias("n"))


def limits(lengths: DataFrame) -> DataFrame:
    """source, char_limit, byte_limit (NULL where the source has none), over the lengths of all texts.

    A limit is the greatest length with a pile of texts: many more than at the lengths below it, and at
    least five times as many as there are longer ones, so that a few longer texts don't hide it.
    """
    out = lengths.select("source").distinct()
    for what, name in (("chars", "char_limit"), ("bytes", "byte_limit")):
        by = lengths.groupBy("source", what).agg(F.sum("n").alias("n"))
        order = W.partitionBy("source").orderBy(what)
        counted = by.select(
            "source", what, F.sum("n").over(order.rangeBetween(-1, 0)).alias("at"),
            F.coalesce(F.sum("n").over(order.rangeBetween(-1 - PILE_SPAN, -2)), F.lit(0)).alias("below"),
            F.coalesce(F.sum("n").over(order.rangeBetween(1, W.unboundedFollowing)), F.lit(0)).alias("above"),
        )
        pile = counted.where((F.col("at") >= PILE_LEAST) & (F.col("at") / 2 > PILE_RATIO * (F.col("below") + 1) / PILE_SPAN) & (F.col("above") * PILE_ABOVE <= F.col("at")))
        out = out.join(pile.groupBy("source").agg(F.max(what).alias(name)), "source", "left")
    return out


def near_limit(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds `at_chars` and `at_bytes`: 1 at the limit, 0 below or above it, -1 without one."""
    joined = rows.join(bounds, "source", "left")
    return joined.withColumn("at_chars", F.when(F.col("char_limit").isNull(), -1).when(F.col("chars").between(F.col("char_limit") - 1, F.col("char_limit")), 1).otherwise(0)).withColumn(
        "at_bytes", F.when(F.col("byte_limit").isNull(), -1).when(F.col("bytes").between(F.col("byte_limit") - 3, F.col("byte_limit")), 1).otherwise(0)
    )


def _visible(text: str, at: int) -> bool:
    """Whether a cut before position `at` shows: it lies inside a line and not between two sentences."""
    head, rest = text[:at].rstrip(" "), text[at:]
    if not head.strip() or not rest.strip() or head.endswith("\n") or rest[0] == "\n":
        return False
    between = len(head) < at or rest[0].isspace()
    return not (between and (head[-1] in ENDS or head[-2:-1] in ENDS and head[-1] in ")\"'"))


def closing(text: str) -> tuple[str, bool]:
    """The closing of a text as `last_line` cuts it, and whether it is the text itself."""
    body = text.rstrip(" \t\r\n\f\v\u00a0")
    size = max(TAIL, len(text) - len(body) + len(body) - body.rfind("\n"))
    return text[-size:], size >= len(text)


def examples(texts: list[str], source: str, char_limit: int | None, byte_limit: int | None, hashes: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(third, label, hashed features) of texts of one source, left as they are (0) and cut by hand (1).

    Texts at a limit are left out. A third is chosen by the text's closing, so that copies share it.
    """
    at_c, at_b = -1 if not char_limit else 0, -1 if not byte_limit else 0

    for text, h in zip(texts, hashes):
        rng = np.random.default_rng((SEED, h & 0xFFFFFFFF))
        third = zlib.crc32(text[-TAIL:].encode("utf-8", "surrogatepass")) % 3

        def made(body: str, near: bool, label: int) -> tuple[int, int, list[int]]:
            tail, whole = closing(body)
            return third, label, hashed(features(tail, whole, 1 if near and at_c == 0 else at_c, 1 if near and at_c < 0 and at_b == 0 else at_b, source))

        if char_limit and char_limit - 1 <= len(text) <= char_limit or byte_limit and byte_limit - 3 <= len(text.encode("utf-8", "surrogatepass")) <= byte_limit:
            continue
        # Some intact texts reach a limit by chance; one in ten is shown as if it did.
        yield made(text, rng.random() < 0.1, 0)
        # A text that ends with one of its inner lines or sentences is whole, too; rare kinds of lines are learned so.
        inner = [m.end(m.lastindex) for m in _INNER.finditer(text)]
        if inner:
            near = rng.random() < 0.1
            yield made(text[: inner[rng.integers(len(inner))]], near, 0)
        joined = text
        if char_limit or byte_limit:
            while len(joined) <= (char_limit or byte_limit):
                joined = joined.rstrip() + (" " if rng.random() < 0.7 else "\n") + texts[rng.integers(len(texts))].strip()
        for _ in range(6):
            low, high = (len(joined) // 3, len(joined)) if char_limit or byte_limit else (len(text) // 4, max(3, len(text)))
            at = int(rng.integers(max(2, low), max(3, high)))
            if at < len(joined) and _visible(joined, at):
                kept = joined[:at]
                if rng.random() < 0.06:
                    kept += "�"
                elif rng.random() < 0.15:
                    kept = kept[:-3].rstrip() + "..." if len(kept) > 8 else kept
                yield made(kept, rng.random() < 0.85, 1)
                break


def train(rows: list[list[int]], labels: np.ndarray, thirds: np.ndarray, rounds: int = 200) -> Logistic:
    """Each third is judged by a model of the other two, so that no text vouches for itself; intact texts that look cut are left out of the last fit."""
    if not rows or not labels.any() or labels.all():
        return Logistic()
    keep = np.ones(len(rows), bool)
    for f in range(3):
        rest, own = np.flatnonzero(thirds != f), np.flatnonzero(thirds == f)
        if len(own) and len(rest) and labels[rest].any() and not labels[rest].all():
            p = Logistic().fit([rows[k] for k in rest], labels[rest], rounds).score([rows[k] for k in own])
            keep[own] = (labels[own] == 1) | (p < 0.5)
    kept = np.flatnonzero(keep)
    return Logistic().fit([rows[k] for k in kept], labels[kept], rounds)


def draw(documents: DataFrame, text: str, source: str, different: int, sample: int) -> DataFrame:
    """(t, source, h) of different texts of a source that aren't blank, those below a bound of their hash; copies are drawn as one.

    The bound is set five deviations below `sample`, so that no more are drawn.
    """
    share = min(1.0, max(0.0, sample - 5 * sample**0.5) / max(different, 1)) if different > sample else 1.0
    texts = documents.where(F.col(text).rlike(r"\S")).select(F.col(text).alias("t"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    hashed_ = texts.withColumn("h", F.xxhash64(F.lit(SEED), F.col("source"), F.col("t")))
    return hashed_.where(F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("h")), F.lit(1_000_003)) < int(share * 1_000_003)).dropDuplicates(["h"])


def training_rows(chosen: DataFrame, bounds: DataFrame, parts: int = 8) -> DataFrame:
    """(third, label, features) made of the drawn texts, on the executors; texts that fill up others come from the same part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A part holds a bounded share of the sample.
        parts = list(batches)
        if not parts:
            return
        whole = pd.concat(parts, ignore_index=True)
        for (source, c, b), group in whole.assign(c=whole["char_limit"].fillna(0), b=whole["byte_limit"].fillna(0)).groupby(["source", "c", "b"], sort=True):
            made = list(examples(group["t"].tolist(), source, int(c) or None, int(b) or None, group["h"].tolist()))
            yield pd.DataFrame({"third": [m[0] for m in made], "label": [m[1] for m in made], "features": [m[2] for m in made]})

    sorted_ = chosen.join(bounds, "source", "left").repartition(parts, "h").sortWithinPartitions("h")
    return sorted_.select("t", "source", "h", "char_limit", "byte_limit").mapInPandas(run, "third int, label int, features array<int>")


def score(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(key, source, probability, truncated) of every record.

    NULL, empty and blank texts are never truncated (probability 0); a NULL source counts as one source
    of its own. Repeated rows are scored each. Without texts to learn from nothing is truncated. The
    table is read three times: for the lengths, for the sample, for the scores. Of the sample only
    hashed features come to the driver, some dozens of numbers for each of at most three cuts of a text.
    """
    rows = measured(documents, key, text, source)
    counted = cut(lengths(rows))
    bounds = small_side(cut(limits(counted)))
    different = counted.agg(F.sum("n")).first()[0] or 0
    data = training_rows(draw(documents, text, source, different, sample), bounds).toPandas()
    model = train([np.asarray(f) for f in data["features"]], data["label"].to_numpy(np.float64), data["third"].to_numpy())
    weights = documents.sparkSession.sparkContext.broadcast(model.weights)
    fitted = bool(model.weights.any())

    @F.pandas_udf("double")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = Logistic(weights.value)
        for tails, chars, cs, bs, sources in batches:
            there = [k for k, t in enumerate(tails) if t is not None]
            out = np.zeros(len(tails))
            if there:
                tails, chars, cs, bs, sources = (x.tolist() for x in (tails, chars, cs, bs, sources))
                out[there] = m.score([hashed(features(tails[k], len(tails[k]) >= chars[k], cs[k], bs[k], sources[k])) for k in there])
            yield pd.Series(out)

    marked = near_limit(spread(rows), bounds)
    p = judge("tail", F.coalesce("chars", F.lit(0)), "at_chars", "at_bytes", "source") if fitted else F.lit(0.0)
    judged = marked.withColumn("probability", p).select(F.col("key").alias(key), "source", "probability")
    return judged.withColumn("truncated", F.col("probability") >= 0.5)


def p8_found(documents: DataFrame) -> DataFrame:
    return score(documents).where("truncated").select("doc_id")


def p8_rates(documents: DataFrame) -> DataFrame:
    """Texts, cut texts and their share, by source."""
    return score(documents).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("cut"), F.avg(F.col("truncated").cast("int")).alias("share"))
