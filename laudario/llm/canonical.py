"""Free-entered values mapped to the closest entry of a reference list; misses are reported.

The reference list is broadcast as a symmetric-delete dictionary of its words. A label is cut into
words; each word looks up dictionary words within a bounded edit distance (its deletions meet theirs),
and words that it abbreviates: prefixes from a sorted vocabulary, misspelt prefixes from a
symmetric-delete dictionary of the prefixes, so that no lookup walks the vocabulary. The words of the
label are then aligned with those of each candidate entry by optimal assignment, at weighted
Damerau-Levenshtein costs. Words of the label that no entry word explains, and words of the entry that
the label lacks, cost a fixed amount each, joining words and notes next to nothing. Equal costs are
ranked by the entry's reference frequency. Beyond the bound a label stands for none.

Each different label is mapped once and joined back; the labels that make up a thousandth of the rows
or more, of which there are a thousand at most, are joined by broadcast, so that a hot label moves nowhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laudario.llm.edits import NEAR, assign, deletes, distance, plain
from laudario.session import cut, spread

UNMATCHED = "unmatched"
BLOCK = 50_000  # entries of a reference list that are sent to the executors at once; longer lists are searched in blocks
HOT_SHARE = 1000  # labels of at least this part of the rows are joined by broadcast

# Words that join others and carry no meaning of their own.
JOINERS = frozenset("a ao as com da das de do dos e em na nas no nos o os para por".split())
# Notes that people write around a name.
NOTES = frozenset("lab exame exames ex solicito solicitar pedido repetir rotina urgente urgencia controle ok 1x 2x obs favor pf".split())
# Usual abbreviations that are no prefix of their word.
SHORT = {
    "us": ("ultrassensivel",), "hb": ("hemoglobina",), "jj": ("jejum",), "ag": ("antigeno",), "ac": ("acido",), "gli": ("glicemia",), "ht": ("hematocrito",),
    "plt": ("plaquetas",), "tx": ("tiroxina",), "qt": ("quantitativo",), "cmv": ("citomegalovirus",), "toxo": ("toxoplasmose",), "tp": ("tempo", "protrombina"),
    "1a": ("primeira",), "1o": ("primeiro",), "2a": ("segunda",), "2o": ("segundo",), "24h": ("24",), "2h": ("2",),
}

MISSING, EXTRA, SLIGHT, NOTE = 0.9, 0.9, 0.01, 0.05  # costs of words without a partner


def words(text: str) -> list[str]:
    """Words of a label: lower case, without accents and punctuation; letters and digits in one word stay together."""
    return [w for w in re.split(r"[^a-z0-9]+", plain(text)) if w]


def allowed(length: int) -> int:
    """The edit distance that a word of this length may have; of three letters, only swaps and doublings count, see `near`."""
    return 0 if length <= 2 else 1 if length <= 4 else 2 if length <= 8 else 3


@dataclass
class Entry:
    concept: str
    words: list[str]
    frequency: int


class Canon:
    """The reference list as a symmetric-delete dictionary of words, of their prefixes, and of whole entries without spaces.

    `notes` are words that mean nothing beside a name, `short` abbreviations that are no prefixes; either may be empty.
    """

    def __init__(self, entries: Iterable[tuple[str, str, int]], bound: float = 1.0, notes: Collection[str] = NOTES, short: Mapping[str, tuple[str, ...]] = SHORT):
        self.bound = bound
        self.remarks, self.short = frozenset(notes), dict(short)
        self.entries: list[Entry] = []
        known = set()
        for text, concept, frequency in entries:
            if text is None or concept is None:
                continue
            parts = words(text)
            if not parts or (tuple(parts), concept) in known:
                continue
            known.add((tuple(parts), concept))
            self.entries.append(Entry(concept, parts, frequency or 0))
        self.having: dict[str, list[int]] = defaultdict(list)
        for i, e in enumerate(self.entries):
            for w in set(e.words):
                self.having[w].append(i)
        self.index: dict[str, set[str]] = defaultdict(set)
        self.prefixes: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for w in self.having:
            for d in deletes(w, allowed(len(w))):
                self.index[d].add(w)
            if w.isalpha():
                for n in range(3, len(w)):
                    for d in deletes(w[:n], 1):
                        self.prefixes[d].add((w[:n], w))
        self.whole: dict[str, set[tuple[str, int]]] = defaultdict(set)
        for i, e in enumerate(self.entries):
            for joined in {"".join(e.words), "".join(x for x in e.words if x not in JOINERS)}:
                if len(joined) >= 5:
                    for d in deletes(joined, 1):
                        self.whole[d].add((joined, i))
        self.longest_remark = max(map(len, self.remarks), default=0)
        self.remark_index: dict[str, set[str]] = defaultdict(set)
        for n in self.remarks:
            if len(n) >= 5:
                for d in deletes(n, 2):
                    self.remark_index[d].add(n)
        self.vocabulary = sorted(self.having)
        self.longest = max(map(len, self.having), default=0)
        self.longest_whole = max((sum(map(len, e.words)) for e in self.entries), default=0)
        self.cache: dict[tuple[str, ...], tuple[str, float, int]] = {}
        self.word_cache: dict[str, dict[str, float]] = {}
        self.extras: dict[str, float] = {}

    def near(self, word: str, elsewhere: Collection[str] = ()) -> dict[str, float]:
        """Dictionary words that the word may stand for, with costs; a word known `elsewhere` is no typo."""
        if len(word) > self.longest + 3:  # beyond any edit distance allowed
            return {}
        if not elsewhere and (found := self.word_cache.get(word)) is not None:
            return found
        out: dict[str, float] = {}
        exact = word in self.having
        if exact:
            out[word] = 0.0
        elif word.isalpha() and word not in elsewhere:
            seen = set()
            for d in deletes(word, max(allowed(len(word)), 1)):
                for w in self.index.get(d, ()):
                    if w in seen or not w.isalpha():
                        continue
                    seen.add(w)
                    cost = distance(word, w, 3.0)
                    least, most = min(len(w), len(word)), max(len(w), len(word))
                    if cost <= (NEAR - 0.05 if least <= 3 else 1.0 if least == 4 else 1.9 if most <= 5 else 2.0 if least <= 12 else 2.7):
                        out[w] = 0.15 * cost + 0.02 * max(0, 8 - len(w)) * cost
        for w in self.short.get(word, ()):
            if w in self.having:
                out[w] = min(0.05, out.get(w, 9.0))
        if word.isalpha() and len(word) >= 2:
            at = bisect_left(self.vocabulary, word)
            while at < len(self.vocabulary) and (w := self.vocabulary[at]).startswith(word):
                if len(w) > len(word) + 1 and len(word) >= (3 if len(w) < 6 else 2):
                    out[w] = min(0.08 if len(word) >= 3 else 0.2, out.get(w, 9.0))
                at += 1
            if len(word) >= 4 and not exact and word not in elsewhere:
                for d in deletes(word, 1):
                    for p, w in self.prefixes.get(d, ()):
                        if len(w) > len(word) + 1 and p[0] == word[0] and out.get(w, 9.0) > 0.3 and abs(len(p) - len(word)) <= 1 and distance(word, p, 1.0) <= 1.0:
                            out[w] = 0.3
        if not elsewhere:
            if len(self.word_cache) > 200_000:
                self.word_cache.clear()
            self.word_cache[word] = out
        return out

    def score(self, label: list[str], entry: Entry, elsewhere: Collection[str] = ()) -> float:
        """Cost of reading the label's words as the entry; beyond the bound perhaps a lower bound of it."""
        have = entry.words
        core = [w for w in label if w not in self.remarks or w in have]
        if not core:
            return 9.0
        gap = [self.missing(w) for w in have]
        spare = [self.extra(w) for w in core]
        table, low = [], 0.0
        best = list(gap)
        for word, loose in zip(core, spare):
            near = self.near(word, elsewhere)
            first = word[0] if len(word) == 1 and word not in JOINERS else None
            row, least = [], loose
            for j, w in enumerate(have):
                c = near.get(w)
                if c is None and first and len(w) > 3 and w[0] == first:
                    c = 0.35
                alone = gap[j] + loose
                if c is None or c > alone:
                    c = alone
                else:
                    least = min(least, c)
                    best[j] = min(best[j], c)
                row.append(c)
            low += least
            table.append(row)
        # Each word costs its cheapest partner at least; most candidates fall here.
        if (low := max(low, sum(best))) > self.bound:
            return low
        if len(core) > len(have):
            table = [list(column) for column in zip(*table)]
            total, where = assign(table)
            return total + sum(spare) - sum(spare[i] for i in where)
        total, where = assign(table)
        return total + sum(gap) - sum(gap[j] for j in where)

    def missing(self, w: str) -> float:
        """Cost of a word of the entry that the label lacks."""
        return SLIGHT if w in JOINERS else MISSING

    def extra(self, word: str) -> float:
        """Cost of a word of the label that the entry doesn't have."""
        if word in JOINERS:
            return SLIGHT
        if word in self.remarks or word.isdigit() and len(word) == 1:
            return NOTE
        if (found := self.extras.get(word)) is None:
            if len(self.extras) > 200_000:
                self.extras.clear()
            close = 5 <= len(word) <= self.longest_remark + 4 and any(distance(word, n, 2.0) <= min(2.0, allowed(len(n))) for n in set().union(*(self.remark_index.get(d, ()) for d in deletes(word, 2))))
            found = self.extras[word] = 0.1 if close else EXTRA
        return found

    def map(self, text: str, elsewhere: Collection[str] = ()) -> tuple[str, float, int]:
        """(concept or `unmatched`, cost, frequency of the entry) of a label."""
        label = words(text)
        key = tuple(label)
        if not elsewhere and (found := self.cache.get(key)) is not None:
            return found
        candidates: set[int] = set()
        for w in set(label):
            for v in self.near(w, elsewhere):
                if v not in JOINERS:
                    candidates.update(self.having[v])
        best: dict[str, tuple[float, int]] = {}

        def offer(entry: Entry, cost: float):
            if cost <= self.bound:
                best[entry.concept] = min(best.get(entry.concept, (9.0, 0)), (cost, -entry.frequency))

        # Words that mean something cost EXTRA each where an entry lacks them, so a label of many more words
        # than any candidate is beyond the bound without an alignment.
        weighty = sum(1 for w in label if self.extra(w) >= EXTRA)
        for i in candidates:
            if (weighty - len(self.entries[i].words)) * EXTRA <= self.bound:
                offer(self.entries[i], self.score(label, self.entries[i], elsewhere))
        parts = [w for w in label if w not in JOINERS and w not in self.remarks]
        joined = "".join(parts)
        if 5 <= len(joined) <= self.longest_whole + 1:
            for d in deletes(joined, 1):
                for target, i in self.whole.get(d, ()):
                    core = [x for x in self.entries[i].words if x not in JOINERS]
                    # only for words run together or torn apart; others are judged word by word
                    if len(core) != len(parts) and (cost := distance(joined, target, 2.0)) <= 1.0 and not any(c.isdigit() for c in joined + target):
                        offer(self.entries[i], 0.2 * cost)
        out = min(((c, f, k) for k, (c, f) in best.items()), default=None)
        result = (out[2], out[0], -out[1]) if out else (UNMATCHED, 9.0, 0)
        if not elsewhere:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[key] = result
        return result


def entry_table(concepts: DataFrame) -> DataFrame:
    """(text, concept, frequency) of each display name and alias of the catalogue."""
    names = F.array_union(F.array("display_name"), F.coalesce("observed_aliases", F.expr("cast(array() as array<string>)")))
    flat = concepts.select(F.explode(names).alias("text"), F.col("concept_id").alias("concept"), F.coalesce("observed_occurrence_count", F.lit(0)).alias("frequency"))
    return flat.where("text is not null and concept is not null")


RESULT = "__label string, concept string, cost double, frequency int"


def _lookup(labels: DataFrame, entries: list[tuple[str, str, int]], bound: float, lists: dict) -> DataFrame:
    """(__label, n, concept, cost) of different labels, by one list that is sent to the executors once."""
    shared = labels.sparkSession.sparkContext.broadcast(entries)

    @F.pandas_udf("struct<concept:string,cost:double>")
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        canon = Canon(shared.value, bound, **lists)
        for texts in batches:
            done = [canon.map(t) for t in texts]
            yield pd.DataFrame({"concept": [d[0] for d in done], "cost": [d[1] for d in done]})

    return spread(labels).select("__label", "n", lookup("__label").alias("m")).select("__label", "n", "m.concept", "m.cost")


def _lookup_blocks(labels: DataFrame, entries: DataFrame, count: int, bound: float, lists: dict, block: int) -> DataFrame:
    """The same for longer lists: every label meets every block of the list, and the cheapest answer of all counts.

    A word that stands in any block is no typo in the others, so the words of the labels first meet
    those of the whole list. Labels are salted, so a group holds a block and a bounded part of the labels.
    """
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    blocks = -(-count // block)
    salts = max(1, -(-labels.count() // block))
    spelled = labels.select("__label", F.explode(F.array_distinct(split("__label"))).alias("w"))
    there = entries.select(F.explode(split("text")).alias("w")).distinct()
    known = spelled.join(there, "w", "left_semi").groupBy("__label").agg(F.collect_set("w").alias("known"))
    left = labels.join(known, "__label", "left").select("__label", F.coalesce("known", F.expr("cast(array() as array<string>)")).alias("known"), F.pmod(F.xxhash64("__label"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = entries.select("text", "concept", F.col("frequency").cast("int"), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        canon = Canon(zip(b["text"], b["concept"], b["frequency"]), bound, **lists)
        rows = [(t, *canon.map(t, set(k) - canon.having.keys())) for t, k in zip(a["__label"], a["known"])]
        return pd.DataFrame(rows, columns=["__label", "concept", "cost", "frequency"])

    found = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInPandas(run, RESULT)
    best = found.groupBy("__label").agg(F.min(F.struct("cost", (-F.col("frequency")).alias("f"), "concept")).alias("b"))
    return labels.join(best, "__label").select("__label", "n", "b.concept", "b.cost")


def canonicalize(df: DataFrame, label: str, entries: DataFrame, bound: float = 0.75, name: str = "concept_id", notes: Collection[str] = NOTES, short: Mapping[str, tuple[str, ...]] = SHORT, block: int = BLOCK) -> DataFrame:
    """Adds `name` (a concept, or `unmatched`) and `match_cost` for each row.

    `entries` has the columns text, concept, frequency. NULL and blank labels give NULLs in both. Every
    row is kept, repeated ones too; other columns are kept, but for those named like the added ones. A list of
    more than `block` entries is searched in blocks, with the same answers.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in (name, "match_cost")]
    rows = df.select(*kept, F.col(label).alias("__label"))
    there = F.col("__label").rlike(r"[^\s]")
    labels = rows.where(there).groupBy("__label").agg(F.count("*").alias("n"))
    lists = {"notes": frozenset(notes), "short": dict(short)}
    first = entries.limit(block + 1).collect()
    if len(first) <= block:
        mapped = _lookup(labels, [(r["text"], r["concept"], r["frequency"]) for r in first], bound, lists)
    else:
        entries = cut(entries.distinct())
        mapped = _lookup_blocks(cut(labels), entries, entries.count(), bound, lists, block)
    mapped = cut(mapped.select("__label", "n", F.col("concept").alias(name), F.col("cost").alias("match_cost")))
    total = mapped.agg(F.sum("n")).first()[0] or 0
    out = [*kept, name, "match_cost"]
    hot = F.broadcast(mapped.where(F.col("n") * HOT_SHARE >= total).drop("n"))  # at most HOT_SHARE rows, as their shares add up to one
    cold = mapped.where(F.col("n") * HOT_SHARE < total).drop("n")
    named = rows.where(there)
    blank = rows.where(~F.coalesce(there, F.lit(False))).select(*kept, F.lit(None).cast("string").alias(name), F.lit(None).cast("double").alias("match_cost"))
    return named.join(hot, "__label").select(*out).unionByName(named.join(hot, "__label", "left_anti").join(cold, "__label").select(*out)).unionByName(blank)


def p1_found(exams: DataFrame, concepts: DataFrame) -> DataFrame:
    """(entry_id, concept_id) of each entry whose label is no name of the catalogue as it stands."""
    entries = entry_table(concepts)
    rest = exams.select("entry_id", "entered_label").where(F.col("entered_label").rlike(r"[^\s]")).join(entries.select(F.col("text").alias("entered_label")).distinct(), "entered_label", "left_anti")
    return canonicalize(rest, "entered_label", entries).select("entry_id", "concept_id")
