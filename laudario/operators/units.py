"""Quantities recorded in different units, brought to one unit for each field.

A unit string is segmented by dynamic programming over three tries (prefixes, roots, exponents) plus
numbers and separators. Every full segmentation is a reading with a cost: spellings in another letter
case cost more than exact ones, prefixes that laboratories hardly use cost more than common ones, and
a reading whose dimension fits the field (the concept's common unit) is preferred to one that does
not. The cheapest reading decides. ``MG/DL`` thus is milligrams and not megagrams for a mass field,
``K/µL`` thousands of cells and not kelvin.

Rows stay in the JVM: values and unit texts are cut out by regular expressions, one Arrow column
carries the texts to the segmenter, which keeps a bounded cache, and the factor comes back as a double and
as a fraction, so that values are rounded exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laudario.session import small_side

# Prefixes as (spelling, power of ten, cost of the reading).
PREFIXES = (
    ("m", -3, 0.0), ("mili", -3, 0.0), ("milli", -3, 0.0),
    ("µ", -6, 0.0), ("u", -6, 0.2), ("mc", -6, 0.1), ("micro", -6, 0.0),
    ("n", -9, 0.0), ("nano", -9, 0.0), ("p", -12, 0.0), ("pico", -12, 0.0), ("f", -15, 0.2), ("femto", -15, 0.2),
    ("d", -1, 0.0), ("deci", -1, 0.0), ("c", -2, 0.2), ("centi", -2, 0.2),
    ("k", 3, 0.6), ("quilo", 3, 0.3), ("kilo", 3, 0.3), ("M", 6, 3.0), ("mega", 6, 2.0), ("G", 9, 3.0), ("giga", 9, 2.0),
)
# Roots as (spelling, dimension, size in base units, cost). Base units: g, mol, U, count, m, s.
ROOTS = (
    ("g", "mass", Fraction(1), 0.0), ("gr", "mass", Fraction(1), 0.1), ("grama", "mass", Fraction(1), 0.0), ("gramas", "mass", Fraction(1), 0.0),
    ("mol", "amount", Fraction(1), 0.0), ("mols", "amount", Fraction(1), 0.1), ("mole", "amount", Fraction(1), 0.1), ("moles", "amount", Fraction(1), 0.1), ("M", "molarity", Fraction(1), 2.0),
    ("Eq", "equivalent", Fraction(1), 0.0), ("equivalente", "equivalent", Fraction(1), 0.1), ("equivalentes", "equivalent", Fraction(1), 0.1),
    ("U", "activity", Fraction(1), 0.0), ("UI", "activity", Fraction(1), 0.0), ("IU", "activity", Fraction(1), 0.0), ("unidade", "activity", Fraction(1), 0.1), ("unidades", "activity", Fraction(1), 0.1),
    ("kat", "activity", Fraction(60_000_000), 0.0),
    ("L", "volume", Fraction(1, 1000), 0.0), ("litro", "volume", Fraction(1, 1000), 0.0), ("litros", "volume", Fraction(1, 1000), 0.0),
    ("m", "length", Fraction(1), 0.1),
    ("h", "time", Fraction(3600), 0.0), ("hora", "time", Fraction(3600), 0.0), ("horas", "time", Fraction(3600), 0.0),
    ("s", "time", Fraction(1), 0.0), ("seg", "time", Fraction(1), 0.0), ("segundo", "time", Fraction(1), 0.0), ("segundos", "time", Fraction(1), 0.0),
    ("min", "time", Fraction(60), 0.0), ("minuto", "time", Fraction(60), 0.0), ("minutos", "time", Fraction(60), 0.0), ("dia", "time", Fraction(86400), 0.0), ("dias", "time", Fraction(86400), 0.0),
    ("K", "count", Fraction(1000), 0.3), ("mil", "count", Fraction(1000), 0.2), ("milhares", "count", Fraction(1000), 0.0),
    ("milhões", "count", Fraction(1_000_000), 0.0), ("milhoes", "count", Fraction(1_000_000), 0.0),
    ("células", "count", Fraction(1), 0.0), ("celulas", "count", Fraction(1), 0.0), ("cél", "count", Fraction(1), 0.0), ("cel", "count", Fraction(1), 0.0),
)
# Exponents.
EXPONENTS = (("³", 3), ("^3", 3), ("3", 3), ("²", 2), ("^2", 2), ("2", 2))
# Superscript digits of multipliers such as 10³ and 10⁹.
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")

POWERS = 12  # the exponents of a unit, all taken together, are no more; kg·m²/s³ has six
NOT_CASE = 0.35  # cost of a spelling in another letter case
FITS, CONVERTS, FOREIGN = 0.0, 0.5, 6.0  # prior costs of a reading's dimension for the field


def _trie(entries) -> dict:
    """Letter trie; at its nodes, under the empty key, the entries as (spelling, values)."""
    root: dict = {}
    for spelling, *values in entries:
        node = root
        for letter in spelling.lower():
            node = node.setdefault(letter, {})
        node.setdefault("", []).append((spelling, *values))
    return root


_PREFIX_TRIE, _ROOT_TRIE, _EXPONENT_TRIE = _trie(PREFIXES), _trie(ROOTS), _trie(EXPONENTS)
_MULTIPLIER = re.compile(r"[x×*]?\s*10(?:\^|\*\*?)?([⁰¹²³⁴⁵⁶⁷⁸⁹]+|\d{1,2})\s*")
_NUMBER = re.compile(r"\d{1,18}(?!\d)(?:[.,]\d{1,18}(?!\d))?\s*")
_SEPARATOR = re.compile(r"\s*(?:/|\bpor\b|\bper\b)\s*", re.I)


def _walk(trie: dict, text: str, at: int):
    """Entries of the trie that start at `at`, as (end, cost of the letter case, values)."""
    node, i = trie, at
    while i < len(text):
        node = node.get(text[i].lower())
        if node is None:
            return
        i += 1
        for spelling, *values in node.get("", ()):
            yield i, (0.0 if text[at:i] == spelling else NOT_CASE), values


@dataclass(frozen=True)
class Reading:
    """One segmentation: its dimension as sorted (base, power) pairs, its size in base units, its cost."""

    dimension: tuple
    size: Fraction
    cost: float


def _grown(dimension: tuple, base: str, power: int) -> tuple:
    """The dimension, as sorted (base, power) pairs, times a power of a base; counts have no dimension, volumes are cubed lengths."""
    if base == "count":
        return dimension
    if base == "volume":
        base, power = "length", 3 * power
    total = dict(dimension)
    total[base] = total.get(base, 0) + power
    return tuple(sorted((b, p) for b, p in total.items() if p))


def _segments(text: str) -> list[str]:
    """The text, then what is outside its brackets, inside them, and between its commas."""
    s = re.sub(r"\s+", " ", text.replace("μ", "µ").strip()).strip("[] ")
    out = [s]
    if "(" in s:
        out += [re.sub(r"\([^()]*\)", " ", s), *re.findall(r"\(([^()]*)\)", s)]
    if re.search(r"[,;](?!\d)", s):
        out += [p for o in list(out) for p in re.split(r"[,;](?!\d)", o)]
    return [o for o in dict.fromkeys(o.strip() for o in out) if o]


@lru_cache(maxsize=65_536)
def readings(text: str) -> tuple[Reading, ...]:
    """All segmentations of a unit string, cheapest first; none if it is no unit.

    A unit with a remark in brackets or after a comma is read without it. Texts of any length are read: on
    ordinary words the table of the dynamic program runs empty at once.
    """
    for segment in _segments(text):
        if found := _read(segment):
            return found
    return ()


def _read(s: str) -> tuple[Reading, ...]:
    """The table holds, for each position and side of the last separator, the partial readings with different results."""
    if s.endswith("%"):
        if s == "%":
            return (Reading((("percent", 1),), Fraction(1), 0.0),)
        s = s[:-1].strip() + "/100 mL"
    # state: (position, side, has a factor on this side) -> {(dimension, size, exponents used): cost}
    table: dict[tuple, dict] = {(0, 1, False): {((), Fraction(1), 0): 0.0}}
    done: dict[tuple, float] = {}
    ahead = 0

    def put(state, dimension, size, used, cost):
        nonlocal ahead
        ahead = max(ahead, state[0])
        cell = table.setdefault(state, {})
        if used <= POWERS and cost < cell.get((dimension, size, used), 1e9):
            cell[(dimension, size, used)] = cost

    for at in range(len(s) + 1):
        if at > ahead:
            break
        for side in (1, -1):
            for has in (False, True):
                cell = table.pop((at, side, has), None)
                if not cell:
                    continue
                separator, multiplier, numeral = _SEPARATOR.match(s, at), None, None
                if not has:
                    multiplier, numeral = (_MULTIPLIER.match(s, at) if side == 1 else None), _NUMBER.match(s, at)
                for (dimension, size, used), cost in cell.items():
                    if at == len(s):
                        if has:
                            done[(dimension, size)] = min(cost, done.get((dimension, size), 1e9))
                        continue
                    if s[at] == " ":
                        put((at + 1, side, has), dimension, size, used, cost)
                    if separator and (has or side == 1 and not s[:at].strip()):
                        put((separator.end(), -1, False), dimension, size, used, cost)
                    if multiplier:
                        put((multiplier.end(), side, True), dimension, size * 10 ** int(multiplier[1].translate(SUPERSCRIPTS)), used, cost)
                    if numeral and (number := Fraction(numeral[0].strip().replace(",", "."))):
                        put((numeral.end(), side, False), dimension, size * number**side, used, cost)
                    starts = [(at, 0, 0.0)]
                    for end, case, (power, rare) in _walk(_PREFIX_TRIE, s, at):
                        starts.append((end, power, case + rare))
                    for begin, power, before in starts:
                        for end, case, (base, unit, rare) in _walk(_ROOT_TRIE, s, begin):
                            powers = [(end, 1)] + [(e, p) for e, _, (p,) in _walk(_EXPONENT_TRIE, s, end)]
                            for stop, exponent in powers:
                                if stop < len(s) and s[stop].isalpha() and s[stop - 1].isalpha():
                                    continue
                                if base == "molarity":
                                    grown = _grown(_grown(dimension, "amount", side), "volume", -side)
                                    value = (unit * 1000 * Fraction(10) ** power) ** side
                                else:
                                    grown = _grown(dimension, base, side * exponent)
                                    value = (unit * Fraction(10) ** power) ** (side * exponent)
                                put((stop, side, True), grown, size * value, used + exponent, cost + before + case + rare)
    found = [Reading(d, z, c) for (d, z), c in done.items()]
    return tuple(sorted(found, key=lambda r: (r.cost, str(r.dimension), r.size)))


#: Concepts whose equivalents are moles (fixed values: charge one).
MONOVALENT = ("lab.sodio", "lab.potassio", "lab.cloreto")


def conversion(text: str | None, concept: str | None, common: str | None, grams_per_mole: float | None) -> Fraction | None:
    """Factor from the unit named by `text` to the field's common unit; None if the text names no unit that converts."""
    if not text or not common:
        return None
    target = readings(common)
    if not target:
        return None
    goal = target[0]
    best: tuple[float, Fraction] | None = None
    molar = Fraction(str(grams_per_mole)) if grams_per_mole else None
    for r in readings(text):
        size, dimension, prior = r.size, r.dimension, FITS
        if dimension != goal.dimension:
            prior = CONVERTS
            swapped = dict(dimension)
            wanted = dict(goal.dimension)
            if concept in MONOVALENT:
                if "equivalent" in swapped:
                    swapped["amount"] = swapped.pop("equivalent")
                if "equivalent" in wanted:
                    wanted["amount"] = wanted.pop("equivalent")
            if swapped != wanted and molar:
                if swapped.get("amount") == 1 and wanted.get("mass") == 1:
                    swapped["mass"] = swapped.pop("amount")
                    size *= molar
                elif swapped.get("mass") == 1 and wanted.get("amount") == 1:
                    swapped["amount"] = swapped.pop("mass")
                    size /= molar
            if swapped != wanted:
                continue
        factor = size / goal.size
        total = r.cost + prior
        if best is None or total < best[0]:
            best = (total, factor)
    return best[1] if best else None


def number(text: Column) -> Column:
    """A Brazilian or international number as DECIMAL(28,10), NULL if there is none.

    A comparison sign is ignored. A point followed by exactly three digits separates thousands; any
    other point or comma is decimal.
    """
    digits = F.regexp_extract(text, r"^\s*[<>≤≥=~±]*\s*(-?\d[\d.,]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(digits, r"[.,]+$", ""), r"\.(?=\d{3}(?!\d))", "")
    return F.regexp_replace(plain, ",", ".").try_cast("decimal(28,10)")


def _tail(text: Column) -> Column:
    """What follows the leading number of a value."""
    return F.trim(F.regexp_replace(text, r"^\s*[<>≤≥=~±]*\s*-?\d[\d.,]*\s*", ""))


def common_units(concepts: DataFrame, molar_mass: DataFrame | None = None) -> DataFrame:
    """Catalogue of concept_id, common_unit (the first observed unit) and grams_per_mole."""
    base = concepts.select("concept_id", F.get("observed_units", F.lit(0)).alias("common_unit")).dropDuplicates(["concept_id"])
    if molar_mass is None:
        return base.withColumn("grams_per_mole", F.lit(None).cast("double"))
    return base.join(molar_mass.select("concept_id", "grams_per_mole").dropDuplicates(["concept_id"]), "concept_id", "left")


_GLUE = "\x1f"


FACTOR = T.StructType([T.StructField("factor", T.DoubleType()), T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
_EXACT = 10**12  # numerators and denominators from here on are kept as doubles only


def convert(df: DataFrame, *, concept: str, value: str, places: list[Column], catalogue: DataFrame, numeric: str | None = None) -> DataFrame:
    """Adds `unit_factor` (DOUBLE, to the common unit), `common_value` (DOUBLE) and `common_centi` (BIGINT, hundredths, half up).

    `places` are further texts that may state the unit, most trusted first; the text after the number
    in `value` comes before all of them. The first place that names a unit counts. `unit_factor` is
    NULL where no place states a unit of the field; the values are then NULL, too. Rows with a NULL
    or unknown concept, a NULL or blank value, or a value without a number get NULLs; `numeric`, if
    given, is used where the value has no number. Repeated rows are kept, other columns are untouched.
    The catalogue is joined: by broadcast if its rows are counted to be few, by a shuffle otherwise.
    """

    @F.pandas_udf(FACTOR)
    def factor(keys: pd.Series) -> pd.DataFrame:
        seen: dict = {None: (None, None, None)}
        for key in keys.unique():
            out = (None, None, None)
            if key is not None:
                name, common, mass, *texts = key.split(_GLUE)
                for text in texts:
                    found = conversion(text, name, common, float(mass) if mass else None) if text else None
                    if found is not None:
                        exact = found.numerator < _EXACT and found.denominator < _EXACT
                        out = (float(found), found.numerator if exact else None, found.denominator if exact else None)
                        break
            seen[key] = out
        rows = [seen[k] for k in keys]
        return pd.DataFrame({"factor": pd.array([r[0] for r in rows], "Float64"), "num": pd.array([r[1] for r in rows], "Int64"), "den": pd.array([r[2] for r in rows], "Int64")})

    from pyspark.sql.functions import coalesce, concat_ws, lit

    kept = [c for c in df.columns if c not in ("unit_factor", "common_value", "common_centi")]
    fields = catalogue.where("concept_id is not null and common_unit is not null").select(F.col("concept_id").alias("__concept"), F.col("common_unit").alias("__common"), F.col("grams_per_mole").cast("string").alias("__mass"))
    joined = df.join(small_side(fields), F.col(concept) == F.col("__concept"), "left")
    texts = [coalesce(F.trim(p), lit("")) for p in (_tail(F.col(value)), *places)]
    key = F.when(F.col("__concept").isNotNull(), concat_ws(_GLUE, F.col("__concept"), F.col("__common"), coalesce("__mass", lit("")), *texts))
    amount = number(F.col(value))
    if numeric:
        amount = coalesce(amount, F.col(numeric).cast("decimal(28,10)"))
    done = joined.withColumn("__f", factor(key)).withColumn("__v", amount)
    exact = F.expr("sign(__v) * ((200 * abs(try_cast(__v as decimal(20,10))) * cast(__f.num as decimal(12,0)) + cast(__f.den as decimal(12,0))) div (2 * cast(__f.den as decimal(12,0))))").cast("bigint")
    common = F.col("__v").cast("double") * F.col("__f.factor")
    return done.select(*kept, F.col("__f.factor").alias("unit_factor"), common.alias("common_value"), coalesce(exact, F.floor(common * 100 + 0.5).cast("bigint")).alias("common_centi"))


def label_unit(label: Column) -> Column:
    """The last part of a label that may be a unit: after `em`, after ` - `, or in brackets."""
    return F.regexp_extract(label, r"(?:\sem\s+|\s-\s+|\()([^()]+)\)?\s*$", 1)


def reference_unit(reference: Column) -> Column:
    """What follows the last number of a reference range; a unit may itself begin with a number."""
    return F.regexp_extract(reference, r"\d[\d.,]*\s*(?:a|-|–|até)\s*\d[\d.,]*\s*(\S.*)$", 1)


def other_sized(df: DataFrame, key: str) -> DataFrame:
    """One row (record_id, value_centi) for each key whose unit has another size than the common unit.

    The value is rounded half up to hundredths; a repeated key counts once. Rows without a number, or
    without a stated unit, or without a key are left out.
    """
    return (
        df.where(F.col("unit_factor").isNotNull() & (F.abs(F.col("unit_factor") - 1) > 1e-9) & F.col("common_value").isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("record_id")).agg(F.min("common_centi").alias("value_centi"))
    )


def p2_found(observations: DataFrame, derived: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Values of lab_observation and derived_input stated in a unit of another size, in common units."""
    seen = convert(
        observations.select("observation_id", "concept_id", "raw_value", "numeric_value", "raw_unit", "label", "reference_text"),
        concept="concept_id", value="raw_value", numeric="numeric_value",
        places=[F.col("raw_unit"), label_unit(F.col("label")), reference_unit(F.col("reference_text"))], catalogue=catalogue,
    )
    made = convert(
        derived.select("derived_observation_id", "raw_creatinine_value", "numeric_creatinine_value", "raw_creatinine_unit").withColumn("concept_id", F.lit("lab.creatinina")),
        concept="concept_id", value="raw_creatinine_value", numeric="numeric_creatinine_value", places=[F.col("raw_creatinine_unit")], catalogue=catalogue,
    )
    return other_sized(seen, "observation_id").unionByName(other_sized(made, "derived_observation_id"))


def unread(df: DataFrame, *, concept: str, value: str, unit: str, catalogue: DataFrame) -> DataFrame:
    """(concept_id, unit_text, rows): unit texts beside a value, or after it, that no reading of the concept's field explains."""
    text = F.coalesce(F.nullif(F.trim(unit), F.lit("")), F.nullif(_tail(F.col(value)), F.lit("")))
    stated = df.select(F.col(concept).alias("concept_id"), text.alias("unit_text")).where("unit_text is not null").groupBy("concept_id", "unit_text").agg(F.count("*").alias("rows"))
    read = convert(stated.withColumn("one", F.lit("1")), concept="concept_id", value="one", places=[F.col("unit_text")], catalogue=catalogue)
    return read.where("unit_factor is null").select("concept_id", "unit_text", "rows")
