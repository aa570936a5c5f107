from fractions import Fraction

import pytest

from laudario.operators import units as U

MASS = ("mg/dL", 113.12)


@pytest.mark.parametrize(
    "text,common,mass,want",
    [
        ("MG/DL", "mg/dL", None, "1"), ("mg%", "mg/dL", None, "1"), ("mg/100 mL", "mg/dL", None, "1"), ("mg / L", "mg/dL", None, "1/10"), ("gr/L", "g/dL", None, "1/10"), ("µg/mL", "mg/L", None, "1"), ("mcg/dL", "ng/mL", None, "10"),
        ("µkat/L", "U/L", None, "60"), ("UI/L", "U/L", None, "1"), ("10³/µL", "/mm³", None, "1000"), ("x10^9/L", "/mm³", None, "1000"), ("K/µL", "/mm³", None, "1000"), ("mil/mm³", "/mm³", None, "1000"), ("por mm³", "/mm³", None, "1"),
        ("mUI/L", "µUI/mL", None, "1"), ("MMOL/L", "mg/dL", 113.12, "1414/125"), ("milimol/L", "mg/dL", 113.12, "1414/125"), ("mg/dL", "mmol/L", 100.0, "1/10"), ("%", "%", None, "1"),
    ],
)
def test_conversions(text, common, mass, want):
    assert U.conversion(text, "x", common, mass) == Fraction(want)


@pytest.mark.parametrize("text", ["TSH", "HBA1C", "", None, "T4 livre", "mg", "mg/dL/dL/dL", "z" * 5000, "mmol/L"])
def test_no_unit_of_the_field(text):
    assert U.conversion(text, "x", "mg/dL", None) is None


def test_equivalents_are_moles_for_charge_one_only():
    assert U.conversion("mmol/L", "lab.sodio", "mEq/L", None) == 1
    assert U.conversion("mmol/L", "lab.calcio-total", "mEq/L", None) is None


def brute(text):
    """Every split of a simple unit into prefix, root and exponent, tried one by one."""
    out = set()
    for prefix, power, _ in U.PREFIXES + (("", 0, 0),):
        for root, base, size, _ in U.ROOTS:
            for exponent, p in U.EXPONENTS + (("", 1),):
                if (prefix + root + exponent).lower() == text.lower() and base not in ("count", "molarity"):
                    out.add((U._grown((), base, p), (size * Fraction(10) ** power) ** p))
    return out


def test_segmentation_matches_brute_force():
    for prefix, *_ in U.PREFIXES:
        for root, base, *_ in U.ROOTS:
            if base not in ("count", "molarity"):
                got = {(r.dimension, r.size) for r in U.readings(prefix + root)}
                assert brute(prefix + root) <= got, prefix + root


def test_numbers(spark):
    from pyspark.sql import functions as F

    rows = [("1.234", 1234.0), ("1.23", 1.23), ("1,234", 1.234), ("<5,00", 5.0), ("> 12.5 mg", 12.5), ("232.000  /mm³", 232000.0), ("1.234.567", 1234567.0), ("NEGATIVO", None), ("", None), (None, None), ("7,", 7.0)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    assert [None if r[0] is None else float(r[0]) for r in df.select(U.number(F.col("t"))).collect()] == [r[1] for r in rows]


def frames(spark):
    catalogue = spark.createDataFrame([("glu", "mg/dL", 180.16), ("none", None, None)], "concept_id string, common_unit string, grams_per_mole double")
    rows = [
        ("a", "glu", "5,5 mmol/L", None, None), ("b", "glu", "5,5", "mmol/L", None), ("c", "glu", "99", "mg/dL", None), ("d", "glu", "99", None, "GLICEMIA (mmol/L)"), ("e", "glu", "99", None, "GLICEMIA (TSH)"),
        ("f", None, "1 mmol/L", None, None), ("g", "none", "1 mmol/L", None, None), ("h", "glu", None, "mmol/L", None), ("i", "glu", "", "mmol/L", None), ("a", "glu", "5,5 mmol/L", None, None), (None, "glu", "1 mmol/L", None, None),
    ]
    return spark.createDataFrame(rows, "id string, concept_id string, raw_value string, raw_unit string, label string"), catalogue


def test_rows(spark):
    from pyspark.sql import functions as F

    df, catalogue = frames(spark)
    df = df.withColumn("unit_factor", F.lit("clash"))
    done = U.convert(df, concept="concept_id", value="raw_value", places=[F.col("raw_unit"), U.label_unit(F.col("label"))], catalogue=catalogue)
    assert done.count() == 11
    found = {r.record_id: r.value_centi for r in U.other_sized(done, "id").collect()}
    assert found == {"a": 9909, "b": 9909, "d": 178358}
    empty = U.convert(df.limit(0), concept="concept_id", value="raw_value", places=[], catalogue=catalogue)
    assert empty.count() == 0


@pytest.mark.parametrize(
    "text,common,want",
    [
        ("mg / dL (miligramas por decilitro, soro)", "g/L", "1/100"), ("micromoles por litro", "mmol/L", "1/1000"), ("ng/mL/h", "µg/L/h", "1"), ("(mg/L)", "mg/dL", "1/10"), ("mg/L, em jejum de pelo menos doze horas e sem esforço", "mg/dL", "1/10"),
        ("coleta em tubo com gel separador e sem garrote (unidade: mg/L)", "mg/dL", None), ("miligramas por 100 mililitros", "mg/dL", "1"), ("kg m2/s3", "g m2/s3", "1000"),
    ],
)
def test_long_and_commented_units(text, common, want):
    assert U.conversion(text, "x", common, None) == (None if want is None else Fraction(want))


def test_texts_of_any_length_end():
    for text in ("m" * 3000, "mg/" * 2000, "10" * 3000, "g m s " * 1000, "((((" * 2000, "1 " * 3000 + "mg/dL", "a, " * 3000):
        U.readings(text)
    assert U.conversion("(" + "muito " * 2000 + ") mg/L", "x", "mg/dL", None) == Fraction(1, 10)


def test_values_are_rounded_exactly(spark):
    from pyspark.sql import functions as F

    catalogue = spark.createDataFrame([("glu", "mg/dL", 180.16)], "concept_id string, common_unit string, grams_per_mole double")
    values = ["0,05", "0,04999999", "0,15", "1234567,85", "-0,05", "999999999999,5", "33,3333333333"]
    df = spark.createDataFrame([(i, "glu", v, "mg/L") for i, v in enumerate(values)], "i int, concept_id string, v string, u string")
    out = {r.i: r.common_centi for r in U.convert(df, concept="concept_id", value="v", places=[F.col("u")], catalogue=catalogue).collect()}
    assert out == {0: 1, 1: 0, 2: 2, 3: 12345679, 4: -1, 5: 9999999999995, 6: 333}


def test_unread_texts_are_reported(spark):
    df, catalogue = frames(spark)
    df = df.unionByName(spark.createDataFrame([("k", "glu", "4", "xyz", None), ("l", "glu", "4", "xyz", None), ("m", "glu", "4 foo", None, None)], df.schema))
    found = {tuple(r) for r in U.unread(df, concept="concept_id", value="raw_value", unit="raw_unit", catalogue=catalogue).collect()}
    assert ("glu", "xyz", 2) in found and ("glu", "foo", 1) in found and not any(c == "glu" and t in ("mmol/L", "mg/dL") for c, t, _ in found)
