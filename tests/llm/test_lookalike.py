import random
import unicodedata

from laudario.llm import lookalike as L


def test_fold():
    assert L.fold("Ｒｅｓｕｌｔａｄｏ： １，４") == "Resultado: 1,4"
    assert L.fold("re​sul­tado ﬁm") == "resultado fim"
    assert L.fold(unicodedata.normalize("NFD", "requisição")) == "requisição"
    assert L.fold("µ ² ³ ª º ≥") == "µ ² ³ ª º ≥"
    assert L.fold("a‐b") == "a-b"


def test_scripts():
    assert L.dominant("Dаta") == "LATIN"
    assert L.latin_reading("ЅОRΟ") == "SORO"
    assert L.latin_reading("жук") is None
    assert L.latin_reading(unicodedata.normalize("NFD", "Anа́lisе")) == "Análise"


def run(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, text string")
    return {r.k: r for r in L.repair(df, ["k"], "text", df).collect()}


def test_repair_uses_the_vocabulary(spark):
    out = run(spark, [(1, "Setor de soro"), (2, "Ѕetor dе sоro"), (3, "Ѕeqor"), (4, None), (5, ""), (6, "жук"), (2, "Ѕetor dе sоro"), (7, "soro​ " * 3000)])
    assert set(out) == {2, 3, 6, 7}
    assert (out[2].repaired, out[2].residual) == ("Setor de soro", False)
    assert (out[3].repaired, out[3].residual) == ("Ѕeqor", True)
    assert (out[6].repaired, out[6].residual) == ("жук", True)
    assert out[7].repaired == "soro " * 3000


def test_found_and_empty(spark):
    lines = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "ção µ²"), (4, "ça"), (5, "μ")], "line_key bigint, original_text string")
    words = spark.createDataFrame([], "word_key bigint, text string")
    glyphs = spark.createDataFrame([(1, None)], "glyph_key bigint, text string")
    assert sorted(tuple(r) for r in L.p4_found(lines, words, glyphs).collect()) == [("sanitized_line", 2), ("sanitized_line", 4), ("sanitized_line", 5)]
    assert L.p4_found(lines.limit(0), words, glyphs).count() == 0


def test_wholly_foreign_tokens_are_repaired_amid_latin_text_only(spark):
    out = run(spark, [(1, "sexo de soro"), (2, "Ѕехо de soro"), (3, "Ѕехо жук дым"), (4, "Ѕехо"), (5, "ѕorо жук дым"), (6, "Ѕехо Ѕехо de soro жук")])
    assert {k: r.repaired for k, r in out.items()} == {2: "Sexo de soro", 3: "Ѕехо жук дым", 4: "Sexo", 5: "soro жук дым", 6: "Sexo Sexo de soro жук"}
    assert out[3].residual and not out[4].residual


def test_mixed_tokens_are_candidates_whatever_dominates_them():
    assert L.dominant("Ѕехo") == "CYRILLIC" and L.dominant("Sехo") == "LATIN"
    assert [p[2] for p in L.pieces("жук Ѕехo Sеxo")[1]] == ["Sexo", "Sexo"]
    assert L.pieces("ρ жук дым")[1] == []  # foreign as a whole, in a foreign text


def test_planted_look_alikes_are_repaired(spark):
    """Letters of ordinary lines of the test data are replaced by look-alikes; nine tenths at least come back."""
    rng = random.Random(9)
    looks = {}
    for strange, plain in L.LOOKS.items():
        looks.setdefault(plain, []).append(strange)
    lines = sorted({r.original_text for r in spark.read.parquet("/root/testdata/sf0.001/sanitized_line.parquet").where("original_text is not null").collect() if not L.re.search(L.STRANGE, r.original_text)})
    rows, want = [], {}
    for k, line in enumerate(lines):
        rows.append((2 * k, line))
        planted = "".join(rng.choice(looks[c]) if c in looks and rng.random() < 0.3 else c for c in line)
        planted = planted.replace(" ", "\u00a0", 1) if rng.random() < 0.3 else planted
        if planted != line:
            rows.append((2 * k + 1, planted))
            want[2 * k + 1] = line
    out = run(spark, rows)
    assert set(out) == set(want) and len(want) > 300
    assert sum(out[k].repaired == want[k] for k in want) >= 0.9 * len(want)
