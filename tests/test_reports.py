import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from laudario.functions import text as T
from laudario.operators import assemble, curves, derived, project, reconstruct, render, sanitize, semantic
from laudario.plans.pipeline import Pipeline, Stage
from laudario.sources import admission, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, T.normalize_text, "  conﬁrmar :  a\tb ­Sexo....: F ") == "confirmar: a b Sexo: F"
    assert one(spark, T.comparison_key, "  Atenção:  não ") == "ATENCAO: NAO"
    assert one(spark, T.literal_label, " Creatinina ..: 1,2") == "Creatinina"
    assert one(spark, T.literal_label, "Ureia | 30 mg") == "Ureia"
    assert one(spark, T.literal_label, "Nome | Sexo") == "Nome | Sexo"
    assert one(spark, T.normalize_label, "H.C.M (pg)") == "H C M PG"
    assert one(spark, T.result_segment, "A | 3 | 4") == " 3 | 4"
    assert one(spark, T.result_segment, "sem nada") == ""
    for text, want in {"1.234,5": 1234.5, "<5,00": 5.0, "< 5,00": None, "x": None, "": None}.items():
        assert one(spark, T.parse_decimal, text) == want
    assert one(spark, T.normalize_text, None) is None
    assert one(spark, T.compact_number, 1234.125, "double") == "1.234,13"
    assert spark.range(1).select(T.stable_id("patient", F.lit("A"), F.lit(None))).first()[0] == spark.range(1).select(T.stable_id("patient", F.lit("A"), F.lit(""))).first()[0]


def walk(flags):
    """States of abstract lines, one after the other."""
    out, hist, note, long, method = [], False, False, False, False
    for f in flags:
        if f["hist"]:
            hist, note, method = True, False, False
        elif hist and f["boundary"]:
            hist = False
        if hist:
            out.append("History")
            continue
        if f["rule"]:
            note, long, method = True, f["long"], False
        elif note and not long and (f["boundary"] or f["marker"]):
            note = False
        if note:
            out.append("Note")
            continue
        if f["method"]:
            method = f["open"]
            out.append("Method")
        elif f["calc"]:
            out.append("Method")
        elif method and not f["boundary"] and not f["marker"]:
            method = f["open"]
            out.append("Method")
        else:
            method = False
            out.append("Other")
    return out


def test_states_match_a_walk(spark):
    random.seed(7)
    samples = [
        ("Resultados Anteriores: 1", dict(hist=1, boundary=1)), ("NOTA: O USO DE DIPIRONA x", dict(rule=1, boundary=1, marker=1)), ("VALORES HEMATOLOGICOS DE REFERENCIA EM ADULTOS", dict(rule=1, long=1, boundary=1)),
        ("Método: x (aberto", dict(method=1, boundary=1, open=1)), ("Método: fim", dict(method=1, boundary=1)), ("continua (mais", dict(open=1)), ("fecha aqui) e fim", dict()), ("Idade: 40 Sexo: F", dict(calc=1, boundary=1)),
        ("UREIA:", dict(boundary=1)), ("texto comum", dict()), ("nota qualquer", dict(marker=1)),
    ]
    rows, want = [], {}
    for page in range(120):
        picked = [random.choice(samples) for _ in range(random.randint(1, 12))]
        flags = [{k: bool(s[1].get(k)) for k in ("hist", "boundary", "rule", "long", "marker", "method", "open", "calc")} for s in picked]
        for i, (s, state) in enumerate(zip(picked, walk(flags))):
            key = page * 100 + i
            rows.append((key, "d", page, f"l{i:02d}", i, s[0]))
            want[key] = state
    df = spark.createDataFrame(rows, "line_key bigint, document_id string, page_number int, line_id string, source_index int, text string")
    names = {"History": "History", "BoilerplateNote": "Note", "Method": "Method"}
    got = {r.line_key: names.get(r["class"], "Other") for r in sanitize.classify(df).collect()}
    assert got == want


def test_egfr_vectors(spark):
    rows = [("Feminino", 50, 0.7, 105.297601149144), ("Feminino", 50, 1.4, 45.833442997059), ("Masculino", 50, 0.9, 104.049012993225), ("Masculino", 50, 1.8, 45.289963435829), ("Feminino", 78, 2.6, 18.3206085451006)]
    df = spark.createDataFrame(rows, "s string, a int, c double, want double")
    for r in df.select(derived.egfr(F.col("c"), F.col("a"), F.col("s") == "Feminino").alias("v"), "want").collect():
        assert r.v == pytest.approx(r.want, abs=1e-10)


def test_age_on_leap_days(spark):
    df = spark.createDataFrame([(date(2000, 2, 29), date(2001, 2, 28)), (date(2000, 2, 29), date(2001, 2, 27)), (date(1980, 5, 5), date(2026, 5, 4))], "b date, r date")
    assert [r[0] for r in df.select(assemble.age_at(F.col("b"), F.col("r"))).collect()] == [1, 0, 45]


def test_curves_text_and_deltas(spark):
    rows = [(f"o{i}", f"occ{i}", "p", "e", "lab.creatinina", v, n, u, datetime(2025, m, d, h), datetime(2026, 1, 1)) for i, (v, n, u, m, d, h) in enumerate([("1,20", "1.20", "mg/dL", 1, 2, 8), ("1,50", "1.50", "MG / DL", 1, 3, 8), ("1,50", "1.50", "mg/dL", 1, 3, 20), ("<0,9", "0.9", "mg/dL", 1, 4, 8), ("90", "90", "µmol/L", 1, 5, 8), ("0,8", "0.8", "mg/dL", 1, 6, 8)])]
    rows.append(rows[0][:-1] + (datetime(2026, 2, 1),))
    df = spark.createDataFrame(rows, "observation_id string, occurrence_id string, patient_key string, episode_key string, concept_id string, raw_value string, numeric_value string, raw_unit string, requested_at timestamp_ntz, received_at timestamp_ntz").withColumn("numeric_value", F.col("numeric_value").cast("decimal(28,10)")).withColumn("normalized_unit", F.lit(None).cast("string"))
    df = df.withColumn("label", F.lit("CREATININA"))
    out = curves.texts(curves.all_series(df)).orderBy("place", "n").collect()
    assert {r.heading for r in out} == {"#Creatinina (mg/dL):"} and [r.piece for r in out] == ["02/01 - 1,2", "03/01 08:00 - 1,5 (+0,3)", "03/01 20:00 - 1,5 (±0)", "06/01 - 0,8 (-0,7)"]
    years = curves.DateFilter(date(2024, 12, 1), date(2025, 12, 31))
    assert curves.texts(curves.all_series(df, when=years), when=years).orderBy("n").first().piece == "02/01/25 - 1,2"
    assert curves.of_patient(df, "p").count() == 7
    with pytest.raises(ValueError):
        curves.of_patient(df, "nobody")
    assert curves.points(df, curves.DateFilter(days=4, today=date(2025, 1, 6))).count() == 3
    assert curves.points(df, keys=[]).count() == 0
    with pytest.raises(ValueError):
        curves.points(df, keys=["none"])
    with pytest.raises(ValueError):
        curves.DateFilter(start=date(2025, 2, 1), end=date(2025, 1, 1))
    with pytest.raises(ValueError):
        curves.DateFilter(days=0, today=date(2025, 1, 1))


def test_lines_scripts_and_moved_parts():
    def word(i, text, left, bottom, height=8.0, width=None):
        return {"word_id": f"w{i}", "idx": i, "text": text, "left": left, "right": left + (width or 5 * len(text)), "bottom": bottom, "top": bottom + height, "baseline": bottom}

    lines = reconstruct.cluster([word(0, "Nome", 10, 100), word(1, "Paciente", 40, 100.4), word(2, "Sexo", 200, 99.9), word(3, "Data", 10, 80)])
    assert [[w["text"] for w in line] for line in lines] == [["Nome", "Paciente", "Sexo"], ["Data"]]
    lines = [[word(0, "pO", 10, 100, 10)], [word(1, "2", 20.5, 98, 6)]]  # four of its six units beside the line
    assert reconstruct.attach_scripts(lines) == {"w1": ("w0", "subscript")} and len(lines) == 1
    lines = reconstruct.order_lines([[word(0, "TEMPO", 10, 100), word(1, "(TP", 60, 100)], [word(2, "outra", 10, 90)], [word(3, "x)", 10, 80)]])
    assert [w["text"] for w in lines[1]] == ["x)"]
    assert reconstruct.tolerance([]) == 0.75 and reconstruct.tolerance([4, 4]) == 1.0 and reconstruct.tolerance([100]) == 2.5


def test_susceptibility_and_links(spark):
    rows = spark.createDataFrame([("b", "E. coli | S. aureus", "AMICACINA: Sensível | AMICACINA: RESISTENTE"), ("c", "E. coli", "sem")], "block string, organisms string, text string")
    assert sorted(tuple(r) for r in semantic.susceptibility(rows).collect()) == [("b", "E. coli", "AMICACINA", "Sensível", "S"), ("b", "S. aureus", "AMICACINA", "RESISTENTE", "R")]
    cultures = spark.createDataFrame([("e", "c1", "E. COLI"), ("e", "c2", "S. aureus"), ("e", "c3", "S aureus")], "episode_key string, id string, organism string")
    panel = spark.createDataFrame([("e", "p1", "e coli"), ("e", "p2", "S. AUREUS")], "episode_key string, id string, organism string")
    assert [tuple(r) for r in semantic.culture_links(cultures, panel).collect()] == [("e", "p1", "c1")]


def test_ambiguous_alias_is_refused(spark):
    concepts = spark.createDataFrame([("a", "f", "Ureia", []), ("b", "f", "UREIA", [])], "concept_id string, structural_form_id string, display_name string, observed_aliases array<string>")
    with pytest.raises(ValueError):
        semantic.aliases(concepts)


def test_stage_graph():
    with pytest.raises(ValueError):
        Pipeline([Stage("a", ("b",), lambda x: x)])
    p = Pipeline([Stage("a", ("in",), lambda x: x + 1), Stage("b", ("a",), lambda x: x * 2), Stage("c", ("a",), lambda x: -x)], ("in",))
    assert [s.name for s in p.resolve(["b"])] == ["a", "b"]
    assert p.run({"in": 1}, ["b", "c"]) == {"b": 4, "c": -2}
    loop = Pipeline([Stage("a", ("b",), lambda x: x), Stage("b", ("a",), lambda x: x)])
    with pytest.raises(ValueError):
        loop.resolve(["a"])


def test_admission_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "in" / "b.PDF").write_bytes(b"text")
    (tmp_path / "in" / "c.txt").write_bytes(b"%PDF-")
    files = admission.inspect(admission.binary_files(spark, str(tmp_path / "in")))
    assert sorted((r.input_index, r.error) for r in files.collect()) == [(0, None), (1, "NoSignature")]
    assert admission.ledger_rows(files).first().document_id == "failed-0002"
    read = spark.createDataFrame([("doc-1", 0, "Assigned", 3, None)], "document_id string, input_index int, status string, pages bigint, reason string")
    assert sorted((r.input_index, r.status, r.pages) for r in admission.whole_ledger(read, admission.ledger_rows(files)).collect()) == [(0, "Assigned", 3), (1, "Failed", None)]
    with pytest.raises(ValueError, match="all inputs failed"):
        admission.whole_ledger(read.limit(0), admission.ledger_rows(files))
    with pytest.raises(ValueError, match="no input"):
        admission.whole_ledger(read.limit(0), admission.ledger_rows(files).limit(0))
    paths = spark.createDataFrame([(0, "a.pdf"), (1, "A.PDF"), (2, "b.txt"), (3, None)], "input_index int, path string")
    assert tuple(admission.counters(admission.admit(paths)).first()) == (1, 2, 1)
    names = spark.createDataFrame([("d1", 0, "a/b.pdf"), ("d2", 1, "A_B.pdf"), ("d3", 2, " .pdf"), ("d4", 3, None)], "document_id string, input_index int, file_name string")
    assert [r.output_name for r in sinks.unique_names(names).orderBy("input_index").collect()] == ["a_b.json", "A_B-02.json", "document.json", "document-02.json"]
    folders = sinks.write_audit({"text": names, "capture": names}, str(tmp_path / "out"), {"capture": False})
    assert [f.rsplit("/", 1)[1] for f in folders] == ["06-text"]
    assert spark.read.json(folders[0]).columns == ["documentId", "fileName", "inputIndex"]
    with pytest.raises(ValueError):
        sinks.bundle(names.limit(0))
    assert sinks.bundle(names).count() == 4


def test_title_case_and_ranks(spark):
    assert one(spark, render.title_case, "ANTI-HIV 1 E 2") == "Anti-Hiv 1 E 2"
    assert one(spark, render.title_case, " Sódio ") == "Sódio" and one(spark, render.title_case, "T4 LIVRE (24H) D'AGUA") == "T4 Livre (24H) D'agua"
    assert len({c for c, *_ in project.rank_rows()}) == len(project.rank_rows())


def test_composite_curves(spark):
    def row(e, concept, label, value, n, unit, day):
        return (f"{label}-{e}", f"{concept}-{e}", "p", e, concept, label, value, n, unit, None, datetime(2026, 7, day, 8), datetime(2026, 8, 1))

    rows = []
    for e, day, bt, bd in (("e1", 18, 3.8, 2.6), ("e2", 20, 2.9, 1.8)):
        rows += [row(e, "lab.bilirrubina-total", "BT", str(bt), bt, "mg/dL", day), row(e, "lab.bilirrubina-direta", "BD", str(bd), bd, "mg/dL", day)]
    h = "lab.hemograma-completo"
    rows += [row("e1", h, "LEUCÓCITOS", "14.020", 14020.0, "/mm3", 18), row("e1", h, "SEGMENTADOS (NEUTRÓFILOS)", "77,68", 77.68, "%", 18), row("e1", h, "LINFÓCITOS", "9,79", 9.79, "%", 18), row("e1", h, "MIELÓCITOS", "2,99", 2.99, "%", 18)]
    rows += [row("e2", h, "LEUCÓCITOS", "10.820", 10820.0, "/mm3", 20), row("e2", h, "NEUTRÓFILOS", "70,04", 70.04, "%", 20), row("e2", h, "BASTONETES", "3,00", 3.0, "%", 20), row("e3", h, "LEUCÓCITOS", "1", 1.0, "/mm3", 21)]
    df = spark.createDataFrame(rows, "observation_id string, occurrence_id string, patient_key string, episode_key string, concept_id string, label string, raw_value string, v double, raw_unit string, normalized_unit string, requested_at timestamp_ntz, received_at timestamp_ntz").withColumn("numeric_value", F.col("v").cast("decimal(28,10)"))
    assessed = spark.createDataFrame([("p", "e1", "d1", "18/07/2026", 18.3206, None), ("p", "e2", "d2", "20/07/2026", 20.19, None)], "patient_key string, episode_key string, derived_observation_id string, raw_request_date string, value double, reason string")
    out = {}
    for r in curves.texts(curves.all_series(df, assessed)).orderBy("place", "n").collect():
        out.setdefault(r.heading, []).append(r.piece)
    assert out == {
        "#Leucograma (/mm³):": ["18/07 - Leuco 14.020 (N 77,6% | L 9,7% | Mielócitos 2,9%)", "20/07 - Leuco 10.820 (N 70,0% | B 3,0%)"], "#BT (mg/dL):": ["18/07 - 3,8", "20/07 - 2,9 (-0,9)"], "#BD (mg/dL):": ["18/07 - 2,6", "20/07 - 1,8 (-0,8)"],
        "#Bilirrubinas (mg/dL):": ["18/07 - (BT 3,8 | BD 2,6)", "20/07 - (BT 2,9 | BD 1,8)"], "#TFG (mL/min/1,73m²):": ["18/07 - 18,3", "20/07 - 20,1 (+1,8)"],
    }


def test_contracts(spark, tmp_path):
    from laudario.plans import contracts

    df = spark.range(2).toDF("a.b")
    stamped = contracts.stamp(df, "1.2", "1.0")
    assert contracts.guard(stamped, "semantic").count() == 2
    stamped.write.parquet(str(tmp_path / "t"))
    assert contracts.guard(spark.read.parquet(str(tmp_path / "t")), "semantic").columns == ["a.b"]
    for bad, layer in ((df, "semantic"), (stamped, "derived"), (contracts.stamp(df, "1.1", "1.0", False), "projection")):
        with pytest.raises(ValueError):
            contracts.guard(bad, layer)


def test_candidates_of_rates(spark):
    o = "array<struct<id:string,label:string,raw_value:string,numeric_value:double,raw_unit:string>>"
    rows = [
        ("a", "p", "e", [("1", "CREATININA", "1,0", 1.0, "mg/dL"), ("2", derived.REPORTED_LABEL, "90", 90.0, None)], ["SORO"]), ("b", "p", "e", [("3", "CREATININA", "1,0", 1.0, "mg/dL"), ("4", "TAXA DE FILTRACAO", "90", 90.0, None)], ["SORO"]),
        ("c", "p", "e", [], ["SORO", "URINA"]), ("d", "p", "e", [("5", None, None, None, None)], []),
    ]
    df = spark.createDataFrame(rows, f"occurrence_id string, patient_key string, episode_key string, observations {o}, specimens array<string>")
    found = {r.occurrence_id: r for r in derived.candidates(df).collect()}
    assert (found["a"].source_observation_id, found["a"].candidates, found["a"].raw_specimen) == ("1", 1, "SORO")
    assert (found["b"].candidates, found["b"].raw_creatinine_value, found["b"].candidate_ids) == (2, None, ["3", "4"])
    assert (found["c"].source_observation_id, found["c"].candidates, found["c"].raw_specimen) == (None, 0, None)
    assert found["d"].candidates == 1 and found["d"].raw_specimen is None
    inputs = derived.candidates(df).withColumn("age_at_request_years", F.lit(50)).withColumn("raw_sex", F.lit("Feminino"))
    reasons = {r.occurrence_id: r.reason for r in derived.assess(inputs).collect()}
    assert reasons == {"a": None, "b": "CreatinineObservationAmbiguous", "c": "SerumSpecimenNotConfirmed", "d": "SerumSpecimenNotConfirmed"}
    assert derived.provenance(spark.createDataFrame([("d", "s2", "e"), ("d", "s1", "e")], "derived_observation_id string, source_observation_id string, episode_key string"), spark.createDataFrame([("e", "x", 1, ["l1", "l2"])], "episode_key string, document_id string, page_number int, source_line_ids array<string>")).first() == ("d", "s1,s2", 1, 2)
