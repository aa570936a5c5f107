"""Vectors of the clinical text."""

from datetime import datetime


from laudario.operators import project as P
from laudario.operators import render as R

NESTED = (
    "patient_key string, episode_key string, occurrence_id string, concept_id string, requested_at timestamp_ntz, label string, rate string, narratives array<string>, specimens array<string>, attributes array<struct<name:string,value:string>>, "
    f"observations {R.OBSERVATIONS}, organisms {R.ORGANISMS}, groups {R.GROUPS}, evidence array<string>"
)
CONCEPTS = [
    ("lab.hemograma-completo", "Hemograma completo", "sectioned-panel"), ("lab.gasometria-arterial", "GASOMETRIA ARTERIAL", "key-value-panel"), ("lab.tempo-protrombina", "TP", "multi-analyte-panel"), ("lab.tempo-tromboplastina", "TTPA", "multi-analyte-panel"),
    ("lab.bacterioscopico-gram", "BACTERIOSCOPICO (GRAM)", "qualitative-narrative"), ("lab.antibiograma", "ANTIBIOGRAMA", "susceptibility-panel"), ("lab.cultura-aspirado-traqueal", "CULTURA DE ASPIRADO TRAQUEAL", "microbiology-culture"),
    ("lab.cultura-swab-retal", "CULTURA DE SWAB RETAL", "microbiology-culture"), ("lab.creatinina", "CREATININA", "scalar"), ("lab.plaquetas", "PLAQUETAS", "scalar"), ("lab.sodio", "SÓDIO", "scalar"), ("lab.anti-hiv", "ANTI-HIV", "indexed-assay"), ("lab.x", "EXAME NOVO", "scalar"),
]


def occurrence(name, concept, observations=(), episode="e", **more):
    row = dict(patient_key="p", episode_key=episode, occurrence_id=name, concept_id=f"lab.{concept}", requested_at=datetime(2026, 1, 1, 8), label=observations[0][0] if observations else None, rate=None, narratives=[], specimens=[], attributes=[], organisms=[], groups=[], evidence=[])
    row["observations"] = [(f"{name}-{i}", *o) for i, o in enumerate(observations)]
    return {**row, **more}


def project(spark, rows, **options):
    names = [f.split(" ")[0] for f in ("patient_key", "episode_key", "occurrence_id", "concept_id", "requested_at", "label", "rate", "narratives", "specimens", "attributes", "observations", "organisms", "groups", "evidence")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], NESTED)
    return P.rendered(df, spark.createDataFrame(CONCEPTS, "concept_id string, display_name string, structural_form_id string"), **options)


def text(spark, rows, **options):
    return P.episode_texts(project(spark, rows, **options)).first().text


def test_forms(spark):
    """One occurrence each: values, rates, panels, blood counts, coagulation, Gram, antibiograms."""
    blood = [
        ("HEMOGLOBINA", "10,8", "g/dL"), ("LEUCÓCITOS", "14.260", "/mm3"), ("SEGMENTADOS (NEUTRÓFILOS)", "82", "%"), ("SEGMENTADOS (NEUTRÓFILOS)", "11.693", "/mm3"), ("METAMIELÓCITOS", "4,00", "%"), ("METAMIELÓCITOS", "786", "mm3"),
        ("MIELÓCITOS", "3,00", "%"), ("MIELÓCITOS", "284", "mm3"), ("BLASTOS", "6,00", "%"), ("BLASTOS", "1.179", "mm3"), ("LINFÓCITOS", "10", "%"), ("ERITROBLASTOS/100 LEUCÓCITOS", "18,00", None), ("OBSERVAÇÃO", "Anisocitose", None), ("PLAQUETAS", "186.000", "/mm3"),
    ]
    cases = [
        (occurrence("plt", "plaquetas", [("PLAQUETAS", "304.000", "/mm3")]), ["Plaq 304.000"]),
        (occurrence("rate", "creatinina", [("CREATININA", "2,60", "mg/dL")], rate="18,3"), ["Cr 2,60 | TFG 18,3"]),
        (occurrence("own", "creatinina", [("CREATININA", "2,60", None), ("Taxa de filtração glomerular estimada", "19", None)]), ["Cr 2,60"]),
        (occurrence("two", "x", [("VALOR UM", "1", None), ("B", "2", None)]), ["Valor Um 1 | B 2"]),
        (occurrence("hiv", "anti-hiv", [("ANTI-HIV", "NAO REAGENTE", None)]), ["Anti-Hiv: Anti-Hiv NAO REAGENTE"]),
        (occurrence("att", "x", attributes=[("MATERIAL", "SORO"), ("ASPECTO", "límpido")]), ["Aspecto límpido"]),
        (occurrence("blood", "hemograma-completo", blood), ["Hb 10,8 | Leuco 14.260 (Neut 82% [11.693] | Meta 4,00% [786] | Mielo 3,00% [284] | Blastos 6,00% [1.179] | Linf 10% | Eritroblastos/100 Leuco 18,00) | Observação laboratorial: Anisocitose | Plaq 186.000"]),
        (occurrence("ery", "hemograma-completo", [("LEUCÓCITOS", "13.440", "/mm3"), ("ERITROBLASTOS/100 LEUCÓCITOS", "1,00", None)]), ["Leuco 13.440 (Eritroblastos/100 Leuco 1,00)"]),
        (occurrence("gas", "gasometria-arterial", [("pO2", "72", "mmHg"), ("pH", "7,31", None), ("pCO2", "48", "mmHg")]), ["Gasometria arterial: pH 7,31 | pCO2 48 | pO2 72"]),
        (occurrence("tp", "tempo-protrombina", [("ATIVIDADE", "86,0", "%"), ("RNI", "1,09", None), ("CONTROLE NORMAL", "10,8", "segundos")]), ["TP: Atividade 86,0 | RNI 1,09"]),
        (occurrence("ttpa", "tempo-tromboplastina", [("AMOSTRA", "22,0", "segundos")]), ["TTPa 22,0"]),
        (occurrence("gram", "bacterioscopico-gram", [("RESULTADO", "PRESENÇA DE COCOS", None), ("TEMPO DE POSITIVIDADE", "25,00", "horas")], specimens=["SANGUE"]), ["Bacterioscópico (Gram): PRESENÇA DE COCOS | Tempo de positividade 25,00 | material SANGUE"]),
        (occurrence("anti", "antibiograma", [("RESULTADO", "POSITIVO", None)], episode="f", organisms=[("1", "Escherichia coli"), ("2", "Enterococcus faecalis")],
            groups=[("1", "Escherichia coli", [("Ampicilina", "RESISTENTE", "RESISTENTE")]), ("2", "Enterococcus faecalis", [("Ampicilina", "SENSÍVEL", "SENSIVEL")])]),
         ["Antibiograma: POSITIVO", "Organismo 1: Escherichia coli", "Antibiograma: Ampicilina R", "Organismo 2: Enterococcus faecalis", "Antibiograma: Ampicilina S"]),
    ]
    done = {r.occurrence_id: r for r in project(spark, [c for c, _ in cases]).collect()}
    for row, want in cases:
        assert done[row["occurrence_id"]].lines == want
    assert done["anti"].notice == "unlinked-susceptibility-preserved"
    assert project(spark, [occurrence("a", "sodio", [("SÓDIO", "139", "mEq/L")])], units=True).first().lines == ["Na 139 mEq/L"]


CULTURE = occurrence("c", "cultura-aspirado-traqueal", [("CULTURAL", "Pseudomonas aeruginosa", None)], organisms=[("o", "Pseudomonas aeruginosa")])
GRAM = occurrence("s", "antibiograma", [("RESULTADO", "SENSÍVEL", None)], organisms=[("q", "PSEUDOMONAS  AERUGINOSA")], groups=[("q", "PSEUDOMONAS  AERUGINOSA", [("Ceftriaxona", "MIC ≤1 mg/L (S)", "SENSIVEL")])])


def test_linked_antibiogram_is_written_in_its_culture(spark):
    done = {r.occurrence_id: r for r in project(spark, [CULTURE, GRAM]).collect()}
    assert done["c"].lines == ["Cultura De Aspirado Traqueal: Pseudomonas aeruginosa", "Organismo 1: Pseudomonas aeruginosa", "Antibiograma: Ceftriaxona MIC ≤1 mg/L (S)"]
    assert (done["s"].disposition, done["s"].lines, done["s"].linked_to) == ("SuppressedByExplicitPolicy", [], "c")
    # a second culture with the organism, or one of another episode, links nothing
    twins = [{**r, "episode_key": e, "occurrence_id": e + r["occurrence_id"]} for e, r in (("1", CULTURE), ("1", GRAM), ("2", CULTURE), ("3", GRAM))] + [{**CULTURE, "episode_key": "1", "occurrence_id": "1d"}]
    assert {r.occurrence_id: r.notice for r in project(spark, twins).collect()} == {"1c": None, "1d": None, "1s": "unlinked-susceptibility-preserved", "2c": None, "3s": "unlinked-susceptibility-preserved"}


def test_hidden_cultures_are_accounted_for(spark):
    row = occurrence("c", "cultura-swab-retal", [("CULTURAL", "NEGATIVO", None)], narratives=["Negativo para Acinetobacter"], specimens=["SWAB RETAL"])
    assert text(spark, [row], cultures=False) == "Laboratoriais (01/01/2026 – 08:00): Culturais"
    done = project(spark, [row], cultures=False)
    fields = P.fields(done, cultures=False)
    assert {(r.kind, r.disposition) for r in fields.collect()} == {("Observation", "AuditOnly"), ("Narrative", "AuditOnly"), ("Specimen", "AuditOnly")}
    totals = P.coverage_totals(done, fields).first()
    assert totals.is_complete and totals.suppressed == 1 and totals.fields == 3
    assert P.culture_review(project(spark, [row])).first().lines == "Cultura De Swab Retal: material SWAB RETAL | NEGATIVO\nNegativo para Acinetobacter"


def test_every_kind_of_field_has_a_place(spark):
    rows = [CULTURE, GRAM, occurrence("n", "sodio", [("SÓDIO", "139", "mEq/L")]), occurrence("t", "tempo-protrombina", [("RNI", "1,09", None), ("CONTROLE NORMAL", "10,8", None)]), occurrence("k", "creatinina", [("CREATININA", "2,6", None)], rate="18,3", attributes=[("a", "b")])]
    done = project(spark, rows)
    by = {(r.occurrence_id, r.field): (r.disposition, r.reason, r.line) for r in P.fields(done).collect()}
    assert by["n", "n-0"] == ("Projected", "rendered", 0) and by["c", "microbiology.organisms[0]"] == ("Projected", "rendered", 0)
    assert by["t", "t-1"] == ("SuppressedByExplicitPolicy", "explicit-clinical-policy", None) and by["k", "derived[0]"] == ("Projected", "rendered", 0)
    assert by["k", "attributes[0]"][0] == "AuditOnly" and by["s", "microbiology.susceptibilityGroups[0].entries[0]"][0] == "AuditOnly" and by["s", "relationships[0]"][0] == "AuditOnly"
    assert P.coverage_totals(done, P.fields(done)).first().is_complete


def test_fallback_order_and_empty_episodes(spark):
    rows = [occurrence("z", "x", narratives=["laudo ilegível"], evidence=["EXAME NOVO", "laudo ilegível"]), occurrence("y", "sodio", [("SÓDIO", "139", None)]), occurrence("w", "plaquetas", [("PLAQUETAS", "1", None)])]
    assert text(spark, rows) == "Laboratoriais (01/01/2026 – 08:00): Plaq 1 | Na 139 | Resultado não estruturado: laudo ilegível | EXAME NOVO"
    assert project(spark, [rows[0]]).first().notice == "safe-fallback"
    assert P.episode_texts(project(spark, rows).where("false")).count() == 0


def test_patients_newest_first_with_names(spark):
    rows = [occurrence("a", "sodio", [("SÓDIO", "139", None)], episode="old", requested_at=datetime(2025, 1, 1)), occurrence("b", "sodio", [("SÓDIO", "140", None)], episode="new"), occurrence("c", "sodio", [("SÓDIO", "141", None)], episode="none", requested_at=None), occurrence("d", "sodio", [("SÓDIO", "1", None)], patient_key="q")]
    people = spark.createDataFrame([("p", "ANA B", 3), ("p", "Ana", 1), ("other", "x", 1)], "patient_key string, patient_name string, first_input_index int")
    out = [(r.patient_key, r.place, r.episode_key) for r in P.patient_texts(project(spark, rows), people).orderBy("patient_key", "place").collect()]
    assert out == [("p", 0, None), ("p", 1, "new"), ("p", 2, "old"), ("p", 3, "none"), ("q", 1, "e")]
    one = P.patient_texts(project(spark, rows), people, "p")
    assert one.count() == 4 and one.where("place = 0").first().text == "Paciente: Ana"
