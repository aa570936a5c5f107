"""Vectors of reconstruction and line classification on whole pages."""

import random
from statistics import median


from laudario.operators import bands as B
from laudario.operators import reconstruct as R
from laudario.operators import sanitize as S

WORDS = "document_id string, page_number int, word_id string, idx int, text string, left_x double, bottom_y double, right_x double, top_y double, baseline_y double, page_width double, glyph_ids array<string>"


def texts(spark, words):
    rows = [("d", 1, f"w{i}", i, t, float(a), float(b), float(c), float(d), float(b), 600.0, [f"g{i}"]) for i, (t, a, b, c, d) in enumerate(words)]
    df = spark.createDataFrame(rows, WORDS)
    return [r.text for r in R.line_texts(R.cells(df, R.lines_of_words(df))).orderBy("line_no").collect()]


def test_scripts(spark):
    out = texts(spark, [("pO", 10, 100, 20, 108), ("resultado", 25, 100, 80, 108), ("2", 21, 97.8, 23, 102), ("p/mm", 10, 80, 25, 88), ("3", 26, 84.2, 28, 88.4), ("2", 100, 60, 108, 68)])
    assert out == ["pO2 resultado", "p/mm3", "2"]


def test_staggered_labels_and_brackets(spark):
    out = texts(spark, [
        ("EXAME", 10, 120, 50, 126.6), ("2,80", 200, 114.6, 230, 121.2), ("(TSH).........:", 10, 109.2, 100, 115.8), ("Pesquisa", 200, 84.6, 250, 91.2), ("CULTURAL........:", 10, 79.2, 150, 85.8), ("continuação", 200, 73.8, 260, 80.4),
        ("NÃO REAGENTE", 200, 64.6, 280, 71.2), ("IgM........:", 10, 59.2, 100, 65.8), ("ICO (índice de", 120, 45, 190, 51.6), ("0,10", 200, 40, 230, 46.6), ("cutoff)", 10, 35, 60, 41.6),
    ])
    assert out == ["EXAME", "(TSH).........:", "2,80", "CULTURAL........:", "Pesquisa", "continuação", "IgM........:", "NÃO REAGENTE", "ICO (índice de", "cutoff)", "0,10"]


def test_split_behind_a_staggered_label(spark):
    assert texts(spark, [("CULTURA PREJUDICADA", 200, 30, 330, 36.6), ("CULTURAL........:", 10, 24.6, 150, 31.2), ("CONTAMINANTE", 200, 24.6, 290, 31.2), ("NOVA SOLICITAÇÃO", 200, 19.2, 300, 25.8)]) == ["CULTURAL........:", "CULTURA PREJUDICADA", "CONTAMINANTE", "NOVA SOLICITAÇÃO"]


def test_wrapped_labels(spark):
    words = [("Pesquisa de antigeno", 10, 100, 150, 106.6), ("NAO REAGENTE", 162, 94.6, 230, 101.2), ("Valores de Referencia", 300, 94.6, 390, 101.2), ("em", 10, 89.2, 20, 95.8), ("gestante........:", 24, 89.2, 150, 95.8)]
    assert texts(spark, words) == ["Pesquisa de antigeno", "em gestante........:", "NAO REAGENTE Valores de Referencia"]
    # a colon without dots ends no label
    assert texts(spark, [("Nome", 10, 100, 40, 106.6), ("12,3", 162, 94.6, 180, 101.2), ("Idade:", 10, 89.2, 40, 95.8)]) == ["Nome", "12,3", "Idade:"]


def test_clustering_matches_a_search_over_all_lines():
    rng = random.Random(2)
    for _ in range(30):
        words = [{"word_id": f"w{i}", "idx": i, "text": "x", "left": rng.uniform(0, 500), "right": 0, "bottom": (b := round(rng.uniform(0, 120), 1)), "top": b + rng.choice([6, 8, 9]), "baseline": b} for i in range(150)]
        tol = R.tolerance([w["top"] - w["bottom"] for w in words])
        lines = []
        for w in sorted(words, key=lambda w: (-w["baseline"], w["left"], w["idx"])):
            near = [(abs(median(x["baseline"] for x in line) - w["baseline"]), min(x["idx"] for x in line), k) for k, line in enumerate(lines)]
            near = [n for n in near if n[0] <= tol]
            if near:
                lines[min(near)[2]].append(w)
            else:
                lines.append([w])
        assert sorted(sorted(w["idx"] for w in x) for x in lines) == sorted(sorted(w["idx"] for w in x) for x in R.cluster(words))


LETTERHEAD = ["Fundação Exemplo", "Laboratório Exemplo", "Rua Um, 1 - Bairro: Centro", "Cidade - Fone: 1"]
HEAD = LETTERHEAD + [
    "Nome do Paciente.: PACIENTE TESTE Sexo....: Feminino", "Data Nascimento..: 01/01/2000 Idade...: 26", "Solicitante......: MEDICO TESTE Registro: 123", "Nr Requisição....: 030-0000001 Data Req: 01/08/2026",
    "Origem...........: UNIDADE TESTE Hora Req: 10:00:00", "Data Col.........: 01/08/2026 Hora Col: 10:05:00",
]
FOOT = ["Laudo conferido e liberado eletronicamente pelo(a) Analista:", "Responsável Técnico: Farmacêutico Teste", "Data e hora liberação: 01/08/2026 11:00:00", "Impresso por: TESTE", "Este laudo possui caráter meramente informativo"]


def page(spark, body, head=HEAD):
    """Lines as lists of cells (text, left, right); plain texts are one cell."""
    lines = [x if isinstance(x, list) else [(x, 44, 400)] for x in [*head, *body, *FOOT]]
    cells = spark.createDataFrame([("d", 1, n, k, t, float(a), float(b)) for n, line in enumerate(lines) for k, (t, a, b) in enumerate(line)], "document_id string, page_number int, line_no int, cell_no int, text string, left double, right double")
    rows = [("d", 1, n, n, f"l{n:04d}", " | ".join(t for t, _, _ in line), " ".join(t for t, _, _ in line)) for n, line in enumerate(lines)]
    made = spark.createDataFrame(rows, "document_id string, page_number int, line_no int, source_index int, line_id string, display_text string, text string")
    widths = spark.createDataFrame([("d", 1, 595.0)], "document_id string, page_number int, page_width double")
    done = B.sanitized_pages(S.classify(made, "display_text"), cells, widths).orderBy("line_no").collect()
    assert [r.line_no for r in done] == list(range(len(lines)))
    return done, S.parse_header(made).first()


def active(done):
    return [r.text for r in done if r.disposition == "Active"]


def kinds(done):
    return {r.disposition for r in done}


def test_full_page(spark):
    done, header = page(spark, [
        [("CREATININA............................:", 44, 255), ("Valores de Referencia", 435, 510)], [("1,50 mg/dl", 259, 313)], [("Homens: 0,66 - 1,25 mg/dL", 435, 532)], "Material...: SORO", "Método.....: Colorimétrico (automação -", "equipamento)",
        "NOTA: O uso de dipirona pode interferir no resultado", "Texto padronizado de continuação", "Observações.:Anisocitose", "Resultados Anteriores", "01/01/2025", "1,20",
    ])
    assert active(done) == ["CREATININA:", "1,50 mg/dl", "Material: SORO", "Observações:Anisocitose"]
    assert kinds(done) == {"Header", "Active", "Reference", "Method", "BoilerplateNote", "History", "Footer"}
    assert all(r.rules for r in done if r.disposition != "Active")
    assert header.patient_name == "PACIENTE TESTE" and header.request_number == "030-0000001" and header.requester_registration == "123" and header.request_time == "10:00:00" and header.origin == "UNIDADE TESTE"
    assert header.issuer == LETTERHEAD[0] and header.laboratory == LETTERHEAD[1] and header.unresolved_fragments == [] and len(header.source_line_ids) == 10


def test_header_goes_on(spark):
    head = HEAD[:6] + ["Solicitante......: NOME INCOMPLETO", "Registro: 123", "SOBRENOME", HEAD[7], "Origem...........: UNIDADE TESTE Hora Req: 10:00:00", HEAD[9]]
    done, header = page(spark, ["SÓDIO.................................: 140 mEq/L"], head)
    assert (header.requester, header.requester_registration, header.unresolved_fragments) == ("NOME INCOMPLETO SOBRENOME", "123", [])
    assert active(done) == ["SÓDIO: 140 mEq/L"]
    _, header = page(spark, ["x"], HEAD[:5] + ["linha estranha", *HEAD[5:8], "Origem: A", "ALA B", "Hora Req: 11:00", HEAD[9]])
    assert header.unresolved_fragments == ["linha estranha"] and header.origin == "A ALA B" and header.request_time == "11:00"
    _, header = page(spark, ["x"], HEAD[:9])
    assert header.patient_name is None and header.unresolved_fragments == [S.NO_HEADER] and header.source_line_ids == []


def test_raised_digit_beside_the_reference_column(spark):
    done, _ = page(spark, [[("2", 362, 365), ("Valor de referência (acima de 18", 435, 550)], [("TAXA: 145,77 mL/min/1,73m", 44, 362)]])
    assert active(done) == ["TAXA: 145,77 mL/min/1,73m²"] and "TypographicAttachment" in kinds(done)


def test_capital_fields_end_the_column(spark):
    done, _ = page(spark, [[("Valores de Referencia:", 44, 180)], [("ATIVIDADE: 61,0 %", 44, 180)], [("Material: SANGUE/CITRATO", 44, 220)]])
    assert active(done) == ["ATIVIDADE: 61,0 %", "Material: SANGUE/CITRATO"]


def test_note_ends_before_a_reference_heading(spark):
    done, _ = page(spark, ["Nota: valores fora da faixa de 4% a 25%", "continuacao da nota", [("Valores de", 435, 490)], "TROPONINA I (ultrassensivel): 858,1 ng/L", [("Referencia:", 435, 500)]])
    assert any(t.startswith("TROPONINA I") for t in active(done))
    assert any(r.text == "Valores de" and r.disposition == "Reference" for r in done)


def test_right_reference_band(spark):
    done, _ = page(spark, [
        [("BILIRRUBINA DIRETA................: 0,40 mg/dl", 44, 333), ("Valores de Referencia:", 411, 511)], [("ADULTOS", 411, 436)], [("Bilirrubina Direta: ate 0,3 mg/dL", 411, 530)], [("BILIRRUBINA TOTAL................: 0,40 mg/dl", 44, 333)],
        [("Material...: SORO", 44, 105), ("0,2 a 1,3 mg/dL", 411, 490)],
    ])
    assert active(done) == ["BILIRRUBINA DIRETA: 0,40 mg/dl", "BILIRRUBINA TOTAL: 0,40 mg/dl", "Material: SORO"]


def test_table_of_references_and_right_observation(spark):
    done, _ = page(spark, [
        [("BETA HCG........................: SUPERIOR A 25 mUI/mL", 44, 372), ("Observacao:", 427, 466)], [("inferior a 25 mUI/mL - mulheres", 427, 539)], [("Material...: SORO", 44, 105)], [("nao gravidas.", 427, 474)], [("HEMOGRAMA COMPLETO", 44, 200)],
        "Hemoglobina ................: 11,50 g/dl", "Valores Hematologicos de Referencia - Serie Vermelha", "IDADE | Hemoglobina (g/dL)", "Nascimento | 18,0 +/- 4,0",
    ])
    assert active(done) == ["BETA HCG: SUPERIOR A 25 mUI/mL", "Material: SORO", "HEMOGRAMA COMPLETO", "Hemoglobina: 11,50 g/dl"]


def test_references_on_a_page_of_their_own(spark):
    done, _ = page(spark, ["12 | 9 | CHCM | 9", "Hemacias (x10 /L) Hemoglobina (g/dL)", "(g/dL)", "Homens | 5,0 +/- 0,5", "Mulheres | 4,3 +/- 0,5"])
    assert active(done) == [] and sum(r.disposition == "BoilerplateNote" for r in done) == 5


def test_field_separator_and_long_guidance(spark):
    done, _ = page(spark, [
        [("TRANSAMINASE GLUTAMICO-OXALACETICA (TGO):", 44, 280), ("29,00 U/L", 285, 350), ("complemento", 355, 430)],
        "Em casos de resultado superior a 14%, considerar o valor de glicemia média superior ao valor reportado.", "base nos valores referenciais destas (The A1c-Derived Average Glucose(ADAG) Study Group: Translating the", "A1C assay into estimated average glucose. Diabetes Care, june 2008).",
    ])
    assert active(done) == ["TRANSAMINASE GLUTAMICO-OXALACETICA (TGO): 29,00 U/L | complemento"]
    assert sum(r.disposition == "BoilerplateNote" for r in done) == 3


def test_brackets_are_joined(spark):
    done, _ = page(spark, ["PESQUISA (sangue", "oculto) nas fezes: NEGATIVO", "outra"])
    assert active(done) == ["PESQUISA (sangue oculto) nas fezes: NEGATIVO", "outra"] and "TextContinuation" in kinds(done)


def test_empty_pages(spark):
    empty = spark.createDataFrame([], WORDS)
    assert R.lines_of_words(empty).count() == 0
    assert S.parse_header(spark.createDataFrame([("d", 1, 0, "l", None)], "document_id string, page_number int, source_index int, line_id string, text string")).first().unresolved_fragments == [S.NO_HEADER]
