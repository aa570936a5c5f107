from laudario.operators import bands as B


def word(i, text, left, bottom, width=None):
    return {"word_id": f"w{i}", "idx": i, "text": text, "left": left, "right": left + (width or 5 * len(text)), "bottom": bottom, "top": bottom + 8, "baseline": bottom}


def test_column_opens_holds_and_ends():
    lines = [
        [("CREATININA:", 40)], [("1,50 mg/dl", 40), ("Valores de Referência:", 300)], [("outro", 40), ("0,7 a 1,3", 299)], [("Material: SORO", 40), ("adultos", 310)],
        [("0,9 a 1,1", 305)], [("UREIA TOTAL", 40)], [("30 mg/dl", 40), ("livre", 310)],
    ]
    done = B.walk(lines, 595)
    assert [d[0] for d in done[:4]] == ["CREATININA:", "1,50 mg/dl", "outro", "Material: SORO"]
    assert done[4][1] == "Reference" and done[4][2] == ["0,9 a 1,1"]
    assert done[6] == ("30 mg/dl | livre", "Active", [])


def test_text_before_the_marker_stays_and_capital_labels_end_a_left_column():
    done = B.walk([[("Resultado: 3 | Valor de Referência: 1 a 2", 40)], [("2 a 4", 45)], [("ATIVIDADE: 61,0 %", 40)]], 595)
    assert done[0][0] == "Resultado: 3" and done[1][1] == "Reference" and done[2] == ("ATIVIDADE: 61,0 %", "Active", [])


def test_parts_join_without_bar_after_colon():
    assert B.join_parts(["Nome:", "Ana", "", "x"]) == "Nome: Ana | x"


def test_staggered_labels():
    lines = [[word(0, "Ana", 200, 101)], [word(1, "Nome....:", 10, 100)]]
    assert [[w["text"] for w in x] for x in B.reorder_staggered(lines)] == [["Nome....:"], ["Ana"]]
    lines = [[word(0, "primeira", 100, 108)], [word(1, "Nome....:", 10, 100), word(2, "segunda", 100, 100)]]
    assert [[w["text"] for w in x] for x in B.reorder_staggered(lines)] == [["Nome....:"], ["primeira"], ["segunda"]]
    assert B.reorder_staggered([]) == []


def test_bands_over_pages(spark):
    rows = [("d", 1, 0, 0, "2", 100.0, 103.0), ("d", 1, 1, 0, "mL/min/1,73m", 40.0, 99.0), ("d", 1, 2, 0, None, 40.0, 50.0)]
    cells = spark.createDataFrame(rows, "document_id string, page_number int, line_no int, cell_no int, text string, left double, right double")
    widths = spark.createDataFrame([("d", 1, 595.0)], "document_id string, page_number int, page_width double")
    assert B.reference_bands(cells, widths).count() == 3
    assert B.reference_bands(cells.limit(0), widths).count() == 0
