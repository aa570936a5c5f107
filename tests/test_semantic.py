from laudario.operators import semantic as S

CONCEPTS = [
    ("hemogram", "HEMOGRAMA COMPLETO", ["HEMOGRAMA"], "sectioned-panel", ["HEMOGLOBINA", "HEMATÓCRITO", "LEUCOCITOS", "PLAQUETAS"]),
    ("hb", "HEMOGLOBINA", None, "scalar", []), ("ht", "HEMATOCRITO", None, "scalar", []), ("leu", "LEUCOCITOS", None, "scalar", None), ("plt", "PLAQUETAS", None, "scalar", []),
    ("crea", "CREATININA", ["CREATININA SERICA"], "scalar", []), ("uro", "UROCULTURA", ["CULTURA DE URINA"], "microbiology-culture", []), ("cult", "CULTURAL", None, "microbiology-culture", []),
]


def run(spark, pages):
    """pages: (document, page, texts); line keys are document * 1000 + page * 100 + place."""
    concepts = spark.createDataFrame(CONCEPTS, "concept_id string, display_name string, observed_aliases array<string>, structural_form_id string, observed_components array<string>")
    rows = [(str(d), p, f"l{i:03d}", d * 1000 + p * 100 + i, i, t, "Active") for d, p, texts in pages for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "document_id string, page_number int, line_id string, line_key int, source_index int, text string, disposition string")
    return {r.line_key: r for r in S.continued(S.anchored(lines, concepts)).collect()}


def test_components_stay_in_their_panel(spark):
    out = run(spark, [(1, 1, ["HEMOGRAMA", "HEMOGLOBINA: 13,1 g/dL", "HEMATOCRITO: 39 %", "LEUCOCITOS: 7.000 /mm³", "PLAQUETAS: 200.000 /mm³", "Material: SANGUE"])])
    assert [out[k].opens for k in sorted(out)] == [True, False, False, False, False, False]
    assert {r.concept_id for r in out.values()} == {"hemogram"}


def test_repeated_names(spark):
    # again at once; after a result on the anchor line; after material; a result on another line alone doesn't count
    for texts, want in [
        (["CREATININA:", "CREATININA: 1,2"], [1, 0]), (["CREATININA: 1,1", "CREATININA: 1,2"], [1, 1]), (["CREATININA:", "Material: SORO", "CREATININA:"], [1, 0, 1]),
        (["CREATININA:", "Resultado: 1,1", "CREATININA:"], [1, 0, 0]), (["CREATININA:", "HEMOGLOBINA: 1", "CREATININA:"], [1, 1, 1]), (["CREATININA:", "CREATININA SERICA: 1", "CREATININA: 2"], [1, 0, 0]),
    ]:
        out = run(spark, [(1, 1, texts)])
        assert [int(out[k].opens) for k in sorted(out)] == want, texts


def test_cultural_within_a_culture(spark):
    out = run(spark, [(1, 1, ["UROCULTURA", "CULTURAL: NEGATIVO"]), (2, 1, ["CULTURAL: NEGATIVO"])])
    assert [out[k].opens for k in sorted(out)] == [True, False, True]


def test_pages_go_on(spark):
    out = run(spark, [
        (1, 1, ["HEMOGRAMA"]), (1, 2, ["PLAQUETAS BAIXAS", "CREATININA: 1"]), (1, 3, ["MATERIAL: SORO"]), (1, 5, ["Material: SORO"]), (2, 1, ["x"]), (3, 1, ["x", "CREATININA: 1"]), (3, 2, ["livre"]),
    ])
    got = {k: (r.concept_id, r.reason) for k, r in out.items()}
    assert got == {
        1100: ("hemogram", None), 1200: ("hemogram", None), 1201: ("crea", None), 1300: ("crea", None), 1500: (None, "NoKnownAnchor"), 2100: (None, "NoKnownAnchor"),
        3100: (None, "PrefixWithoutSafeContext"), 3101: ("crea", None), 3200: (None, "NoKnownAnchor"),
    }


def brute(texts):
    """The rule as a walk over the lines."""
    names = {S_key: (c[0], c[3]) for c in CONCEPTS for S_key in [c[1].upper(), *(c[2] or [])]}
    parts = {c[0]: {p.replace("Ó", "O") for p in c[4] or []} for c in CONCEPTS}
    current, opens = None, []
    for i, t in enumerate(texts):
        label = t.split(":")[0].strip().upper()
        took = False
        if label in names:
            concept, form = names[label]
            took = True
            if current:
                at, cc, cf = current
                if label in parts[cc] or cf == "microbiology-culture" and label == "CULTURAL":
                    took = False
                elif cc == concept and not any(x.split(":")[0].strip().upper() == "MATERIAL" for x in texts[at:i]) and not (":" in texts[at] and texts[at].split(":", 1)[1].strip()):
                    took = False
            if took:
                current = (i, concept, form)
        opens.append(took)
    return opens


def test_anchors_match_a_walk(spark):
    import random

    rng = random.Random(4)
    pool = ["HEMOGRAMA", "HEMOGLOBINA: 1", "HEMOGLOBINA:", "CREATININA:", "CREATININA: 2", "Material: SORO", "UROCULTURA", "CULTURAL: E. COLI", "Resultado: 3", "texto", "HEMATOCRITO"]
    pages = [(d, 1, [rng.choice(pool) for _ in range(12)]) for d in range(60)]
    out = run(spark, pages)
    for d, _, texts in pages:
        assert [out[d * 1000 + 100 + i].opens for i in range(12)] == brute(texts), texts


def test_organisms_records_and_evidence(spark):
    from pyspark.sql import functions as F

    concepts = spark.createDataFrame([(*c, f"strategy-{c[3]}") for c in CONCEPTS], "concept_id string, display_name string, observed_aliases array<string>, structural_form_id string, observed_components array<string>, extraction_strategy_id string")
    texts = ["UROCULTURA", "CULTURAL: Escherichia coli", "CULTURAL: Negativo", "MATERIAL: URINA", "nota livre"]
    rows = [("d", 1, f"l{i}", i, i, t, "Active", [f"r{i % 2}"], [f"w{i}", f"v{i}"], []) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "document_id string, page_number int, line_id string, line_key int, source_index int, text string, disposition string, applied_rule_ids array<string>, source_word_ids array<string>, suppressed_segments array<string>")
    owned = S.continued(S.anchored(lines, concepts))
    routes = S.routed(owned)
    assert [r.organism for r in S.organisms(routes).collect()] == ["Escherichia coli"]
    r = S.records(routes, lines, concepts).first()
    assert (r.status, r.lines, r.words, r.specimens, r.narratives) == ("StructuredWithResidual", 5, 10, 1, 1)
    assert r.rules == " ".join(sorted(["r0", "r1", S.SEGMENTATION_RULE, "strategy-microbiology-culture"]))
    assert [(e.position, e.words) for e in S.evidence(owned, lines).orderBy("position").collect()] == [(i, f"w{i},v{i}") for i in range(5)]
    total = S.coverage(owned).where(F.col("document_id").isNull()).first()
    assert total.lossless and total.multiply_owned == 0
