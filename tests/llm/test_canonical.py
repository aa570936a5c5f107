from laudario.llm import canonical as C
from laudario.llm.edits import assign, deletes, distance

ENTRIES = [("Glicemia de jejum", "glu", 5), ("COLESTEROL LDL", "ldl", 3), ("COLESTEROL TOTAL", "tot", 3), ("UREIA", "ure", 9), ("Sódio", "na", 1), ("Cloreto de sódio", "nacl", 9)]


def entry_frame(spark, rows=ENTRIES):
    return spark.createDataFrame(rows, "text string, concept string, frequency int")


def test_distance_and_deletes():
    assert distance("ureia", "ureia") == 0
    assert distance("ureia", "urieа") > 0
    assert distance("abcd", "abdc") < distance("abcd", "abxy")
    assert distance("casa", "cassa") < 1
    assert deletes("ab", 1) == {"ab", "a", "b"}


def test_assignment_is_optimal():
    total, where = assign([[4, 1, 3], [2, 0, 5]])
    assert (total, where) == (3, [1, 0])


def test_maps_and_reports_misses():
    c = C.Canon(ENTRIES, 0.75)
    for text, want in {"glicemai jejum": "glu", "glic. jejum repetir": "glu", "jejum glicemia": "glu", "UREIIA - urgente": "ure", "colesterol vldl": C.UNMATCHED, "colest ldl": "ldl", "widal": C.UNMATCHED, "-": C.UNMATCHED, "sodio": "na", "glicemiadejejum": "glu"}.items():
        assert c.map(text)[0] == want, text


def test_frequency_breaks_ties():
    c = C.Canon([("ALFA BETA", "rare", 1), ("ALFA BETA", "often", 7)], 0.75)
    assert c.map("alfa beta!")[0] == "often"


def test_rows_nulls_blanks_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "  ", "x"), (3, "ureai", "x"), (3, "ureai", "x"), (4, "z" * 20000, "x")], "entry_id bigint, entered_label string, concept_id string")
    out = C.canonicalize(df, "entered_label", entry_frame(spark))
    assert out.columns == ["entry_id", "entered_label", "concept_id", "match_cost"]
    rows = sorted((r.entry_id, r.concept_id) for r in out.collect() if r.concept_id) + [r.entry_id for r in out.collect() if r.concept_id is None]
    assert rows == [(3, "ure"), (3, "ure"), (4, C.UNMATCHED), 1, 2]


def test_empty_tables_and_exact_names(spark):
    concepts = spark.createDataFrame([("ure", "Ureia", ["UREIA"], 3), ("x", None, None, None)], "concept_id string, display_name string, observed_aliases array<string>, observed_occurrence_count int")
    exams = spark.createDataFrame([(1, "UREIA"), (2, "Ureia"), (3, "ureia"), (4, ""), (5, None)], "entry_id bigint, entered_label string")
    assert [tuple(r) for r in C.p1_found(exams, concepts).collect()] == [(3, "ure")]
    assert C.p1_found(exams.limit(0), concepts).count() == 0
    assert [r.concept_id for r in C.p1_found(exams, concepts.limit(0)).collect()] == [C.UNMATCHED] * 3


def test_long_labels_are_judged_like_others(spark):
    c = C.Canon(ENTRIES, 0.75)
    assert c.map("ureia " + "urgente " * 10)[0] == "ure"
    assert c.map("a de o " * 300 + "ureia")[0] == C.UNMATCHED  # 900 joining words add up
    assert c.map("de " * 60 + "ureia")[0] == "ure"


def test_misspelt_prefixes():
    c = C.Canon([("PARATORMONIO", "pth", 1), ("UREIA", "ure", 1)], 0.75, (), {})
    assert c.map("paratro")[0] == "pth"
    assert c.near("ureia") == {"ureia": 0.0}


def test_blocks_give_the_answers_of_one_list(spark):
    labels = ["glicemai jejum", "colesterol vldl", "colest ldl", "widal", "sodio", "ureai", "", None, "ureia", "cloreto de sodio"] * 2
    df = spark.createDataFrame(list(enumerate(labels)), "entry_id int, entered_label string")
    whole = {r.entry_id: (r.concept_id, r.match_cost) for r in C.canonicalize(df, "entered_label", entry_frame(spark)).collect()}
    assert len(whole) == 20 and whole[0][0] == "glu"
    assert {r.entry_id: (r.concept_id, r.match_cost) for r in C.canonicalize(df, "entered_label", entry_frame(spark), block=2).collect()} == whole


def test_distance_within_a_band_is_exact():
    import random

    rng = random.Random(3)

    def full(a, b):
        inf = float("inf")
        t = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
        t[0][0] = 0.0
        from laudario.llm import edits as E

        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i:
                    t[i][j] = min(t[i][j], t[i - 1][j] + (E.DOUBLED if i > 1 and a[i - 2] == a[i - 1] else E.OTHER))
                if j:
                    t[i][j] = min(t[i][j], t[i][j - 1] + (E.DOUBLED if j > 1 and b[j - 2] == b[j - 1] else E.OTHER))
                if i and j:
                    t[i][j] = min(t[i][j], t[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else E.NEAR if (a[i - 1], b[j - 1]) in E._NEAR else E.OTHER))
                    if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                        t[i][j] = min(t[i][j], t[i - 2][j - 2] + E.SWAP)
        return t[-1][-1]

    for _ in range(400):
        a = "".join(rng.choice("abcq") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("abcq") for _ in range(rng.randint(0, 9)))
        for most in (1.0, 3.0):
            want = full(a, b)
            assert abs(distance(a, b, most) - (want if want <= most else most + 1)) < 1e-9
    long = "ab" * 10_000
    assert distance(long, long[1:], 1.0) == 1.0
