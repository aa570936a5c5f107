import random

from laudario.llm import truncation as T

random.seed(2)
NOUNS = "soro plasma tubo laudo lote exame setor turno valor pedido".split()
VERBS = "chegou ficou mudou subiu caiu voltou".split()


def sentence():
    return f"O {random.choice(NOUNS)} {random.choice(VERBS)} em {random.randint(1, 400)} {random.choice(['dias', 'horas'])}."


def corpus(n=700):
    rows, cut = [], set()
    for i in range(n):
        source = ["limitada", "livre"][i % 2]
        body = " ".join(sentence() for _ in range(random.randint(4, 16))) + random.choice(["", "\nobrigado", "\nAnexo: 7"])
        if source == "limitada" and len(body) > 300:
            body = body[:300]
            if T._visible(body + "x", 300) and not body.rstrip().endswith((".", "obrigado", "Anexo: 7")):
                cut.add(i)
        elif source == "livre" and i % 20 == 1:
            at = random.randint(60, len(body) - 5)
            if T._visible(body, at):
                body = body[:at]
                cut.add(i)
        rows.append((i, body, source))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    rows += [(900, None, "livre"), (901, "", None), (902, " \n", "livre"), (903, sentence() * 4000, None)]
    out = {r.doc_id: r.truncated for r in T.score(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert len(out) == len(rows) and not any(out[i] for i in (900, 901, 902, 903))
    found = {i for i, t in out.items() if t}
    assert len(found & cut) >= 0.95 * len(cut)
    assert len(found - cut) <= 0.05 * len(cut)


def test_limits(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.source: r.char_limit for r in T.limits(T.lengths(T.measured(df, "doc_id", "text", "source"))).collect()}
    assert got == {"limitada": 300, "livre": None}


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([(1, "abc", "s")], "doc_id bigint, text string, source string")
    assert T.p8_found(df.limit(0)).count() == 0
    assert T.p8_rates(df).collect()[0].texts == 1


def test_visible_cuts():
    text = "Uma frase. Outra frase\nlinha"
    assert not T._visible(text, 10) and not T._visible(text, 22) and T._visible(text, 5) and T._visible(text, 15)


def test_a_longer_text_hides_no_limit_and_copies_make_none(spark):
    rows, _ = corpus()
    rows += [(2000, "x " * 400, "limitada"), (2001, "x " * 900, "limitada")] + [(3000 + i, "O laudo final chegou. " * 60, "livre") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.source: r.char_limit for r in T.limits(T.lengths(T.measured(df, "doc_id", "text", "source"))).collect()} == {"limitada": 300, "livre": None}


def test_closings_are_cut_alike_on_both_sides(spark):
    texts = ["abc", "x" * 500, "a\n" + "y" * 400 + "\n \n", "a b\n" * 200, "z" * 239 + "\n", " \n", "á" * 300 + "\ncurta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.last_line(T.F.col("t")).alias("tail")).collect():
        tail, whole = T.closing(r.t)
        assert r.tail == tail and whole == (len(r.tail) >= len(r.t))


def test_sample_holds_different_texts(spark):
    rows = [(i, f"Texto número {i}.", "a") for i in range(600)] + [(1000 + i, "Texto igual.", "b") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    few = T.draw(df, "text", "source", 601, 200).collect()
    assert 60 <= len(few) <= 200 and len({r.h for r in few}) == len(few)
    assert T.draw(df.union(df), "text", "source", 601, 10_000).count() == 601
