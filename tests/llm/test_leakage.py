import random

import numpy as np
import pyarrow as pa

from laudario.llm import leakage as L
from laudario.llm import wordhash

random.seed(4)
WORDS = [f"w{i}" for i in range(900)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


ITEMS = [(i, " ".join(random.choice(WORDS) for _ in range(60))) for i in range(1, 13)]


def edited(words):
    words = list(words)
    words[5], words[14] = "outra", "mudada"
    del words[20]
    words.insert(25, "nova")
    return words


def corpus():
    rows, want = [(0, None), (1, ""), (2, "  \n")], set()
    for d in range(3, 60):
        body = text(120).split(" ")
        if d % 3 == 0:
            item, words = ITEMS[d % 12][0], ITEMS[d % 12][1].split(" ")
            start = random.randrange(0, 60 - 32)
            part = edited(words[start : start + 32])
            at = random.randrange(len(body))
            body[at:at] = [w.upper() if d % 2 else w for w in part]
            want.add((d, item))
        rows.append((d, ("\n" if d % 2 else " ").join(body)))
    return rows, want


def test_finds_every_leak_and_nothing_else(spark):
    rows, want = corpus()
    rows.append((60, " ".join(ITEMS[0][1].split(" ")[:12]) + " " + text(100)))  # too short to count
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS + [(99, None), (98, "")], "item_id bigint, text string")
    assert {tuple(r) for r in L.p7_found(docs, items).collect()} == want
    copies = L.p7_found(docs.union(docs), items)
    assert copies.count() == 2 * len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert L.p7_found(docs, items.limit(0)).count() == 0
    assert L.p7_found(docs.limit(0), items).count() == 0


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_subsequence_and_alignment_match_brute_force():
    for _ in range(60):
        a = [random.randrange(8) for _ in range(random.randint(1, 25))]
        b = [random.randrange(8) for _ in range(random.randint(1, 40))]
        bits = {}
        for p, v in enumerate(b):
            bits[v] = bits.get(v, 0) | 1 << p
        assert L.subsequence(a, bits, len(b)) == brute_lcs(a, b)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert L.align([np.array(a, np.int32)], [np.array(b, np.int32)])[0] == h.max()


def encoded(index, *texts):
    return index.encode(pa.array(list(texts), pa.string()))


def index_of(items, frequent=""):
    return L.Index([(i, wordhash.words(pa.array([t]))[0]) for i, t in items], wordhash.words(pa.array([frequent]))[0])


def test_numbers_and_accents_are_the_same_in_all_layouts():
    a, _ = wordhash.words(pa.array(["Traz 198,22 e 1.234,5 mg/L, pH 7.4. São \u200bJoão\u2026 ﬁm"]))
    b, _ = wordhash.words(pa.array(["traz 19822 e 12345\nmg L ph 74 sao joao fim"]))
    assert a.tolist() == b.tolist()
    hashes, bounds = wordhash.words(pa.array(["a b", None, "", "b", "x" * 70 + "y", "x" * 6 + "y" + "x" * 64]))
    assert bounds.tolist() == [0, 2, 2, 2, 3, 4, 5] and hashes[1] == hashes[2] and hashes[3] != hashes[4]


def test_search_does_not_grow_stricter_with_the_corpus():
    index = index_of(ITEMS)
    words = ITEMS[0][1].split(" ")[10:34]
    for k in (3, 8, 14):
        words[k] = f"foreign{k}"
    words[6:6] = ["foreign"]
    for documents in (10_000, 1_000_000, 100_000_000):
        index.fit(np.full(len(index.hashes), documents // 8), documents)
        index.project(np.eye(len(index.hashes), dtype=np.float32))
        searcher = L.Searcher(index)
        assert (0, 0) in searcher.candidates(*encoded(index, " ".join(["alien"] * 9 + words + ["alien"] * 9))), documents
        assert not searcher.candidates(*encoded(index, " ".join(["alien"] * 30), ""))


def brute(documents, items):
    """Every document aligned, in whole, with every item."""
    index = index_of(items)
    out = set()
    for d, text in documents:
        ids, _ = encoded(index, text)
        for i, w in enumerate(index.items):
            h = np.zeros((len(ids) + 1, len(w) + 1))
            for x in range(len(ids)):
                for y in range(len(w)):
                    h[x + 1, y + 1] = max(0, h[x, y] + (1 if ids[x] == w[y] else -1), h[x, y + 1] - 1, h[x + 1, y] - 1)
            if h.max() >= L.SURE:
                out.add((d, items[i][0]))
    return out


def test_index_and_search_lose_nothing_that_brute_force_finds(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]  # few words, so that many pairs are shared by chance
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(8)]
    docs = []
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(50)]
        if d % 2:
            words = items[d % 8][1].split(" ")
            s = rng.randrange(0, 18)
            part = words[s : s + 22]
            for _ in range(rng.randrange(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            body[20:20] = part
        docs.append((d, " ".join(body)))
    want = brute(docs, items)
    assert len(want) >= 25
    found = {tuple(r) for r in L.p7_found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(want - found) == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, want = corpus()
    monkeypatch.setattr(L, "BLOCK_ITEMS", 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in L.p7_found(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()} == want


def passages(spark, index, texts):
    ids, bounds = encoded(index, *texts)
    return spark.createDataFrame([(ids.tobytes(), bounds.astype(np.int64).tobytes())], "ids binary, bounds binary")


def test_singular_vectors_are_those_of_the_matrix(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS[:40]) for _ in range(L.WINDOW)) for _ in range(300)]
    index = index_of([(1, " ".join(WORDS[:40]))])
    index.fit(np.full(len(index.hashes), 9), 300)
    empty = np.zeros(0, np.int32), np.zeros(1, np.int64)
    vectors, values = L.singular_vectors(passages(spark, index, texts), index, empty, rank=6, spare=20, power=3)
    ids, _ = encoded(index, *texts)
    dense = np.zeros((300, len(index.hashes)))
    for k, row in enumerate(ids.reshape(300, -1)):
        np.add.at(dense[k], row, index.idf[row])
    _, exact, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, exact[:6], rtol=0.02)
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-4)
    assert np.linalg.svd(right[:3] @ vectors, compute_uv=False).min() > 0.95


def test_latent_step_finds_paraphrases_that_share_few_words(spark):
    """Synonyms stand in the same surroundings; the latent cosine of a paraphrase is far above that of plain TF-IDF."""
    rng = random.Random(6)
    topics = [[(f"t{t}a{i}", f"t{t}b{i}") for i in range(20)] for t in range(15)]
    texts = []
    for _ in range(1500):
        topic = rng.choice(topics)
        texts.append(" ".join(rng.choice(rng.choice(topic)) for _ in range(L.WINDOW)))
    item = [p[0] for p in topics[3]]
    index = index_of([(1, " ".join(item))], " ".join(w for t in topics for p in t for w in p))
    index.fit(np.full(len(index.hashes), 100), 1500)
    index.project(L.singular_vectors(passages(spark, index, texts), index, (np.zeros(0, np.int32), np.zeros(1, np.int64)), rank=15, spare=10)[0])
    plain = latent = 0
    for _ in range(40):
        window = [pair[rng.random() < 0.7] for pair in topics[3][:16]]
        ids, _ = encoded(index, " ".join(window))
        v = index.basis[ids].sum(0)
        latent += (index.latent @ (v / np.linalg.norm(v))).max() >= L.COSINE
        best = max(len(set(ids.tolist()) & set(w.tolist())) / np.sqrt(len(ids) * len(w)) for _, w in index.windows)
        plain += best >= L.COSINE
    assert latent == 40 and plain < 10
