import os
import random

import pytest

from laudario.llm import bpe

PATH = f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE_50K}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(bpe.read_ranks(PATH))


def test_equals_the_definition_in_any_chunks(merges):
    encoder, decoder = bpe.Encoder(merges), bpe.Decoder(merges)
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("ab '\"s\n\t  çã1２9.,<|endoftext|>re've🇧🇷ﬁ日本") for _ in range(random.randint(0, 60)))
        if random.random() < 0.3:
            text += random.choice("a= \n9-") * random.randint(1, 700) + random.choice(["", " x", "1", "."])
        want = [merges.ranks[t] for m in encoder.pattern.finditer(text) for t in merges.merge(m[0].encode())]
        got = encoder.encode(text, chunk=random.choice([1, 2, 3, 50, 10**6]))
        assert got == want
        assert decoder.decode(got) == text


def test_buffer_stays_small(merges):
    t = bpe.Transducer(merges)
    ids = t.feed(b"aab" * 20000) + t.finish()
    assert b"".join(merges.tokens[i] for i in ids) == b"aab" * 20000
    assert t.most <= 4 * merges.longest < merges.sufficient_lookahead()


def test_column(spark):
    df = spark.createDataFrame([(1, "olá mundo"), (2, None), (3, ""), (1, "olá mundo")], "doc_id bigint, text string")
    rows = sorted((r.doc_id, tuple(r.ids)) for r in bpe.p6_ids(df).collect())
    assert rows[2:] == [(2, ()), (3, ())] and rows[0] == rows[1] and rows[0][1]
    assert bpe.p6_ids(df.limit(0)).count() == 0
    back = bpe.decode_column(bpe.p6_ids(df), ["doc_id"])
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "olá mundo"), (1, "olá mundo"), (2, ""), (3, "")]


def test_decoder_replaces_damage(merges):
    d = bpe.Decoder(merges)
    byte = merges.ranks[b"\xc3"]
    assert d.feed([byte]) == "" and d.finish() == "�"
