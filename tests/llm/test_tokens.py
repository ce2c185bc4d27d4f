import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lumenfold.llm import tokens

TEXTS = [
    None, "", " ", "  a  ", "hello world", "x" * 5000, "日本語 テキスト 😀", "<s> <0x0A> <unk>", "a\nb\tc\r\n", "é" * 40, "▁", "a▁b",
    "The quick brown fox " * 300, "tion" * 2000, "\x00\x01", "mixed😀emoji Ünïcödé ß",
]


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.SPACE, prepend_scheme="always", split=True)
    t.encode_special_tokens = True
    return t


def own(pieces, text):
    return int(tokens.Counter(pieces).texts(pa.array([text]))[0])


@pytest.mark.parametrize("text", [t for t in TEXTS if t and tokens.SPACE not in t])
def test_as_the_library(text):
    pieces = tokens.vocabulary(tokens.MODEL)
    assert own(pieces, text) == len(library(pieces).encode(text, add_special_tokens=False).ids)


def test_ties_as_the_library():
    r = random.Random(3)
    for _ in range(40):
        made = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(14)} | {tokens.SPACE}
        pieces = [("<unk>", -9.0)] + [(p, float(-r.randrange(1, 4))) for p in sorted(made)]
        pieces += [(f"<0x{i:02X}>", -20.0) for i in range(256)]
        lib = library(pieces)
        for _ in range(20):
            text = "".join(r.choice("abcd ") for _ in range(r.randrange(1, 30)))
            assert own(pieces, text) == len(lib.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = library(tokens.vocabulary(tokens.MODEL))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.count_tokens(docs).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_chars, r.n_bytes) == (len(text[r.doc_id]), len(text[r.doc_id].encode()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(i % 3, t, 5) for i, t in enumerate(TEXTS)] + [(None, "a", 1)], "doc_id long, text string, n_tokens int")
    got = tokens.count_tokens(df).collect()
    assert len(got) == len(TEXTS) + 1 and [r.n_tokens for r in got[:2]] == [0, 0]
    assert tokens.count_tokens(df.limit(0)).collect() == []
