"""What the documentation says of the vocabulary file and of the counts' distance from its own tokenizer."""

import os

import pyarrow.parquet as pq
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from lumenfold.llm import tokens

README = os.path.join(os.path.dirname(__file__), "..", "..", "README.md")


def test_distance_from_the_own_tokenizer_is_stated():
    model = sentencepiece_model_pb2.ModelProto()
    with open(tokens.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    assert model.trainer_spec.model_type == model.trainer_spec.BPE
    text = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    got = tokens.counter(tokens.MODEL).texts(text)
    own = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL).encode([t or "" for t in text.to_pylist()])]
    figures = [f"{sum(int(a) != b for a, b in zip(got, own, strict=True))}", f"{got.sum():,}", f"{sum(own):,}", f"{got.sum() / sum(own) - 1:+.0%}".replace("%", " %")]
    with open(README) as f:
        for doc in (tokens.__doc__, f.read()):
            assert "BPE" in doc and all(x in doc for x in figures), figures
