import hashlib

import numpy as np
import pytest
from brute_force import ODD, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import catalog
from loomgraph.llm.byte_bpe import encoder
from loomgraph.llm.word_bpe import codec, digests, encode

SF = "/root/testdata/sf0.001"


def library(path):
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def test_query_equals_the_library(spark):
    lib = library(catalog.WORD_TOKENIZER)
    got = {r.doc_id: r for r in catalog.QUERIES["op2_pair_index_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_documents(spark):
    lib = library(catalog.WORD_TOKENIZER)
    rows = encode(frame(spark, ODD), catalog.WORD_TOKENIZER).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in rows), key=key) == sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in ODD), key=key)
    assert digests(frame(spark, []), catalog.WORD_TOKENIZER).count() == 0


TEXT = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["'s", "'ll ", " I'VE", "<|startoftext|>", "the ", "  ", "\n", "1234", "é", "İ", "Σ", "ﬁ", "!!!"])), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
@pytest.mark.parametrize("kind", ["word", "byte"])
def test_any_text(kind, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    path = catalog.WORD_TOKENIZER if kind == "word" else catalog.BYTE_TOKENIZER
    made = codec(path) if kind == "word" else encoder(path)
    lib = library(path)
    for t, ids in zip(texts, made.encode(texts)):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
        if kind == "word":
            assert made.decode(ids).decode() == lib.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_every_code_point(kind):
    path = catalog.WORD_TOKENIZER if kind == "word" else catalog.BYTE_TOKENIZER
    made, lib = codec(path) if kind == "word" else encoder(path), library(path)
    points = [c for c in range(0x33000) if not 0xD800 <= c < 0xE000] + [0x50000, 0xE0001, 0xE0100, 0xF0000, 0x10FFFF]
    texts = ["".join(f"{chr(c)}a 1{chr(c)}{chr(c)}b" for c in points[a : a + 500]) for a in range(0, len(points), 500)]
    for t, ids in zip(texts, made.encode(texts)):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_long_texts_and_added_tokens_take_the_index(monkeypatch):
    import tokenizers

    text = ("Some <|endoftext|>words<|startoftext|><|endoftext|> and 12 more. " * 20_000) + "<|startoftext|>"
    wanted = library(catalog.WORD_TOKENIZER).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokenizers.Tokenizer, "encode", None, raising=False)
    assert [i.tolist() for i in codec(catalog.WORD_TOKENIZER).encode(["", text, "<|endoftext|>"])] == [[], wanted, [49407]]
