import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe
from factloom.llm.encode import encode


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


MODEL = bpe.load(bpe.default_path())


def test_odd_texts(reference):
    r = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 3000, "=-" * 900, "中文" * 700, "é́ ñ\r\n\t x", "😀👩‍👩‍👧 ok", "I'll won't 'S 's"]
    texts += ["".join(r.choice("aabcd =-\n\té中文🙂'0123") for _ in range(r.randrange(200))) for _ in range(400)]
    got = MODEL.ids(texts).to_pylist()
    assert got == [reference(t) for t in texts]
    assert MODEL.counts(texts).tolist() == [len(g) for g in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",))), max_size=6))
def test_any_texts(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_any_texts, "t") else test_any_texts.t
    t.encode_special_tokens = True
    test_any_texts.t = t
    assert MODEL.ids(texts).to_pylist() == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_words_take_the_heap(reference, monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (10, 300, 5000, 30000)] + ["a" * 9000, "中" * 4000 + " x " + "é" * 5000]
    assert MODEL.ids(texts).to_pylist() == [reference(t) for t in texts]
    monkeypatch.setattr(bpe, "HEAP_BYTES", 0)
    assert bpe.Bpe(bpe.default_path()).ids(["", "Hello  world's 12", *texts[:2]]).to_pylist() == [reference(t) for t in ("", "Hello  world's 12", *texts[:2])]


def test_memory_of_words_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 20)
    m = bpe.Bpe(bpe.default_path())
    for k in range(8):
        texts = [f"w{k}{j} " * 3 + "x" * 100 for j in range(10)]
        assert m.ids(texts).to_pylist() == [reference(t) for t in texts]
    assert len(m.known) < 100


def test_encode_rows(spark, reference):
    rows = [(1, "Hello  world", "x"), (2, "", "x"), (3, None, "x"), (4, "Hello  world", "x"), (4, "Hello  world", "x"), (None, "a", "x"), (5, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df)
    assert got.columns == ["doc_id", "ids"]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got.collect()) == sorted((i or 0, reference(t or "")) for i, t, _ in rows)
    assert encode(df.filter("false")).count() == 0
