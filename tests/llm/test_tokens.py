"""Token ids through parts are those of the whole text; decoding gives the text back."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import tokens as K

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(K.TOKENIZERS), reason="no tokenizer files")


@given(st.text(max_size=200), st.integers(3, 40))
@settings(max_examples=300, deadline=None)
def test_any_text(text, size):
    enc = K.encoding()
    assert K.encode_tree(text, enc, size) == enc.encode_ordinary(text)
    assert enc.decode(K.encode_tree(text, enc, size)) == text


@pytest.mark.parametrize("unit", ["a", "ab", " ", "\n ", "0", "é", "的", "-", "'s", "аб"])
def test_long_unsplit_text(unit):
    enc, rng = K.encoding(), random.Random(unit)
    text = "".join(unit if rng.random() < 0.97 else rng.choice("xyz") for _ in range(3000))
    for size in (100, 777):
        assert K.encode_tree(text, enc, size) == enc.encode_ordinary(text)


def test_operator(spark):
    enc = K.encoding()
    texts = {1: None, 2: "", 3: "  ", 4: "Hello <|endoftext|> world", 5: "word " * 400, 6: "z" * 5000, 7: "ß" * 700 + " end"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in K.encode(df, long=500).collect()}
    assert got == {k: enc.encode_ordinary(t) if t else [] for k, t in texts.items()}
    for long in (500, 20_000):
        assert {r.doc_id: r.n_tokens for r in K.sizes(df.unionAll(df.filter("doc_id = 7")), "doc_id", long=long).collect()} == {k: len(v) for k, v in got.items()}
    two = spark.createDataFrame([(1, "a " * 900), (1, "b " * 900), (1, "a " * 900)], "doc_id long, text string")
    assert sorted(r.ids for r in K.encode(two, long=500).collect()) == sorted(enc.encode_ordinary(x * 900) for x in ("a ", "b "))
    assert K.encode(df.limit(0)).count() == 0
