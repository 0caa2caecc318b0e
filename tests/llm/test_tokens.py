import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm import tokens

NAME = "byte_bpe_50k"


@pytest.fixture(scope="module")
def plain():
    return tokens.encoding(tokens.TOKENIZER_DIR, NAME).encode_ordinary


def tree(leaf):
    encode = tokens.encoding(tokens.TOKENIZER_DIR, NAME).encode_ordinary
    return tokens.TreeEncoder(encode, regex.compile(tokens.pattern(tokens.TOKENIZER_DIR)).findall, leaf)


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype=np.int32).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x1c  　ab'sté1.!世🏰"), max_size=40), st.sampled_from([1, 2, 3, 7, 4096]))
def test_same_ids_as_the_whole(text, leaf):
    encode = tokens.encoding(tokens.TOKENIZER_DIR, NAME).encode_ordinary
    assert ids(tree(leaf)(text)) == encode(text)


def test_very_long_texts(plain):
    r = random.Random(1)
    for text in ("x" * 20_000, " ".join(r.choice(["a", "bb", "don't", "\n", "  "]) for _ in range(30_000)), "世界" * 5000, " " * 9000):
        assert ids(tree(512)(text)) == plain(text)


def test_windows_end_where_scans_agree():
    """Of two long parts only what is near the border is scanned again."""
    t = tree(64)
    seen = []
    scan = t.scan
    t.scan = lambda text: seen.append(len(text)) or scan(text)
    text = "The mill's wheel, they'll say, turned 1234 times.\n\n  " * 400
    assert "".join(t.tree(text)) == text and max(seen) <= 128


def test_corpus(spark, plain):
    texts = [(1, "Hello  world"), (2, ""), (3, None), (4, "  \n "), (5, "<|endoftext|>"), (1, "Hello  world")]
    got = tokens.encode_corpus(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, ids string"))
    assert got.columns == ["doc_id", "ids"] and got.schema["ids"].dataType.simpleString() == "array<int>"
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((d, plain(t) if t else []) for d, t in texts)
    assert tokens.decode(plain("naïve 🏰\n")) == "naïve 🏰\n"
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
