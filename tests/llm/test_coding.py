"""Byte-pair coding against the tokenizers library as it is, exact round trips, and both merging ways against each other."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesloom.llm import bytepairs
from tests.llm.corpus import SCHEMA, corpus

ODD = [
    "", " ", "  a  b ", "\n\n x", "a b   c", "don't we'll  x I'M", "<|endoftext|> end", "a <|endoftext|>", "<|endoftext|><|endoftext|>x  <|endoftext|>  y",
    "<|endoftext", "Привет мир 你好 😀", "x́ é", " \t\n", "tab\t tab \n  two", "123 4567 ...!!", "a\x1c b\x85 c\xa0 d", "　 x  y", "a\x00b \x7f", "ſ ﬁ Ǆ ²³ ½ Ⅷ ⅷ",
    "word" * 400, "ab" * 90 + " " + "zq9" * 200, "=" * 500, " " * 300 + "x", "é" * 300, "﻿x", "𝒳𝒴 𐍈", "١٢٣ १२३",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return bytepairs.RankArray()


def check(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:60]
    assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False) == text


def test_equals_the_library(own, library):
    for text in ODD + [r[1] for r in corpus() if r[1]]:
        check(own, library, text)


def test_every_character_in_context(own, library):
    """Cutting depends on the class of a character: each one up to U+2FFF beside letters, digits, signs, blanks and itself."""
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 64):
        check(own, library, " ".join(f"a{chr(c)}b 1{chr(c)} .{chr(c)}{chr(c)} {chr(c)} x" for c in points[start : start + 64]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'st  \n\t1.,<|endoftext|>é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    check(_coder(), _library(), text)


def _coder():
    return bytepairs.coder(None)


_held = []


def _library():
    if not _held:
        _held.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return _held[0]


def test_both_ways_of_merging(own):
    rng = random.Random(1)
    for _ in range(300):
        word = bytes(rng.choices(b"abeinrst th" if rng.random() < 0.7 else bytes(range(256)), k=rng.randint(1, 150)))
        assert own.merged(word) == own.merged_long(word)


def test_any_ids_can_be_decoded(own, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([70000, 64, 1 << 31], "<u4").tobytes()) == b"a"


def test_frames(spark, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "FLUSH_BYTES", 1000)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, bytepairs.digest(bytepairs.encode(docs, decoded=True)).collect()), key=repr)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bytepairs.decode(bytepairs.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert bytepairs.encode(docs.limit(0)).count() == 0
    odd = spark.sql("SELECT 'x' AS doc_id, cast(X'61FF62' AS string) AS text")
    assert bytepairs.decode(bytepairs.encode(odd)).collect() == [("x", "a�b")]
