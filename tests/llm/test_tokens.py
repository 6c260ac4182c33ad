"""BPE encoding, decoding and token counts against the public library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import automaton, bpe, common, tokencount, vocabulary

PATH = vocabulary.default_path()
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def check(texts):
    at, raw = common.text_buffers(pa.array(texts, pa.string()))
    tool = bpe.encoder(PATH)
    got, want = [x.tolist() for x in tool.texts(at, raw)], library(texts)
    assert got == want
    assert [tool.decode(np.array(x, np.int64)).decode() for x in got] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want] == texts
    assert tokencount.transducer(PATH).counts(at, raw).tolist() == [len(x) for x in want]


SHAPES = ["", " ", "  ", "\n", "a", "'s", "it's 'tis we'll I'VE 'd''d", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " <|endoftext|> \n", "hello   world  \n\n  x", "1²3½ Ⅳ", "日本語テキスト", "é́", "😀😀 😀", "  x", "aaaa" * 700, " " * 300, "=" * 999]


def test_shapes():
    check(SHAPES)


def test_random_texts():
    rng = random.Random(5)
    alphabet = "abcdeéß 's\n\t.,!?#<|>0123中文́"
    check(["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(800)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    check([x for x in texts if x.isprintable() or x.encode("utf-8", "ignore").decode() == x])


def test_vectorised_compatibility_equals_the_plain_one():
    v = vocabulary.load(PATH)
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    assert v.compatible_many(left, right).tolist() == [v.compatible(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]


def test_compatible_pairs_are_those_that_bpe_gives_back():
    v = vocabulary.load(PATH)
    rng = random.Random(2)
    words = [i for i in range(256, 20_000) if v.bytes[i].isalpha() and v.bytes[i].isascii()]
    for _ in range(300):
        a, b = rng.choice(words), rng.choice(words)
        assert v.compatible(a, b) == (LIBRARY.encode((v.bytes[a] + v.bytes[b]).decode()).ids == [a, b])


def test_few_states_are_made_anew_without_a_change():
    tool = tokencount.Transducer(PATH, most=50)
    for texts in (["the quick brown fox"] * 3, ["jumps over", "the lazy dog" * 50], ["the quick brown fox"]):
        at, raw = common.text_buffers(pa.array(texts))
        assert tool.counts(at, raw).tolist() == [len(x) for x in library(texts)]


def test_automaton_finds_the_longest_word():
    words = {b"a": 0, b"ab": 1, b"bab": 2, b"bc": 3, b"bca": 4, b"c": 5, b"caa": 6}
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    got = automaton.Automaton(words).matches(np.frombuffer(text, np.uint8), np.array([0]), chunk=64)
    for i in range(len(text)):
        fit = [(len(w), k) for w, k in words.items() if text[: i + 1].endswith(w)]
        assert got[i] == (max(fit)[1] if fit else -1)


def test_queries(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "x" * 200_000), (None, "it's"), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    out = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(df).collect()}
    for i, t in rows:
        ids = library([t or ""])[0]
        r = out[i, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.exact
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    counts = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count(df).collect())
    assert counts == sorted((i or 0, len((t or "").encode()), len(library([t or ""])[0]), len(library([t or ""])[0]) > 1024) for i, t in rows)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[1] == "" and back[3] == "hello world" and back[5] == "<|endoftext|>"
    none = df.where("false")
    assert bpe.round_trip(none).count() == tokencount.count(none).count() == 0


@pytest.mark.parametrize("name", ["sf0.001"])
def test_whole_table(spark, name):
    df = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    want = {r.doc_id: len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in tokencount.count(df).collect()} == want
    assert all(r.exact for r in bpe.round_trip(df).collect())
