import base64
import random

import pytest

from spanloom.llm import tokens as T

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def whole():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in T.vocabulary().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    bits = ["a", " the", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "'s", "'S", "don't", "12", "½", "é", "e\u0301", "中文", "한국", "مقطع", "👨\u200d👩", "<|endoftext|>", "!!", "_x_", "\u200b", "²", "Ⅷ", " \n ", "x" * 300]
    return [None, "", " ", "\n\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["word " * 30_000, "y" * 20_000]


def test_equals_encoding_whole_texts(spark, whole, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 50_000)
    data = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in data], "doc_id long, text string, block int, word string, ids int")
    got = {r.doc_id: r.ids for r in T.encode(df).collect()}
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in data}
    assert {r.doc_id: r.tokens for r in T.sizes(df).collect()} == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in T.decode(T.encode(df)).collect()}
    assert back == {i: t or "" for i, t in data}


def test_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in T.encode(df).collect()) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert T.encode(df.where("false")).count() == 0 and T.sizes(df.where("doc_id = 2")).first().tokens == 0


def test_letters_of_a_later_unicode(spark, whole):
    """Letters assigned in Unicode 14 and 15 (Vithkuqi, Kawi, a Latin and an Arabic one), beside words that are plain."""
    new = "\U00010597\U00010598 \U00011f02 \ua7d0 \u0870"
    data = [(1, new), (2, f"plain words, {new * 3} and 12 more"), (3, "plain words"), (4, None)]
    got = {r.doc_id: r.ids for r in T.encode(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in data}
