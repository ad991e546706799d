import os

import pytest
from hypothesis import given, settings, strategies as st

from quillmere.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.read_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    ranks = B.read_ranks()
    return B.Coder(B.serialise(ranks), ranks)


TEXTS = ["", " ", "Hello  world\n\n it's 1234567", "naïve café ß 東京タワー 🙂🙂", "\t\t x\r\n", "a" * 5000, "<|endoftext|>", "\x00\x01\xa0\xad", "don't we'll", "▁under▁bar", "  leading"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_another_tokenizer(text, coder, reference):
    ids, stops = coder.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)
    assert coder.decode(ids).tobytes() == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"])), max_size=5))
def test_any_text(texts):
    import tiktoken

    global _pair
    try:
        coder, other = _pair
    except NameError:
        ranks = B.read_ranks()
        coder, other = _pair = B.Coder(B.serialise(ranks), ranks, store=50), tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, stops = coder.encode(texts)
    for i, t in enumerate(texts):
        part = ids[stops[i] : stops[i + 1]]
        assert part.tolist() == other.encode_ordinary(t)
        assert coder.decode(part).tobytes() == t.encode()


def test_frame_round_trip(spark, reference):
    rows = [(i, t, i) for i, t in enumerate([*TEXTS, None, "x y " * 300_000])] + [(None, "again", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = B.encode(df)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "n_tokens_1", "round_trip"]
    got = out.collect()
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        t = text[r["doc_id"]]
        assert r["token_ids"] == (None if t is None else reference.encode_ordinary(t))
        assert r["n_tokens_1"] == (None if t is None else len(r["token_ids"])) and r["round_trip"] == (None if t is None else True)
    back = B.decode(out.select("doc_id", "token_ids"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == text
    assert B.encode(df.limit(0)).collect() == []


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([([1, 10**6],), ([None],), ([],), (None,), ([-1],)], "token_ids array<int>")
    assert [r["text"] for r in B.decode(df).collect()] == [None, None, "", None, None]


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        B.serialise({b"a": 0, b"b": 2})


def test_query_against_another_tokenizer(spark, sf_dir, reference):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = B.op5_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(text)
    assert all(r["token_ids"] == reference.encode_ordinary(text[r["doc_id"]]) and r["round_trip"] for r in got)


def test_decode_resolves_names_as_spark_does(spark):
    df = spark.createDataFrame([([72, 73], 1)], "Token_IDs array<int>, text int")
    out = B.decode(df)
    assert out.columns == ["Token_IDs", "text", "text_1"] and out.count() == 1
