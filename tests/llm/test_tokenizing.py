import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import tokenizing as K

pytest.importorskip("public_tokenizers")
ENC = K.encoding(K.vocabulary_path())
TEXTS = [None, "", " ", "\n\n\t", "Hello world", "don't 've 's", "naïve café — 日本語。テスト、です", "👩‍👩‍👧 x", "<|endoftext|>", "a\u0000b", "\ud7ff", "  lead and trail  ", "C:\\temp\\log", "x" * 3000, " " * 3000]


def test_whole_corpus_with_defined_empties(spark):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(TEXTS + TEXTS[:2])], "doc_id long, text string, c0 int, made string")
    got = {r["doc_id"]: list(r["ids"]) for r in K.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: ENC.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS + TEXTS[:2])}


def test_bytes_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    raw = {r["doc_id"]: bytes(r["raw"]) for r in K.decode_ids(K.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert raw == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, ["doc_id", "source"], "text").collect()} == {i: len(ENC.encode_ordinary(t)) if t else 0 for i, t in enumerate(TEXTS)}
    assert K.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 _'s\n。、é日 .!", max_size=120), st.integers(1, 30))
def test_safe_cuts_do_not_change_ids(text, size):
    parts = K.safe_parts(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["word " * 100_000, "a" * 200_000, " " * 200_000, "日本語。" * 50_000, "\n" * 100_000, "x1_" * 70_000, "ab\ufeff" * 60_000])
def test_very_long_texts(text):
    assert ENC.decode_bytes(K.encode_text(ENC, text)) == text.encode()
