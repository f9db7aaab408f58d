import pytest

from rollbook.llm import tokenizing

TEXTS = ["", None, " ", "\n\n  x", "a  b\tc", "don't I'll", "naïve café 漢字かな", "🛠️ 👨‍🔧 ﬁx #69/385", "x" * 5000, "1234567 ½ Ⅷ", "a b c\u0085d\x1ce", "<|endoftext|>", "\U0001FADF \U0001E4D0\U0001E4D1", "hot " * 30_000]


def test_against_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{tokenizing.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenizing.encode(df.union(df)).collect()}
    want = {i: e.ids for i, e in enumerate(tok.encode_batch([t or "" for t in TEXTS], add_special_tokens=False))}
    assert got == want


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in tokenizing.decode(tokenizing.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_unknown_id(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokenizing.decode(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>")).collect()


def test_empty(spark):
    assert tokenizing.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
