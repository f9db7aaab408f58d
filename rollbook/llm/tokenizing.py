"""Encoding of a whole corpus with a public tokenizer, each distinct word once.

Texts are cut into pre-tokens in the JVM, with positions. The distinct words of the corpus (partial
aggregation first, then one shuffle of distinct words) are encoded once each. Ids are joined back to
positions, and documents are put together by position. Words above a fixed share of all tokens, at
most 1,000 by arithmetic, join through a broadcast; all others through a shuffle. Decoding joins the
token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rollbook.work import cut, hot_join

#: Folder with the vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@pandas_udf(T.ArrayType(T.StringType()))
def _split_udf(s: pd.Series) -> pd.Series:
    import regex

    rx = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return s.map(lambda t: None if t is None else rx.findall(t))


def pretokens(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, word). ``h`` tells apart rows that share a ``doc_id`` with different texts.

    Texts with code points that the JVM's tables do not know are split in Python, whose tables are newer.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null and text != ''")
    old = F.col("text").rlike(r"\p{Cn}")
    jvm = base.where(~old).select("doc_id", "h", F.posexplode(F.regexp_extract_all("text", F.lit("(?U)" + PATTERN), F.lit(0))).alias("pos", "word"))
    py = base.where(old).select("doc_id", "h", F.posexplode(_split_udf("text")).alias("pos", "word"))
    return jvm.unionByName(py)


def vocabulary(words: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """(word, n, ids) of the distinct words of (word, n)."""
    path = f"{folder}/{tokenizer}.tiktoken"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield b.assign(ids=[enc.encode_ordinary(w) for w in b["word"]])

    return words.mapInPandas(encode, "word string, n bigint, ids array<int>")


def whole_words(spark: SparkSession, tokenizer: str, folder: str) -> DataFrame:
    """(word, id): the entries of the vocabulary that are text; a word that is one is encoded by it alone.

    They hold most of all occurrences and are at most as many as the vocabulary (50,256), so they are broadcast.
    """
    rows = []
    for b, i in ranks(f"{folder}/{tokenizer}.tiktoken").items():
        try:
            rows.append((b.decode("utf-8"), i))
        except UnicodeDecodeError:  # part of a character
            continue
    return F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["word", "id"]), "word string, id int"))


def _encoded(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """(doc_id, h, pos, ids). Words that are no entry of the vocabulary are shuffled, and encoded once each."""
    pre = pretokens(docs).join(whole_words(docs.sparkSession, tokenizer, folder), "word", "left")
    rest = cut(pre.where("id is null").drop("id"), "p8-rest")
    words = rest.groupBy("word").agg(F.count("*").alias("n"))
    vocab = cut(vocabulary(words, tokenizer, folder), "p8-words")
    total = vocab.agg(F.sum("n")).first()[0] or 0
    built = hot_join(rest, vocab.select("word", "ids"), "word", vocab.select("word", "n"), total)
    return pre.where("id is not null").select("doc_id", "h", "pos", F.array("id").alias("ids")).unionByName(built.select("doc_id", "h", "pos", "ids"))


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): ids of each text without special tokens.

    Null and empty texts give an empty list. Equal rows give one row; rows that share a ``doc_id``
    with different texts give one row each. Columns beyond ``doc_id`` and ``text`` are not read.
    """
    part = _encoded(docs, tokenizer, folder).select("doc_id", "h", F.struct("pos", "ids").alias("p"))
    every = docs.select("doc_id", F.xxhash64("text").alias("h"), F.lit(None).cast("struct<pos:int,ids:array<int>>").alias("p"))
    whole = part.unionByName(every).groupBy("doc_id", "h").agg(F.collect_set("p").alias("p"))
    return whole.select("doc_id", F.flatten(F.transform(F.sort_array("p"), lambda x: x["ids"])).alias("ids"))


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, h, tokens) of the texts that are not empty."""
    docs = cut(docs.select("doc_id", "text").distinct(), "p9-texts")
    pre = pretokens(docs).join(whole_words(docs.sparkSession, tokenizer, folder), "word", "left")
    rest = cut(pre.where("id is null").groupBy("doc_id", "h", "word").agg(F.count("*").alias("k")), "p9-rest")
    words = rest.groupBy("word").agg(F.sum("k").alias("n"))
    vocab = cut(vocabulary(words, tokenizer, folder).select("word", "n", F.size("ids").alias("size")), "p9-words")
    total = vocab.agg(F.sum("n")).first()[0] or 0
    sized = hot_join(rest, vocab.select("word", "size"), "word", vocab.select("word", "n"), total).select("doc_id", "h", (F.col("k") * F.col("size")).alias("tokens"))
    known = pre.where("id is not null").groupBy("doc_id", "h").agg(F.count("*").alias("tokens"))
    return known.unionByName(sized).groupBy("doc_id", "h").agg(F.sum("tokens").alias("tokens"))


def token_bytes(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, bytes): the vocabulary as a table."""
    rows = pd.DataFrame([(i, b) for b, i in ranks(f"{folder}/{tokenizer}.tiktoken").items()], columns=["id", "bytes"])
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); an empty or null list gives an empty text. Ids outside the vocabulary raise.

    The token-byte table has as many rows as the vocabulary (50,256) and is broadcast.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, tokenizer, folder))
    keyed = encoded.select("doc_id", F.xxhash64("ids").alias("h"), "ids")
    parts = keyed.select("doc_id", "h", F.posexplode("ids").alias("pos", "id")).join(table, "id", "left")
    parts = parts.withColumn("bytes", F.coalesce(F.hex("bytes"), F.raise_error(F.lit("id outside the vocabulary")).cast("string")))
    every = keyed.select("doc_id", "h", F.lit(None).cast("struct<pos:int,bytes:string>").alias("p"))
    whole = parts.select("doc_id", "h", F.struct("pos", "bytes").alias("p")).unionByName(every).groupBy("doc_id", "h").agg(F.collect_set("p").alias("p"))
    text = F.array_join(F.transform(F.sort_array("p"), lambda x: x["bytes"]), "")
    return whole.select("doc_id", F.decode(F.unhex(text), "utf-8").alias("text"))
