"""Byte-level BPE and token counts against the public libraries."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from certus.llm import bpe, token_counts
from certus.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    alphabet = [*"aab  \n\t't s'12.é漢字😀\x85\x1c,!?the", "<|endoftext|>", "   ", "ing", "'ll", " \u2028"]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 80))) for _ in range(1500)]
    return [*made, "", None, "a" * 3000, "ab" * 1500, " " * 2500, "word " * 20_000, "x", "x"]


def test_encoding_and_decoding(spark, texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded binary")
    rows = bpe.encode_documents(docs, bpe.read_ranks(path), P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text), text[:50]
        assert bytes(r["decoded"]) == text.encode()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_encoded_once(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (QUERIES["op6_byte_bpe"](spark, "/root/testdata/sf0.001"), corpus_pipeline.tokens(spark, documents, "")):
        assert plan_of(df).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan_of(df)


def test_long_piece_merges_like_a_short_one():
    vocabulary = bpe._vocabulary(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    for piece in (b"ab" * 500, "été漢".encode() * 90, b"a" * 999):
        assert vocabulary._merge_long(piece).tobytes() == vocabulary.encode_pieces([piece])[0]


def test_counts(spark, texts):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = token_counts.count_tokens(docs, token_counts.read_tokenizer(path), P.PATTERN).collect()
    want = [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in rows} == {i: (n, len((t or "").encode())) for i, (n, t) in enumerate(zip(want, texts))}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none, bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).count() == 0
    assert none.select(bpe.bpe_decode(bpe.bpe_encode(F.col("text"), b"", P.PATTERN), b"")).count() == 0
    assert none.select(token_counts.token_count(F.col("text"), token_counts.read_tokenizer(P.path("byte_bpe_50k.json")), P.PATTERN)).count() == 0
