import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import decode, encode, n_tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(spark, plain, rows, **sizes):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids long, h string")
    got = sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in decode(encode(docs, PATH, PATTERN, **sizes), PATH).collect())
    want = sorted((i is None, i or 0, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert got == want


def test_small_chunks_are_stitched(spark, plain):
    hard = "They'll   go\n\n  there, don't\t\tthey? " * 7 + "x" * 90 + " \n \n b" * 9 + "Ünïcödé 漢字かな交じり文 123456  " * 5 + "'re've''s 's'" * 12
    rows = [(1, hard), (1, hard), (2, hard[3:]), (3, None), (4, ""), (None, "  a  b " * 40), (5, " " * 300), (6, "y" * 400), (7, "short"), (8, "\n" + "z z'l" * 80), (9, "\x1c a\x1c" * 60)]
    same(spark, plain, rows, chunk=50, overlap=16)
    same(spark, plain, rows, chunk=64, overlap=40)
    same(spark, plain, [])


def test_long_text_at_real_sizes(spark, plain):
    text = "La   maison's rouge, 2024!\n\tWe'd   " * 3000
    same(spark, plain, [(1, text), (2, "q" * 70_000 + text)])


def test_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = encode(docs, PATH, PATTERN, chunk=2000, overlap=100)
    got = {r.doc_id: (r.n, r.s) for r in encoded.select("doc_id", n_tokens(F.col("ids")).alias("n"), F.sha2("ids", 256).alias("s")).collect()}
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
