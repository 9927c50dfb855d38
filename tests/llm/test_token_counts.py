import numpy as np
import public_tokenizers
import pytest
import tiktoken

from passagework.llm.byte_bpe import ByteBpe
from passagework.llm.queries import op10_token_counts
from passagework.llm.scratch import Scratch
from passagework.llm.token_counts import END_OF_DOCUMENT, document_token_counts, flat_token_files

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def files(spark, streams, size):
    rows = [(f, b, np.array(s[i : i + size], "<u2").tobytes()) for f, s in enumerate(streams) for b, i in enumerate(range(0, max(len(s), 1), size))]
    return spark.createDataFrame([(f, b, bytearray(t)) for f, b, t in rows], "file long, block long, tokens binary")


def brute(streams, end):
    out = []
    for f, s in enumerate(streams):
        start = n = 0
        for i, x in enumerate(s):
            if x == end:
                out.append((f, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(s):
            out.append((f, n, start, len(s) - start, False))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_blocks_cut_anywhere(spark, size, monkeypatch):
    monkeypatch.setattr("passagework.llm.token_counts.SPAN", 4)
    rng = np.random.default_rng(size)
    streams = [np.where(rng.random(n) < p, 9, 1).tolist() for n, p in ((0, 0.5), (1, 1.0), (50, 0.0), (200, 0.02), (300, 0.3), (64, 1.0))]
    df = files(spark, streams, size).selectExpr("*", "1 as n", "2 as span", "'x' as ends")
    got = sorted((r.file, r.doc_no, r.start, r.n_tokens, r.closed) for r in document_token_counts(df, 9).collect())
    assert got == brute(streams, 9)
    assert sorted((r.file, r.doc_no, r.start, r.n_tokens, r.closed) for r in document_token_counts(df.unionByName(df), 9).collect()) == got


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 0, bytearray(b"\x01\x00")), (0, None, bytearray(b"\x01\x00")), (1, 0, None), (1, 1, bytearray(b"\x01\x00\x02\x00"))], "file long, block long, tokens binary")
    assert [tuple(r) for r in document_token_counts(df, 9).collect()] == [(1, 0, 0, 2, False)]
    assert document_token_counts(df.limit(0), 9).count() == 0


def test_given_documents(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ByteBpe(PATH).ranks, special_tokens={})
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "null id"), (-3, "twice"), (-3, "twice")], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd)
    files, documents = flat_token_files(docs.repartition(3), PATH, Scratch(spark), block_tokens=500)
    rows = document_token_counts(files, END_OF_DOCUMENT).join(documents, ["file", "doc_no"]).collect()
    assert all(r.closed for r in rows)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=key) == sorted(((r.doc_id, len(known.encode_ordinary(r.text or ""))) for r in docs.collect()), key=key)


def test_of_differing_repeated_blocks_the_longest_counts(spark):
    df = spark.createDataFrame([(0, 0, bytearray(b"\x01\x00\x09\x00")), (0, 0, bytearray(b"\x01\x00\x01\x00\x09\x00")), (0, 0, None)], "file long, block long, tokens binary")
    assert [tuple(r) for r in document_token_counts(df, 9).collect()] == [(0, 0, 0, 2, True)]


def test_query_against_brute_force(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ByteBpe(PATH).ranks, special_tokens={})
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: len(known.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op10_token_counts(spark, folder).collect()} == want
