import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from passagework.llm.byte_bpe import LONG_PIECE, ByteBpe, decode, encode, round_trip_digests
from passagework.llm.words import text_chunks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
bpe = ByteBpe(PATH)
known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids_of(texts):
    import pyarrow as pa

    out = []
    for a, b, data, bounds in text_chunks(pa.array(texts, pa.string())):
        ids, at = bpe.encode(data, bounds)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    assert ids_of(texts) == [known.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abst'redlvm \n\t.,1é　\x1c", max_size=40), max_size=6))
def test_contractions_and_spaces(texts):
    assert ids_of(texts) == [known.encode_ordinary(t) for t in texts]


def test_long_pieces():
    rng = random.Random(1)
    texts = ["a" * 3000, "ab" * 2000, "".join(rng.choice("etaoin") for _ in range(LONG_PIECE + 700)), " " * 900 + "x", "é" * 700, "<|endoftext|>"]
    assert ids_of(texts) == [known.encode_ordinary(t) for t in texts]


def test_rows(spark):
    docs = [(1, "It's a round-trip, isn't it?"), (2, None), (3, ""), (None, "no id"), (1, "It's a round-trip, isn't it?"), (4, "ü" * 50 + " \n\n x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as value")
    rows = encode(df, PATH).collect()
    assert sorted(((r.doc_id, r.ids, r.exact) for r in rows), key=repr) == sorted(((d, known.encode_ordinary(t or ""), True) for d, t in docs), key=repr)
    back = decode(encode(df, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((d, t or "") for d, t in docs), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = round_trip_digests(df, PATH).collect()
    wanted = [(d, len(known.encode_ordinary(t or "")), sha(" ".join(map(str, known.encode_ordinary(t or ""))).encode()), sha((t or "").encode())) for d, t in docs]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests), key=repr) == sorted(wanted, key=repr)


def test_empty_table_and_null_ids_to_decode(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    rows = decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, ""), (2, "")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode(docs, PATH).collect()}
    assert got == {r.doc_id: known.encode_ordinary(r.text) for r in docs.collect()}
