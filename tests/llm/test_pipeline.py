import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from passagework.llm.byte_bpe import decode
from passagework.llm.minhash_dedup import near_duplicates
from passagework.llm.toxicity import drop_toxic, fit_toxicity, toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tables(spark, folder):
    """Clean documents, toxic ones, copies, a leak, a secret and odd rows."""
    word = lambda i, j: f"w{(i * 7919 + j * 104729) % 3001}"
    text = lambda i, n=60: " ".join(word(i, j) for j in range(n))
    docs = [(i, text(i)) for i in range(40)] + [(100 + i, f"vile worm {text(200 + i)}") for i in range(20)]
    docs += [(200, text(3)), (201, text(3) + " more"), (202, f"see {text(900, 20)} end {text(901)}"), (203, f"{text(902)} password=hunter22 {text(903)}"), (204, None), (205, ""), (None, text(904))]
    labels = [(i, 1, 0) for i in range(30)] + [(100 + i, 1, 1) for i in range(15)]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, text(900, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs)


def test_stages_take_effect(spark, tmp_path):
    given = _tables(spark, str(tmp_path))
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left[name] = {r.doc_id for r in docs.collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        if name == "secret_scans":
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    clean = {*range(40), 202, 203, 204, 205, None}
    assert left["toxicity"] == clean | {200, 201}
    assert left["minhash_near_dedup"] == clean
    assert left["benchmark_decontamination"] == left["secret_scans"] == left["byte_bpe_encoding"] == clean - {202}
    assert texts[203][0] == given[203].replace("password=hunter22", "[secret]") and texts[203][1] == len(texts[203][0])
    assert all(texts[i] == (given[i], len(given[i])) for i in range(40)) and texts[204] == (None, None)
    back = {r.doc_id: r.text for r in decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert back == {d: t or "" for d, (t, _) in texts.items()} and docs.where("not exact").count() == 0
    assert {r.doc_id: list(r.ids) for r in P.run(spark, str(tmp_path)).collect()} == {r.doc_id: list(r.ids) for r in docs.collect()}


def test_odd_rows_of_each_stage(spark, tmp_path):
    """Null ids, repeated rows, several texts of one id, very long texts: each row has the fate of its own text."""
    given = _tables(spark, str(tmp_path))
    text = lambda i: given[i]
    leak, toxic, long = given[202], given[103], " ".join(f"long{i % 9001}" for i in range(60_000)) + " password=hunter22"
    rows = [(None, leak), (None, toxic), (None, text(1)), (7, text(1)), (7, text(1)), (7, text(2)), (8, leak), (8, text(4)), (9, long), (10, long), (11, None), (11, None), (12, toxic), (12, text(5)), (13, "token=abcdefg"), (13, "token=abcdefg")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [
        [r for r in rows if r[1] != toxic],
        [(None, leak), (None, text(1)), (7, text(1)), (7, text(2)), (8, leak), (8, text(4)), (9, long), (11, None), (11, None), (12, text(5)), (13, "token=abcdefg")],
        [(None, text(1)), (7, text(1)), (7, text(2)), (8, text(4)), (9, long), (11, None), (11, None), (12, text(5)), (13, "token=abcdefg")],
    ]
    want.append([(d, t and t.replace("password=hunter22", "[secret]").replace("token=abcdefg", "[secret]")) for d, t in want[-1]])
    for (name, stage), rows_left in zip(P.STAGES, want, strict=False):
        before = docs
        docs = stage(spark, docs, str(tmp_path)) if name != "toxicity" else drop_toxic(docs, fit_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")))
        docs = spark.createDataFrame(docs.collect(), before.schema)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(rows_left, key=repr), name
    last = P.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(want[-1]) and last.where("not exact").count() == 0


def test_empty_tables(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    fine = docs.join(toxicity_scores(docs, model).where("kept").select("doc_id"), "doc_id", "left_semi")
    kept = {r.doc_id for r in near_duplicates(fine).where("kept").collect()}
    benchmark = [r.text.lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in fine.collect() if any(b in r.text.lower() for b in benchmark)}
    out = {r.doc_id for r in P.run(spark, folder).select("doc_id", F.size("ids").alias("n")).collect()}
    assert out <= kept - leaks and len(kept - leaks - out) <= 3


def test_whole_pipeline_against_brute_force(spark):
    """All stages over the given documents, each the long way in plain Python on what the one before it kept: the same rows, with the same token ids."""
    import numpy as np
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from passagework.llm.toxicity import _features
    from passagework.llm.words import NON_ALPHANUMERIC, Words
    from test_decontaminate import brute as leaks
    from test_minhash_dedup import brute as classes
    from test_secret_scan import brute as secrets

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def toxic(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes = set(_features(Words(data, np.array([0, len(data)]), NON_ALPHANUMERIC))[0].tolist())
        return 1 / (1 + np.exp(model.cuts[0] - sum(weights.get(h, 0.0) for h in hashes))) >= 0.5

    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(left) == docs.count()
    left = {d: t for d, t in left.items() if not toxic(t)}
    left = {d: left[d] for d, (_, _, kept) in classes(list(left.items()), 5).items() if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    runs = lambda t: {tuple(w[i : i + 5]) for w in [re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())] for i in range(max(1, len(w) - 4))}
    near = [(d, i) for i, x in enumerate(map(runs, (x for _, x in items))) for d, t in left.items() if x & runs(t or "")]  # others share no run
    held = {d for d, i in near if leaks([(d, left[d])], [items[i]])}
    left = {d: t for d, t in left.items() if d not in held}
    masked = 0
    for d, text in left.items():
        out, at = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in secrets(text)[-1].split(",") if s):
            out, at, masked = out + (text[at:a] + "[secret]" if a >= at else ""), max(at, b), masked + 1
        left[d] = out + (text or "")[at:]
    bpe = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in P.run(spark, folder).collect()}
    assert got == {d: bpe.encode_ordinary(t) for d, t in left.items()}
    assert len(left) < docs.count() - 5
