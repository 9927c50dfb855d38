import random
import re

import numpy as np
import pytest

from passagework.llm import minhash_dedup as M
from passagework.llm.graph import components
from passagework.llm.minhash_dedup import _band_keys, _bin_minima, _densify, drop_near_duplicates, near_duplicates
from passagework.llm.scratch import Scratch
from passagework.llm.words import distinct_by_text, mix


def brute(docs, k, percent=80):
    def runs(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = {d: runs(t) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= percent * either:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_groups_of_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append((len(docs) + 5, " ".join(text)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (4, 5):
        assert result(near_duplicates(df, shingle=k)) == brute(docs, k)


def test_chain_of_copies(spark):
    """Each is close to the next only, so that the ends are one component."""
    words = [f"c{i}" for i in range(120)]
    docs = [(i, " ".join(words[6 * i : 6 * i + 80])) for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(near_duplicates(df, shingle=4)) == brute(docs, 4)


@pytest.mark.parametrize("light", [1, 8, 1000])
def test_pairs_far_from_every_hub(spark, monkeypatch, light):
    """Copies of one source that share too little with it and with each other, and pairs among them that share enough."""
    monkeypatch.setattr("passagework.llm.minhash_dedup.LIGHT", light)
    monkeypatch.setattr("passagework.llm.minhash_dedup.PART", 3)
    monkeypatch.setattr("passagework.llm.minhash_dedup.BLOCK", 2000)
    rng = random.Random(11)
    source = [f"s{i}" for i in range(120)]
    docs = []
    for group in range(240):
        text = list(source)
        for i in range(rng.randrange(8), 120, 13):
            text[i] = f"own{group}-{i}"
        docs.append((len(docs), " ".join(text)))
        if group % 4 == 0:  # a near copy of this one only
            docs.append((len(docs), " ".join(text[:-1] + [f"end{group}"])))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = brute(docs, 4)
    assert sum(kept for _, _, kept in wanted.values()) == 240
    assert result(near_duplicates(df, shingle=4, bins=2, bands=1)) == wanted


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " end"), (9, "É é"), (10, "é é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as component", "2 as n", "3 as key", "4 as doc")
    assert result(near_duplicates(df, shingle=4)) == brute(docs, 4)
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "one two")], "doc_id long, text string"), allowMissingColumns=True)
    rows = near_duplicates(twice, shingle=4).collect()
    assert len(rows) == 21
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id} == {(d, c) for d, (_, c, _) in brute(docs, 4).items()}


def test_several_texts_of_one_id(spark):
    """Id 5 has two unlike texts, each with near copies; neither group joins the other."""
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    docs = [(5, " ".join(x)), (5, " ".join(y)), (7, " ".join([*x, "more"])), (8, " ".join([*y, "more"])), (3, " ".join([*y, "other"])), (9, " ".join(x))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, shingle=4).collect())
    assert found == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (8, 3, False), (9, 5, False)]
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()) == [(3, docs[4][1]), (5, docs[0][1])]


def test_dropped_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(1, a, 1), (1, a, 1), (1, a, 2), (2, a + " end", 3), (None, a, 4), (None, a, 4), (3, None, 5), (3, None, 5), (4, "", 6), (5, b, 7), (6, b, 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _did int")
    kept = sorted((r.doc_id, r.text) for r in drop_near_duplicates(df).collect() if r.doc_id)
    assert kept == sorted([(1, a), (3, None), (3, None), (4, ""), (5, b)], key=lambda x: (x[0], x[1] or ""))
    assert drop_near_duplicates(df).columns == df.columns and drop_near_duplicates(df).where("doc_id is null").count() == 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_densified_bins_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    agree = []
    for i in range(300):
        common, own = mix(rng.integers(1 << 60, size=16, dtype=np.uint64)), mix(rng.integers(1 << 60, size=4, dtype=np.uint64))
        both = np.concatenate([common, own[:2], common, own[2:]])
        hashes, at = distinct_by_text(both, np.array([0, 18, 36]))
        one, two = _densify(*_bin_minima(hashes, at, 128))
        agree.append((one == two).mean())
        assert (_band_keys(one[None], 32) == _band_keys(two[None], 32)).mean() <= 1
    assert abs(np.mean(agree) - 16 / 20) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 201), (201, 201), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(df, Scratch(spark)).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_repeated_rows_are_read_once(spark):
    """Two near copies of many rows each: one set a class is compared, whatever its rows; several texts of one id keep their own."""
    words = [f"w{i}" for i in range(200)]
    one, two = " ".join(words), " ".join(words[:-3])
    rows = [(1, one)] * 300 + [(2, two)] * 300 + [(3, " ".join(words[::-1]))] * 50 + [(3, one)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scratch = Scratch(spark)
    texts = docs.selectExpr("doc_id as id", "xxhash64(text) as text_hash", "text")
    classes = M._classes(scratch.save(M.signatures(texts, 5, 128, 32, M.SPACES), "signed"), scratch)
    assert M._sets(M._members(classes, scratch), classes, texts, 5, M.SPACES).count() == 2
    got = near_duplicates(docs).groupBy("doc_id", "component_id", "class_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 300), (2, 1, 2, 300), (3, 1, 1, 20), (3, 3, 3, 50)]
