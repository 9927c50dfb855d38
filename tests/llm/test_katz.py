import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import katz

END = " "


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


class Brute:
    """The model in plain dictionaries; p() recurses over histories."""

    def __init__(self, rows, order):
        self.order, self.c = order, {k: Counter() for k in range(1, order + 1)}
        for doc_id, text in rows:
            if learns(doc_id):
                t = tokens(text)
                for k in self.c:
                    self.c[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
        self.n, self.words = sum(self.c[1].values()), [g[0] for g in self.c[1]]
        self.shares = {}
        for k, c in self.c.items():
            n = Counter(c.values())
            self.shares[k] = {}
            for top in (5, 4, 3, 2):
                if all(n[r] for r in range(1, top + 2)):
                    rest = (top + 1) * n[top + 1] / n[1]
                    found = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, top + 1)} if rest < 1 else {1: -1}
                    if all(0 < s < 1 for s in found.values()):
                        self.shares[k] = found
                        break
        self.after = defaultdict(list)
        for k in self.c:
            for g in self.c[k]:
                self.after[g[:-1]].append(g[-1])

    def kept(self, gram):
        c = self.c[len(gram)][gram]
        return c * self.shares[len(gram)].get(c, 1 - 1 / (c + 1) ** 2)

    def p(self, word, history):
        if not self.n:
            return 1.0
        gram = (*history, word)
        total = self.c[len(history)][history] if history else self.n
        if self.c[len(gram)][gram]:
            return self.kept(gram) / total
        if not history:
            return 1 - sum(self.kept((w,)) for w in self.words) / self.n
        lower = self.p(word, history[1:])
        if not total:
            return lower
        seen = self.after[history]
        return lower * (1 - sum(self.kept((*history, w)) for w in seen) / total) / (1 - sum(self.p(w, history[1:]) for w in seen))

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(w, tuple(t[max(0, i - self.order + 1) : i]))) for i, w in enumerate(t))


def corpus():
    rng = np.random.default_rng(5)
    words = ["The", "a", "cat", "dog", "é1", "sat", "ran", "on", "mat", "x,y"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, size=int(n), p=np.array([50 / (j + 1) for j in range(50)]) / sum(50 / (j + 1) for j in range(50))))) for i, n in enumerate(rng.integers(0, 60, size=120))]
    return rows + [(200, None), (201, ""), (202, " \t\n "), (None, "a cat sat"), (None, None), (3, "a second text of one id"), (7, rows[7][1]), (7, rows[7][1]), (203, "unheard of words " * 400)]


@pytest.mark.parametrize("order", [1, 3])
def test_scores_of_plain_recursion(spark, order):
    rows = corpus()
    model = Brute(rows, order)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, block int, KEY string").repartition(5)
    got = sorted(map(tuple, katz.katz_scores(docs, order=order).collect()), key=repr)
    base = lambda t: sum(math.log10((model.c[1][(w,)] + 1) / (model.n + len(model.words) + 1)) for w in tokens(t))
    want = sorted(((i, not learns(i), len(tokens(t)), sum(model.c[1][(w,)] > 0 for w in tokens(t)), model.n, base(t), model.score(t)) for i, t in rows), key=repr)
    assert len(got) == len(want)
    close = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6), round(r[6], 6))
    for g, w in zip(sorted(got, key=close), sorted(want, key=close), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    model = Brute(corpus(), 3)
    assert model.shares[3]
    for history in [(), ("the",), ("é1",), ("the", "a"), ("a", "cat"), ("nowhere",), ("nowhere", "a"), ("w39", "the")]:
        assert sum(model.p(w, history) for w in [*model.words, "<new>"]) == pytest.approx(1, abs=1e-9)


def test_operator_sums_to_one(spark):
    """Texts 'h w' for all words w and a new one, none learnt, less what 'h' has."""
    rows = [(i, t) for i, t in corpus() if i is not None and learns(i)]
    model = Brute(rows, 2)
    texts = [f"the {w}" for w in model.words if w != END] + ["the unheard-of"]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows] + [(1000 + i, t, False) for i, t in enumerate(texts)] + [(5000, "the", False)], "doc_id long, text string, fit boolean")
    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs, order=2, learns=F.col("fit")).collect()}
    ends = [model.p(END, (t.split()[1],)) for t in texts]
    p_the = model.p("the", ())
    share = sum(10 ** got[1000 + i] / p_the / ends[i] for i in range(len(texts))) + 10 ** got[5000] / p_the
    assert share == pytest.approx(1, abs=1e-9)


def test_nothing_learnt_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r["train_tokens"], r["score"], r["base_score"], r["n_known"]) for r in katz.katz_scores(docs, learns=F.lit(False)).collect()] == [(0, 0.0, 0.0, 0)] * 2
    assert katz.katz_scores(docs.limit(0)).count() == 0


def test_small_blocks_and_parts(spark, monkeypatch):
    """Counts and weights meet across blocks and parts of the tables."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    whole = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 8)) for r in katz.katz_scores(docs).collect())
    monkeypatch.setattr(katz, "PART", 64)
    small = docs.repartition(24)
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 8)) for r in katz.katz_scores(small).collect()) == whole


def test_discounts():
    d = katz.Discounts.of([100, 40, 22, 14, 10, 8])
    assert len(d.shares) == 5 and all(0 < s < 1 for s in d.shares)
    assert katz.Discounts.of([0] * 6).shares == () and katz.Discounts.of([10, 0, 3, 1, 1, 1]).shares == ()
    assert (np.diff(katz.Discounts(()).kept(np.arange(1, 50))) > 0).all()
