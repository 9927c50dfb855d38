import re
from collections import Counter, defaultdict

import numpy as np

from passagework.llm import phrases


def brute(rows, least=10, cover=50, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longest[q] = max(longest[q], a)
        rows = []
        for p, a in candidates.items():
            if len(p) == 2 and 100 * longest[p] >= cover * a and longest[p]:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(1)
    words = ["New", "york", "city", "é", "Ünder", "a", "b.c", "d,e", "x!", "the", "of\n", "tab\tbed", "\x00odd"]
    rows = [(" ".join(rng.choice(words, size=int(n), p=[0.3, 0.2, 0.1] + [0.04] * 10)), str(rng.choice(["en", "de"]))) for n in rng.integers(0, 80, size=150)]
    return rows + [(None, "en"), ("", None), ("new york city " * 300, None), ("new york city " * 300, "und"), ("  ..  ", "fr"), rows[3], rows[3]]


def result(spark, rows, **options):
    frame = spark.createDataFrame([(t, lang, 1, "k") for t, lang in rows], "text string, lang string, n int, KEY string").repartition(4)
    return sorted(map(tuple, phrases.collocations(frame, **options).collect()))


def test_brute_force(spark):
    assert result(spark, corpus()) == brute(corpus())


def test_small_flushes_and_dense_tiles(spark, monkeypatch):
    for name, value in (("FLUSH", 500), ("DENSE", 20), ("SIDE", 4), ("HEAD", 8)):
        monkeypatch.setattr(phrases, name, value)
    assert result(spark, corpus(), least=3, cover=80, most=25) == brute(corpus(), 3, 80, 25)


def test_empty(spark):
    frame = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(frame).count() == 0
    assert result(spark, [(None, None), ("a", "en")]) == []


def test_products_beyond_64_bits(spark):
    got = spark.range(1).select(phrases._score("cast(4000000000000 as bigint)", "cast(5000000000000 as bigint)", "cast(6000000000000 as bigint)").alias("s")).first()["s"]
    assert got == 10**6 * 4000000000000**2 // (5000000000000 * 6000000000000)


def test_tiles_count_as_sorted_pairs():
    rng = np.random.default_rng(2)
    left, right = (np.minimum(rng.geometric(0.02, size=300_000) - 1, 40_000) for _ in range(2))
    left[:50], right[:50] = 39_999, 20_000
    got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in phrases.tile_counts(left, right, 40_001)), strict=True)}
    assert got == Counter(zip(left.tolist(), right.tolist(), strict=True))
