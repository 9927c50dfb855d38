import re

import pytest

from passagework.llm.license_scan import BLOCK, PHRASES, STEP, TEMPLATES, Template, license_labels


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for k in range(-(-len(w) // STEP)):
        block = set(w[k * STEP : k * STEP + BLOCK])
        held = [t for t in TEMPLATES if set(t.must.split()) <= block and 100 * len(block & set(t.text.split())) >= 80 * len(set(t.text.split()))]
        for t in held:
            if not any(set(t.must.split()) < set(other.must.split()) for other in held):
                labels.add(t.label)
                score = max(score, len(block & set(t.text.split())) / len(set(t.text.split())))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def test_against_brute_force(spark):
    filler = [f"f{i}" for i in range(500)]
    texts = ["Released under the MIT License.", "x apache license, version 2.0 y CC BY-NC 4.0", None, "", "plain words only", "under the mit license " * 3]
    for i, template in enumerate(TEMPLATES):
        t = template.text.split()
        texts.append(" ".join(filler[: 13 * i] + t + filler[13 * i :]))
        texts.append(" ".join(filler[: 11 * i + 3] + t[: len(t) - 1 - len(t) // 6] + filler[:90]))
        texts.append(" ".join(filler[:7] + [w for w in t for w in (w, "pad")] + filler[:40]))
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (0, "other text under one id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'a' as label", "2 as token", "3 as block")
    rows = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_labels(df).collect()]
    assert sorted(rows, key=repr) == sorted(((d, *brute(t)) for d, t in docs), key=repr)


def test_alike_licences_are_told_apart(spark):
    apache = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
    cases = [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),  # the first is a base phrase's
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
        ("licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License", "cc-by-nc"),
        ("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa"),
        ("released under the GPL license", "gpl"),
        (apache, "apache-2"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
        ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation; you can redistribute it and/or modify it", "agpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "mit"),
        ("a license under which the work was released", ""),
        ("you may not use this file except in compliance with the license", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_labels(df).collect()} == {i: label for i, (_, label) in enumerate(cases)}


def test_templates_anywhere_in_very_long_texts(spark):
    """A template lies within one block at each distance from the blocks' borders; longer ones are refused."""
    longest = max((t for t in TEMPLATES), key=lambda t: len(t.text.split()))
    texts = [" ".join([f"f{j % 977}" for j in range(40_000 + i)]) + f" {longest.text} " + "g " * 50 for i in range(STEP)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.labels for r in license_labels(df).collect()} == {longest.label}
    with pytest.raises(ValueError):
        license_labels(df, templates=(Template(" ".join(f"w{i}" for i in range(STEP + 2)), "x", "w1"),))


def test_empty_table(spark):
    assert license_labels(spark.createDataFrame([], "doc_id long, text string")).count() == 0
