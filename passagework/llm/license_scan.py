"""License phrases, and licence templates by an exact set-similarity join (operator 3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.words import NON_ALPHANUMERIC, Words, text_chunks

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A text's blocks: runs of 64 words, each 32 after the last, so that 33 words in a row lie within one block.
BLOCK, STEP = 64, 32


class Template(NamedTuple):
    """A sentence that a licence is told by. ``must``: words without which a block is not of this licence, however alike."""

    text: str
    label: str
    must: str


#: Sentences of licences and notices, in words, none longer than a block's sure run.
SENTENCES = (
    Template("released under the mit license", "mit", "mit"),
    Template("licensed under the mit license", "mit", "mit"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software", "mit", "permission hereby granted charge"),
    Template("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit", "deal merge sublicense sell"),
    Template("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", "permission included substantial portions"),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "permission fee hereby granted"),
    Template("licensed under the apache license version 2 0", "apache-2", "apache 2"),
    Template("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license", "apache-2", "apache 2"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution source binary forms"),
    Template("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", "redistributions source retain copyright"),
    Template("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd", "redistributions binary reproduce copyright"),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public 2"),
    Template("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", "eclipse public"),
    Template("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered public domain"),
    Template("no part of this publication may be reproduced without the prior written permission of the publisher", "all-rights-reserved", "publication reproduced permission"),
)
#: Names of the GNU licences (short name, words before "general public license") and of Creative Commons
#: conditions (short name, the words it has in long names).
GNU = (("gpl", ""), ("lgpl", "lesser"), ("agpl", "affero"))
CONDITIONS = (("nc", ("noncommercial", "non commercial")), ("sa", ("sharealike", "share alike")), ("nd", ("noderivatives", "no derivatives")))


def _gnu_templates() -> Iterator[Template]:
    for short, word in GNU:
        name = f"gnu {word} general public".replace("  ", " ")
        yield Template(f"released under the {short} license", short, short)
        yield Template(f"you can redistribute it and or modify it under the terms of the {name} license as published by the free software foundation", short, name)
        for version in ("", "2", "2 1", "3"):
            label = short + ("-" + version.replace(" ", ".") if version else "")
            yield Template(f"licensed under the {name} license" + (f" version {version}" if version else ""), label, f"{name} {version}".strip())


def _creative_commons_templates() -> Iterator[Template]:
    for chosen in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        label, short = "-".join(("cc-by", *chosen)), " ".join(("cc by", *chosen))
        yield Template(f"licensed under {short} 4 0", label, short)
        for long in product(*(words for name, words in CONDITIONS if name in chosen)):
            name = " ".join(("creative commons attribution", *long))
            yield Template(f"licensed under a {name} 4 0 international license", label, name)


#: All templates. Of the templates that one block holds, one whose ``must`` includes all of another's and more displaces it.
TEMPLATES = (*SENTENCES, *_gnu_templates(), *_creative_commons_templates())


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), NON_ALPHANUMERIC).hash


@lru_cache(4)
def _vocabulary(texts: tuple[str, ...]) -> np.ndarray:
    """Sorted distinct word hashes of some texts; a token is its hash's place here."""
    return np.unique(np.concatenate([_hashes(t) for t in texts]))


def _token_ids(words: Words, known: np.ndarray) -> np.ndarray:
    """Each word's place among the known ones, or -1."""
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    return np.where(known[at] == words.hash, at, -1)


def _blocks(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, block, token) of the distinct known tokens of each block; tokens stand in two blocks where they overlap."""
    per_text = np.diff(first)
    text = np.repeat(np.arange(len(per_text)), per_text)
    place = np.arange(len(ids)) - np.repeat(first[:-1], per_text)
    held = np.flatnonzero(ids >= 0)
    text, place, token = text[held], place[held], ids[held].astype(np.int64)
    block = place // STEP
    later = block > 0
    blocks = int(per_text.max(initial=0)) // STEP + 1
    size = int(token.max(initial=0)) + 1
    key = (text * blocks + block) * size + token
    key = np.unique(np.concatenate([key, key[later] - size]))
    return key // size // blocks, key // size % blocks, key % size


def _count_batches(templates: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(templates)
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0)):
                words = Words(data, bounds, NON_ALPHANUMERIC)
                _, _, token = _blocks(_token_ids(words, known), words.first)
                total += np.bincount(token, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], names=["token", "blocks"])

    return run


def block_frequencies(docs: DataFrame, text_col: str, templates: tuple[str, ...]) -> dict[int, int]:
    """In how many blocks of all texts each of the templates' tokens stands. As many rows as the templates have tokens."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_batches(templates), "token long, blocks long")
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("blocks").alias("n")).collect()}


def _scan_batches(templates: tuple[str, ...], phrases: tuple[str, ...], order: list[int], prefix: list[int], least: int) -> Callable:
    """order: the tokens from rare to frequent; prefix: places in that order; least: the shortest overlap sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(templates)
        rank = np.argsort(order)
        rare = np.zeros(len(known), dtype=bool)
        rare[prefix] = True
        runs = [_hashes(p) for p in phrases]
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(1)):
                words = Words(data, bounds, NON_ALPHANUMERIC)
                ids = _token_ids(words, known)
                text, block, token = _blocks(np.where(ids < 0, -1, rank[ids]), words.first)
                hits = [_places(words, run) for run in runs]
                at = np.concatenate(hits)
                label = np.repeat(np.arange(len(runs)), [len(x) for x in hits])
                sort = np.lexsort((label, at))
                at, label = at[sort], label[sort]
                hit_bounds = np.searchsorted(at, words.first)
                at = at - words.first[np.searchsorted(words.first, at, side="right") - 1]
                base = pa.ListArray.from_arrays(pa.array(hit_bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(at), pa.array(label)], names=["word", "phrase"]))
                # blocks with a token of some template's prefix and as many tokens as the shortest overlap sought
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1])
                group = np.cumsum(new) - 1
                groups = int(group[-1]) + 1 if len(group) else 0
                keep = (np.bincount(group, rare[token], groups) > 0) & (np.bincount(group, minlength=groups) >= least)
                chosen = keep[group] if groups else np.zeros(0, bool)
                starts = np.flatnonzero(new)[keep]
                sizes = np.bincount(group, minlength=groups)[keep]
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(token[chosen]))
                blocks = pa.StructArray.from_arrays([pa.array(block[starts]), inner], names=["block", "tokens"])
                block_bounds = np.searchsorted(text[starts], np.arange(b - a + 1))
                out = [batch.column(0).slice(a, b - a), pa.array(words.per_text), base, pa.ListArray.from_arrays(pa.array(block_bounds.astype(np.int32)), blocks)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "base", "blocks"])

    return run


def _places(words: Words, run: np.ndarray) -> np.ndarray:
    """Where the words of ``run`` stand in a row within one text."""
    n = len(words.hash) - len(run) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    hit = np.flatnonzero(words.hash[:n] == run[0])
    for i in range(1, len(run)):
        hit = hit[words.hash[hit + i] == run[i]]
    text = np.searchsorted(words.first, hit, side="right")
    return hit[text == np.searchsorted(words.first, hit + len(run) - 1, side="right")]


def license_labels(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, percent: int = 80
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``docs``.

    Words: runs of letters, digits and non-ASCII, A-Z lower-cased. Base: places where a phrase's words stand in a row.
    Templates: a block (BLOCK words, each STEP after the last) that holds ``percent`` of a template's distinct tokens,
    those it must hold among them, takes its label, unless it holds a template that displaces it. That join is exact:
    tokens are ordered by their frequency in the blocks of all texts, rare first. A block with enough of a template's
    tokens holds one of the template's prefix, its first size - needed + 1 tokens (prefix filter); it holds at least
    ``needed`` tokens (length filter); and after a first common token at place i of the template, i others are lost to
    it (positional filter). What passes is compared in full.

    A template lies within one block wherever it stands, since it has STEP + 1 words at most; the sentences of a longer
    one are to be given one by one. score: 1 with a base place, else the best containment of a template that a block
    takes its label from, else 0. The templates are a given list, whose size bounds what is sent to the tasks. Null or
    empty texts have no words and empty labels; null ids and repeated rows stay as rows of their own; very long texts
    are as many blocks; an empty table gives no rows; other columns are ignored.
    """
    phrases = phrases or PHRASES
    long = [t.text for t in templates if len(t.text.split()) > STEP + 1]
    if long:
        raise ValueError(f"templates of more than {STEP + 1} words may lie across blocks: {long}")
    spark, texts = docs.sparkSession, tuple(t.text for t in templates)
    known, frequency = _vocabulary(texts), block_frequencies(docs, text_col, texts)
    order = sorted(range(len(known)), key=lambda x: (frequency.get(x, 0), x))
    rank = {token: i for i, token in enumerate(order)}
    tokens = lambda text: sorted({rank[int(x)] for x in np.searchsorted(known, _hashes(text))})
    sets, musts = [tokens(t) for t in texts], [tokens(t.must) for t in templates]
    needed = [-(-percent * len(x) // 100) for x in sets]
    beaten = [[i for i, other in enumerate(musts) if set(other) < set(must)] for must in musts]
    index = [(n, t.label, beaten[n], x[i], i, x, musts[n], needed[n]) for n, (t, x) in enumerate(zip(templates, sets, strict=True)) for i in range(len(x) - needed[n] + 1)]
    prefixes = spark.createDataFrame(index, "number int, label string, beaten array<int>, token long, place int, template array<long>, must array<long>, needed int")
    scan = _scan_batches(texts, tuple(phrases), order, sorted({row[3] for row in index}), min(needed))
    schema = "doc_id long, n_words long, base array<struct<word:long,phrase:long>>, blocks array<struct<block:long,tokens:array<long>>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
    rows = Scratch(spark).save(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")

    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens", F.posexplode("b.tokens").alias("at", "token"))
    met = blocks.join(F.broadcast(prefixes), "token").where("needed <= least(size(template) - place, size(tokens) - at)")
    met = met.withColumn("both", F.array_intersect("template", "tokens")).where("token = both[0] and size(both) >= needed and size(array_except(must, both)) = 0")
    held = met.groupBy("row", "block").agg(F.collect_list(F.struct("number", "label", "beaten", F.expr("size(both) / size(template)").alias("containment"))).alias("held"))
    told = held.select("row", F.explode(F.expr("filter(held, x -> not exists(held, y -> array_contains(y.beaten, x.number)))")).alias("t"))
    of_row = told.groupBy("row").agg(F.collect_set("t.label").alias("found"), F.max("t.containment").alias("containment"))

    names = F.array(*(F.lit(x) for x in phrases.values()))
    base = F.array_distinct(F.transform("base", lambda x: F.get(names, x["phrase"].cast("int"))))
    out = rows.drop("blocks").join(of_row, "row", "left").withColumn("labelled", base)
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.expr("array_min(transform(base, x -> x.word))").alias("first_word"),
        F.expr("array_max(transform(base, x -> x.word))").alias("last_word"), F.array_join(F.array_sort("labelled"), ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(labelled, coalesce(found, array()))), ',')").alias("labels"),
        F.expr("if(size(base) > 0, 1D, coalesce(containment, 0D))").alias("score"),
    )
