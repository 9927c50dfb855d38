"""The trained routing baseline: words, word pairs and word-bound letter runs, weighed by rarity, in a logistic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from passagework.operators.linear import minimised, summed
from passagework.plans.shared import shared_folder

#: What counts as a word, letters of a run, and the weight of the losses against the coefficients' squares.
WORD, RUNS, STRENGTH = r"\b\w\w+\b", (3, 4, 5), 2.0
#: Features that the model knows: those in most texts, ties by their own order.
VOCABULARY = 1 << 16
#: Texts that are worked on at once, and features or words that a task holds at once.
TEXTS, HELD = 64, 1 << 19


def letter_runs(word: str) -> list[str]:
    """The runs (``c:``) of letters within the space-padded word, as often as they stand."""
    padded, out = f" {word} ", []
    for n in RUNS:
        out += [f"c:{padded[i : i + n]}" for i in range(max(1, len(padded) - n + 1))]
        if len(padded) <= n:  # longer runs of the word are the word again, which counts once
            break
    return out


def features_of(text: str | None) -> Counter:
    """Counts of a text's words and neighbouring words (``w:``), and of the runs of letters within its space-padded words (``c:``)."""
    low = (text or "").lower()
    words = re.findall(WORD, low)
    out = Counter(f"w:{w}" for w in words)
    out.update(f"w:{a} {b}" for a, b in zip(words, words[1:], strict=False))
    for word, times in Counter(low.split()).items():
        for run in letter_runs(word):
            out[run] += times
    return out


class _Numbers(dict):
    """Numbers of names in the order in which they are first asked for; with ``known`` only those that are given have one, others -1."""

    known = False

    def __missing__(self, name: str) -> int:
        if self.known:
            return -1
        n = self[name] = len(self)
        return n


class _Runs(dict):
    """The numbers of words' letter runs, looked up when a word is first asked for; those without a number are left out."""

    def __init__(self, numbers: _Numbers):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> np.ndarray:
        numbers = np.array([self.numbers[r] for r in letter_runs(word)], dtype=np.int64)
        found = self[word] = numbers[numbers >= 0] if self.numbers.known else numbers
        return found


def _numbered(texts: list[str | None], numbers: _Numbers, runs: _Runs) -> tuple[np.ndarray, ...]:
    """features_of() of texts as arrays: (row, word's number) in order, and (row, run's number, times) of each word's letter runs."""
    low = [(t or "").lower() for t in texts]
    words, parts = [re.findall(WORD, t) for t in low], [Counter(t.split()) for t in low]
    word = np.array([numbers[w] for row in words for w in row], dtype=np.int64)
    found = [runs[w] for row in parts for w in row]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    repeated = lambda x: np.repeat(np.array(x, dtype=np.int64), sizes)
    return (
        np.repeat(np.arange(len(low)), [len(row) for row in words]), word, repeated([i for i, row in enumerate(parts) for _ in row]),
        np.concatenate(found) if found else np.zeros(0, np.int64), repeated([n for row in parts for n in row.values()]),
    )


class _Tally:
    """How often keys came, as sorted arrays."""

    def __init__(self):
        self.keys, self.counts, self.more, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.more.append(keys)
        self.size += len(keys)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        counts = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        self.keys, place = np.unique(np.concatenate([self.keys, *self.more]), return_inverse=True)
        self.counts, self.more, self.size = np.bincount(place, weights=counts, minlength=len(self.keys)).astype(np.int64), [], 0


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, df): in how many of a task's texts each feature is. When there are many, they are given out and begun anew."""

    def told() -> Iterator[pa.RecordBatch]:
        names, spelled = pa.array(list(words), pa.string()), pa.array(list(known), pa.string())
        of = lambda keys: names.take(pa.array(keys))
        for tally, name in (
            (single, lambda keys: pc.binary_join_element_wise("w:", of(keys), "")), (letters, lambda keys: spelled.take(pa.array(keys))),
            (double, lambda keys: pc.binary_join_element_wise("w:", pc.binary_join_element_wise(of(keys >> 32), of(keys & 0xFFFFFFFF), " "), "")),
        ):
            tally.merge()
            for i in range(0, len(tally.keys), 50_000):
                yield pa.RecordBatch.from_arrays([name(tally.keys[i : i + 50_000]), pa.array(tally.counts[i : i + 50_000])], names=["feature", "df"])

    words, known, single, double, letters = _Numbers(), _Numbers(), _Tally(), _Tally(), _Tally()
    runs = _Runs(known)
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            row, word, at, run, _ = _numbered(whole.column("text").slice(i, TEXTS).to_pylist(), words, runs)
            single.add(np.unique(row * len(words) + word) % max(1, len(words)))
            letters.add(np.unique(at * len(known) + run) % max(1, len(known)))
            next_to = row[:-1] == row[1:]
            pairs, place = np.unique((word[:-1] << 32 | word[1:])[next_to], return_inverse=True)
            double.add(pairs[np.unique(row[:-1][next_to] * len(pairs) + place) % max(1, len(pairs))])
            if len(words) + len(known) + len(runs) > 2 * HELD or len(double.keys) > 4 * HELD:
                yield from told()
                for x in (words, known, runs):
                    x.clear()
                single, double, letters = _Tally(), _Tally(), _Tally()
    yield from told()


class _Placer:
    """Texts as vectors of the known features ``places`` (place, rarity). A word's letter runs are looked up once, and neighbours are met by their words' numbers."""

    def __init__(self, places: dict[str, tuple[int, float]]):
        self.size = max(1, len(places))
        self.rarity, self.is_word = np.zeros(self.size), np.zeros(self.size, dtype=bool)
        known, self.words, single, pairs = _Numbers(), _Numbers(), [], []
        for feature, (place, rarity) in places.items():
            self.rarity[place], self.is_word[place] = rarity, feature[0] == "w"
            if feature[0] == "c":
                known[feature] = place
                continue
            numbers = [self.words[w] for w in feature[2:].split(" ")]
            (single if len(numbers) == 1 else pairs).append((*numbers, place))
        known.known = self.words.known = True
        self.runs = _Runs(known)
        self.single = np.full(len(self.words) + 1, -1)
        for number, place in single:
            self.single[number] = place
        pairs.sort()
        self.pairs, self.pair_places = np.array([a << 32 | b for a, b, _ in pairs], dtype=np.int64), np.array([p for *_, p in pairs], dtype=np.int64)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, places, counts) by row and place."""
        if len(self.runs) > HELD:
            self.runs.clear()
        row, word, at, run, times = _numbered(texts, self.words, self.runs)
        place = self.single[word]
        keys, counts = [(row * self.size + place)[place >= 0], at * self.size + run], [np.ones((place >= 0).sum()), times]
        if len(self.pairs) and len(word) > 1:
            pair, near = word[:-1] << 32 | word[1:], (row[:-1] == row[1:]) & (word[:-1] >= 0) & (word[1:] >= 0)
            pair, of = pair[near], row[:-1][near]
            spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            met = self.pairs[spot] == pair
            keys.append(of[met] * self.size + self.pair_places[spot[met]])
            counts.append(np.ones(met.sum()))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key // self.size, key % self.size, np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, places, values) by row and place."""
        rows, places, counts = self.counts(texts)
        return rows, places, _values(rows, places, counts, self.rarity, self.is_word)


def _values(rows: np.ndarray, places: np.ndarray, counts: np.ndarray, rarity: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """1 + ln(count), times rarity; words and letter runs of a row each scaled to unit length."""
    values = (1 + np.log(counts)) * rarity[places]
    side = rows * 2 + is_word[places]
    return values / np.sqrt(np.bincount(side, weights=values**2))[side]


@dataclass(frozen=True)
class TextClassifier:
    """classes: the labels, in order. places: features' places with their rarity. coefficients: (features + 1) x classes, the last row for no feature at all."""

    classes: tuple
    places: dict[str, tuple[int, float]]
    coefficients: np.ndarray

    def probabilities(self, texts: list[str | None], placer: _Placer | None = None) -> np.ndarray:
        placer, out = placer or _Placer(self.places), np.zeros((len(texts), len(self.classes)))
        for i in range(0, len(texts), TEXTS):
            part = texts[i : i + TEXTS]
            rows, places, values = placer.vectors(part)
            z = np.stack([np.bincount(rows, weights=values * self.coefficients[places, k], minlength=len(part)) + self.coefficients[-1, k] for k in range(len(self.classes))], axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + TEXTS] = e / e.sum(axis=1, keepdims=True)
        return out


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


def _place_batches(places: dict[str, tuple[int, float]], classes: list):
    """(y, at, n): a text's class, and its features' places and counts as bytes, which each step reads as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, placer = {c: i for i, c in enumerate(classes)}, _Placer(places)
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                rows, at, n = placer.counts(batch.column("text").to_pylist())
                cuts = np.searchsorted(rows, np.arange(1, batch.num_rows))
                columns = [pa.array([v.tobytes() for v in np.split(array, cuts)], pa.binary()) for array in (at.astype(_kind(placer.size)), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([number[x] for x in batch.column("label").to_pylist()], pa.int32()), *columns], names=["y", "at", "n"])

    return run


def _losses(weights: np.ndarray, rarity: np.ndarray, is_word: np.ndarray):
    kind = np.dtype(_kind(len(rarity)))

    def part(y: np.ndarray, row: np.ndarray, at: np.ndarray, values: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.stack([np.bincount(row, weights=values * w[at, k], minlength=len(y)) + w[-1, k] for k in range(w.shape[1])], axis=1)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1)
        loss = (weights[y] * (np.log(total) - z[np.arange(len(y)), y])).sum()
        gap = p / total[:, None]
        gap[np.arange(len(y)), y] -= 1
        gap *= weights[y][:, None]
        gradient = np.stack([np.append(np.bincount(at, weights=values * gap[row, k], minlength=len(w) - 1), gap[:, k].sum()) for k in range(w.shape[1])], axis=1)
        return loss, gradient

    def run(whole: pa.RecordBatch, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = 0.0, np.zeros_like(w)
        for i in range(0, whole.num_rows, 2 * TEXTS):
            y, at, n = (c.slice(i, 2 * TEXTS) for c in whole.columns)
            row = np.repeat(np.arange(len(y)), pc.binary_length(at).to_numpy() // kind.itemsize)
            at, n = np.frombuffer(b"".join(at.to_pylist()), kind).astype(np.int64), np.frombuffer(b"".join(n.to_pylist()), np.int32)
            more, slope = part(y.to_numpy(), row, at, _values(row, at, n, rarity, is_word), w)
            loss, gradient = loss + more, gradient + slope
        return loss, gradient

    return run


def fit_text_classifier(rows: DataFrame, text_col: str = "text", label_col: str = "label", vocabulary: int = VOCABULARY, strength: float = STRENGTH, steps: int = 60) -> TextClassifier:
    """A model of all rows with a label. Classes count alike, whatever their numbers of rows.

    A feature's value is 1 + ln of its count times its rarity ln((1 + n) / (1 + df)) + 1 over the n texts; words and
    letter runs are scaled to unit length each. The loss is ``strength`` times the rows' log loss plus half the squared
    coefficients, intercepts left out. ``vocabulary`` bounds what the driver and the tasks hold. The texts are written once;
    each task counts in how many of its texts a feature is. The rows' values are written once and read by each step, which
    adds up the gradient in the tasks. Null texts have no features.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "classifier")
    named = rows.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    named.write.parquet(f"{folder}/texts")
    named = spark.read.schema(named.schema).parquet(f"{folder}/texts")
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes, n = sorted(sizes), sum(sizes.values())
    counted = named.select("text").mapInArrow(_frequency_batches, "feature string, df long")
    top = counted.groupBy("feature").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "feature").limit(vocabulary).collect()
    places = {r["feature"]: (i, float(np.log((1 + n) / (1 + r["df"])) + 1)) for i, r in enumerate(top)}
    named.mapInArrow(_place_batches(places, classes), "y int, at binary, n binary").write.parquet(f"{folder}/placed")
    placed = spark.read.schema("y int, at binary, n binary").parquet(f"{folder}/placed")
    weights = np.array([strength * n / (len(classes) * sizes[c]) for c in classes])
    known = _Placer(places)
    losses = _losses(weights, known.rarity, known.is_word)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = summed(placed, losses, w)
        gradient[:-1] += w[:-1]
        return loss + 0.5 * (w[:-1] ** 2).sum(), gradient

    return TextClassifier(tuple(classes), places, minimised(objective, np.zeros((len(places) + 1, max(1, len(classes)))), steps) if classes else np.zeros((1, 1)))


def classified(rows: DataFrame, model: TextClassifier, id_col: str, text_col: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, predicted, probability) and the columns ``kept``: the likeliest class of each row, ties to the first."""
    names, kinds = np.array([str(c) for c in model.classes]), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = _Placer(model.places)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                p = model.probabilities(batch.column(1).to_pylist(), placer)
                best = p.argmax(axis=1)
                columns = [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(p[np.arange(len(best)), best]), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "predicted", "probability", *kept])

    schema = ", ".join([f"id {kinds[id_col]}", "predicted string", "probability double", *(f"`{c}` {kinds[c]}" for c in kept)])
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept).mapInArrow(run, schema)
