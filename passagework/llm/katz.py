"""Language-model scores by Katz backoff over Good-Turing discounted n-gram counts (operator 11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from passagework.llm.scratch import Scratch
from passagework.llm.words import SPACES, Words, bit_filter, lists, mix, passes, text_chunks

#: Tokens of a block, and n-grams that one part of a table is asked for.
BLOCK, PART = 1 << 20, 1 << 21
#: Counts up to so many are discounted by Good and Turing.
MOST_DISCOUNTED = 5
_END, _STEP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Discounts:
    """How much of a count of r stays, for the n-grams of one order."""

    shares: tuple[float, ...]

    @staticmethod
    def of(n: list[float]) -> Discounts:
        """From n[r - 1] n-grams that stand r times: of the ranges 1 to 5, 4, 3 or 2 the longest for which Good's and Turing's estimate gives shares within 0 and 1."""
        for top in range(MOST_DISCOUNTED, 1, -1):
            if min(n[: top + 1]) > 0:
                rest = (top + 1) * n[top] / n[0]
                shares = tuple(((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if rest < 1 else -1.0 for r in range(1, top + 1))
                if all(0 < s < 1 for s in shares):
                    return Discounts(shares)
        return Discounts(())

    def kept(self, count: np.ndarray) -> np.ndarray:
        """The share of each count that stays. Larger counts lose (count + 1)^-2, so that no history spends all its mass on what it has seen."""
        table = np.array([0.0, *self.shares])
        return np.where(count < len(table), table[np.minimum(count, len(table) - 1)], 1 - 1 / (count.astype(np.float64) + 1) ** 2)


@dataclass(frozen=True)
class Model:
    """What of the counts is the same for all tokens."""

    order: int
    discounts: dict[int, Discounts]
    tokens: int
    types: int
    unknown: float


class _Grams:
    """The n-grams of a block: ``number[k]`` of each token tells its k-gram, ``keys[k]`` the k-grams, ``history[k]`` and ``suffix[k]`` what they are without their last and first word."""

    def __init__(self, lens: np.ndarray, sequence: np.ndarray, words: np.ndarray, order: int):
        self.begin = np.concatenate([[0], np.cumsum(lens)])
        self.place = np.arange(len(sequence)) - np.repeat(self.begin[:-1], lens)
        self.number, self.keys = {1: sequence}, {1: words}
        self.history, self.suffix = {}, {}
        token = words[sequence]
        before = token
        for k in range(2, order + 1):
            at = np.flatnonzero(self.place >= k - 1)
            key = mix(before[at - 1] * _STEP + token[at])
            self.keys[k], first, which = np.unique(key, return_index=True, return_inverse=True)
            self.number[k] = np.full(len(sequence), -1)
            self.number[k][at] = which
            self.history[k], self.suffix[k] = self.number[k - 1][at[first] - 1], self.number[k - 1][at[first]]
            before = np.zeros_like(token)
            before[at] = key


def packed(x: np.ndarray) -> bytes:
    """Counts or ranks by as many bytes as the largest needs, bytes of equal weight side by side and compressed: the high ones are mostly zeros."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = b"".join(((x >> (8 * i)) & 255).astype(np.uint8).tobytes() for i in range(width))
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: memoryview) -> np.ndarray:
    planes = pa.decompress(pa.py_buffer(data[9:]), int.from_bytes(data[1:9], "little"), "zstd")
    planes = np.frombuffer(planes, np.uint8).reshape(data[0], -1)
    out = planes[0].astype(np.int64)
    for i in range(1, len(planes)):
        out |= planes[i].astype(np.int64) << (8 * i)
    return out


def _row(table: pa.RecordBatch | pa.Table, name: str, i: int = 0) -> np.ndarray:
    value = table.column(name)[i]
    return unpacked(memoryview(value.as_buffer())) if pa.types.is_binary(value.type) else value.values.to_numpy(zero_copy_only=False)


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK tokens: documents (doc_ids, learns, lens), and their tokens as ranks (sequence) among the block's words."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        ids, learns, lens, tokens = zip(*held, strict=True)
        held.clear()
        words, number, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        rank = np.argsort(-times, kind="stable")
        place = np.empty(len(words), dtype=np.int32)
        place[rank] = np.arange(len(words))
        columns = [pa.concat_arrays(ids), pa.concat_arrays(learns), pa.array(np.concatenate(lens).astype(np.int32)), pa.array(words[rank].view(np.int64))]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array([packed(place[number])], pa.binary()), pa.array([len(number)], pa.int64())], names=["doc_ids", "learns", "lens", "words", "sequence", "tokens"])

    size = 0
    for batch in batches:
        for a, b, data, bounds in text_chunks(batch.column(2)):
            words = Words(data, bounds, SPACES)
            tokens = np.insert(words.hash, words.first[1:], _END)
            held.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), words.per_text + 1, tokens))
            size += len(tokens)
            if size >= BLOCK:
                yield flush()
                size = 0
    if held:
        yield flush()


def _parts(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _ask_batches(k: int, bits: int) -> Callable:
    """(part, block, keys, counts, histories): a block's k-grams by the part of the table that counts them, how often documents to learn from hold them here, and the histories of those that none holds here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lens = _row(batch, "lens", i)
                grams = _Grams(lens, _row(batch, "sequence", i), _row(batch, "words", i).view(np.uint64), k)
                number = grams.number[k][np.repeat(_row(batch, "learns", i).astype(bool), lens)]
                counts = np.bincount(number[number >= 0], minlength=len(grams.keys[k])).astype(np.int32)
                order = np.argsort(grams.keys[k]) if k == 1 else np.arange(len(grams.keys[k]))
                keys, counts = grams.keys[k][order], counts[order]
                part, first = np.unique(_parts(keys, bits), return_index=True)
                bounds = np.append(first, len(keys))
                none = np.flatnonzero(counts == 0)
                histories = grams.keys[k - 1][grams.history[k][none]] if k > 1 else np.zeros(0, np.uint64)
                of_part = np.searchsorted(none, bounds) if k > 1 else np.zeros(len(bounds), np.int64)
                block = pa.array(np.full(len(part), batch.column("block")[i].as_py()))
                own = pa.array([packed(counts[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part), block, lists(keys, bounds), own, lists(histories, of_part)], names=["part", "block", "keys", "counts", "histories"])

    return run


def _count_part(rows: pa.Table) -> pa.Table:
    """(part, block, counts, owned, figures, asked): each block's k-grams' counts over all, and for which it speaks: one block for each k-gram learnt.

    A row of no block has the part's figures, and the histories of k-grams that are nowhere learnt.
    """
    asked = rows.combine_chunks()
    keys, histories = (asked.column(name).combine_chunks() for name in ("keys", "histories"))
    sizes = np.diff(keys.offsets.to_numpy())
    keys, histories = keys.flatten().to_numpy().view(np.uint64), histories.flatten().to_numpy()
    own = np.concatenate([unpacked(memoryview(x.as_buffer())) for x in asked.column("counts")])
    distinct, number = np.unique(keys, return_inverse=True)
    totals = np.bincount(number, weights=own, minlength=len(distinct)).astype(np.int64)
    learnt = np.flatnonzero(own > 0)
    owned = np.zeros(len(keys), dtype=bool)
    owned[learnt[np.unique(number[learnt], return_index=True)[1]]] = True
    new = np.unique(histories[totals[number[own == 0]] == 0]) if len(histories) else histories
    large = totals[totals > MOST_DISCOUNTED].astype(np.float64)
    figures = [float((totals == r).sum()) for r in range(1, MOST_DISCOUNTED + 2)] + [float((large / (large + 1) ** 2).sum()), float(totals.sum()), float((totals > 0).sum())]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n, cuts = asked.num_rows, list(zip(bounds, bounds[1:], strict=False))
    return pa.table(
        {
            "part": pa.array(np.full(n + 1, asked.column("part")[0].as_py())), "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()),
            "counts": pa.array([*(packed(totals[number[a:b]]) for a, b in cuts), None], pa.binary()), "owned": pa.array([*(packed(np.packbits(owned[a:b])) for a, b in cuts), None], pa.binary()),
            "figures": pa.array([None] * n + [figures], pa.list_(pa.float64())), "asked": lists(new, np.array([0] * (n + 1) + [len(new)])),
        }
    )


def _model(figures: dict[int, list[float]]) -> Model:
    """From each order's sums of _count_part()'s figures."""
    discounts = {k: Discounts.of(f[: MOST_DISCOUNTED + 1]) for k, f in figures.items()}
    first = figures[1]
    tokens = int(first[-2])
    lost = first[-3]
    for r in range(1, MOST_DISCOUNTED + 1):
        lost += first[r - 1] * r * (1 - float(discounts[1].kept(np.array([r]))[0]))
    return Model(max(figures), discounts, tokens, int(first[-1]), lost / tokens if tokens else 1.0)


class _Counted:
    """A block's n-grams with their counts: ``count[k]``, ``owned[k]``, and ``seen[k]``, the probabilities of those learnt."""

    def __init__(self, block: pa.Table, answers: pa.Table, model: Model):
        self.lens = _row(block, "lens")
        self.grams = _Grams(self.lens, _row(block, "sequence"), _row(block, "words").view(np.uint64), model.order)
        k_of, part = answers.column("k").to_numpy(), answers.column("part").to_numpy()
        self.count, self.owned, self.seen, self.rest = {}, {}, {}, {}
        for k in range(1, model.order + 1):
            rows = np.flatnonzero(k_of == k)
            rows = rows[np.argsort(part[rows])]
            counts = [_row(answers, "counts", i) for i in rows.tolist()]
            owned = [np.unpackbits(_row(answers, "owned", i).astype(np.uint8), count=len(c)) for i, c in zip(rows.tolist(), counts, strict=True)]
            for held, out, kind in ((counts, self.count, np.int64), (owned, self.owned, bool)):
                out[k] = np.empty(sum(map(len, held)), dtype=kind)
                out[k][np.argsort(self.grams.keys[1]) if k == 1 else slice(None)] = np.concatenate([np.zeros(0, kind), *held])
            count, kept = self.count[k], model.discounts[k].kept(self.count[k])
            base = self.count[k - 1][self.grams.history[k]] if k > 1 else np.full(len(count), max(model.tokens, 1))
            self.seen[k] = np.where(count > 0, kept * count / np.maximum(base, 1), 0.0)
            self.rest[k] = count * (1 - kept)


_SCORED = pa.schema(
    [
        ("block", pa.int64()), ("i", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("asked", pa.list_(pa.int64())),
        ("total", pa.list_(pa.int64())), ("rest", pa.list_(pa.float64())), ("below", pa.list_(pa.float64())),
    ]
)
_SCORED_DDL = "block long, i int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, asked array<long>, total array<long>, rest array<double>, below array<double>"


def _masses(has: _Counted, order: int, wanted: np.ndarray) -> list[np.ndarray]:
    """[key, total, rest, below]: of histories that the filter lets pass, their count, the counts that discounts take from the n-grams this block speaks for, and what those have in the order below."""
    out = [[np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]]
    for k in range(2, order + 1):
        history, suffix, own = has.grams.history[k], has.grams.suffix[k], has.owned[k]
        asked = passes(wanted, has.grams.keys[k - 1])[history] & own
        n = len(has.grams.keys[k - 1])
        rest, below = (np.bincount(history[asked], weights=w, minlength=n) for w in (has.rest[k][asked], has.seen[k - 1][suffix[asked]]))
        some = np.flatnonzero(np.bincount(history[asked], minlength=n))
        out.append([has.grams.keys[k - 1][some], has.count[k - 1][some], rest[some], below[some]])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _score_blocks(model: Model, wanted: np.ndarray) -> Callable:
    """(block, i, doc_id, held_out, n_tokens, n_known, base_score, score, asked) of a block's documents; the score lacks the backoff weights of the histories ``asked``.

    A row without i has _masses() in asked, total, rest and below.
    """

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _SCORED.empty_table()
        has = _Counted(block, answers, model)
        grams, begin = has.grams, has.grams.begin[:-1]
        count = has.count[1][grams.number[1]]
        with np.errstate(divide="ignore"):
            logs = {1: np.where(has.count[1] > 0, np.log10(has.seen[1]), np.log10(model.unknown))}
            for k in range(2, model.order + 1):
                logs[k] = np.where(has.count[k] > 0, np.log10(has.seen[k]), logs[k - 1][grams.suffix[k]])
        level = np.minimum(grams.place + 1, model.order)
        score, open_ = np.zeros(len(level)), np.zeros(len(level), dtype=bool)
        for k in range(1, model.order + 1):
            at = np.flatnonzero(level == k)
            score[at] = logs[k][grams.number[k][at]]
        document, asked = np.repeat(np.arange(len(has.lens)), has.lens), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for k in range(model.order, 1, -1):
            at = np.flatnonzero(open_ | (level == k))
            at = at[has.count[k][grams.number[k][at]] == 0]
            history = grams.history[k][grams.number[k][at]]
            known = has.count[k - 1][history] > 0
            asked.append((document[at[known]], grams.keys[k - 1][history[known]]))
            open_[:] = False
            open_[at] = True
        owner, keys = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(has.lens) + 1))
        sums = [np.add.reduceat(x, begin) for x in ((count > 0).astype(np.int64), np.log10((count + 1) / (model.tokens + model.types + 1)), score)]
        n, none = len(has.lens), pa.nulls(len(has.lens))
        number = pa.array(np.full(n, block.column("block")[0].as_py()))
        columns = [number, pa.array(np.arange(n, dtype=np.int32)), block.column("doc_ids")[0].values, pa.array(~_row(block, "learns").astype(bool)), pa.array(has.lens.astype(np.int64))]
        documents = [*columns, *map(pa.array, sums), lists(keys[order], bounds), *(none.cast(_SCORED.field(i).type) for i in (9, 10, 11))]
        masses = _masses(has, model.order, wanted)
        one = [number.slice(0, 1), *(pa.nulls(1, _SCORED.field(i).type) for i in range(1, 8)), *(lists(x, np.array([0, len(x)])) for x in masses)]
        return pa.concat_tables([pa.Table.from_arrays(documents, schema=_SCORED), pa.Table.from_arrays(one, schema=_SCORED)])

    return run


def _counts(blocks: DataFrame, k: int, bits: int) -> DataFrame:
    asked = blocks.select("block", "learns", "lens", "sequence", "words").mapInArrow(_ask_batches(k, bits), "part long, block long, keys array<long>, counts binary, histories array<long>")
    return asked.groupBy("part").applyInArrow(_count_part, "part long, block long, counts binary, owned binary, figures array<double>, asked array<long>").withColumn("k", F.lit(k))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, learns: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Tokens: runs of anything but white space, A-Z lower-cased, and an end. The model learns from the rows where ``learns``
    is true; by default, those whose crc32(doc_id as text) mod 7 is not 2. n_known: tokens that it has met; train_tokens: N;
    base_score: add-one log10 probability of the single tokens; score: log10 probability of the text by Katz' model.

    The probability of a token after up to ``order`` - 1 others of its text is its discounted share of what followed them,
    where it has followed them; else their backoff weight times its probability after one fewer (without weight, if they are
    new themselves). Counts up to 5 keep what Good and Turing give (see Discounts). A history's weight is the mass its
    discounts free over the mass that the order below leaves to what hasn't followed it, so that the probabilities of all
    words and of the one unknown word sum to 1. Unknown words share what the discounts of single words free. n-grams are
    told apart by 64 bits of hash.

    A null id learns; it is not held out. Null and empty texts are one end. Repeated rows count as often as they stand.
    If nothing is learnt, all scores are 0. A text is held whole by a task. An empty table gives no rows; other columns are ignored.

    Texts are read once, into a table of blocks. Each order's n-grams, once for each block, go to the parts of its table,
    which are as many as the tokens ask for; the counts come back by block. So a frequent n-gram is a row for each
    block at most. Of histories, only those that some text backs off from are summed.
    """
    scratch = Scratch(docs.sparkSession)
    number = F.col(id_col).cast("long")
    if learns is None:
        learns = F.crc32(number.cast("string").cast("binary")) % 7 != 2
    rows = docs.select(number.alias("doc_id"), F.coalesce(learns, F.lit(True)).alias("learns"), F.col(text_col).alias("text"))
    blocks = rows.mapInArrow(_block_batches, "doc_ids array<long>, learns array<boolean>, lens array<int>, words array<long>, sequence binary, tokens long")
    blocks = scratch.save(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", "zstd")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    bits = max(0, -(-tokens // PART) - 1).bit_length()
    counted, figures = None, {}
    for k in range(1, order + 1):
        part = scratch.save(_counts(blocks, k, bits), f"counts-{k}", "zstd")
        sums = part.where("block is null").select(*(F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(MOST_DISCOUNTED + 4))).first()
        figures[k] = [x or 0.0 for x in sums]
        counted = part if counted is None else counted.unionByName(part)
    model = _model(figures)
    wanted = bit_filter(counted.where("block is null").select(F.explode("asked").alias("key")))
    answers = counted.where("block is not null").select("k", "part", "block", "counts", "owned")
    scored = blocks.drop("tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_blocks(model, wanted), _SCORED_DDL)
    scored = scratch.save(scored, "scored", "zstd")
    for name in ("blocks", *(f"counts-{k}" for k in range(1, order + 1))):
        scratch.drop(name)
    masses = scored.where("i is null").select(F.explode(F.arrays_zip(F.col("asked").alias("key"), "total", "rest", "below")).alias("x")).select("x.*")
    masses = masses.groupBy("key").agg(F.max("total").alias("total"), F.sum("rest").alias("rest"), F.sum("below").alias("below"))
    weights = scratch.save(masses.select("key", F.expr("log10(rest / total / (1 - below))").alias("weight")), "weights")
    scored = scored.where("i is not null")
    backed = scored.select("block", "i", F.explode("asked").alias("key")).join(weights, "key").groupBy("block", "i").agg(F.sum("weight").alias("weight"))
    out = scored.drop("asked", "total", "rest", "below").join(backed, ["block", "i"], "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("weight", F.lit(0.0))).alias("score"))
