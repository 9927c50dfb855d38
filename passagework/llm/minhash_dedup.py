"""Near-duplicate texts by one-permutation MinHash, banded buckets and exact confirmation (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passagework.llm.graph import components
from passagework.llm.scratch import Scratch
from passagework.llm.words import SPACES, Words, distinct_by_text, lists, mix, text_chunks

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Pairs that one task of a hub compares; sets that share a prefix shingle pair by pair, and the shingles of a block of more.
PART, LIGHT, BLOCK = 64, 8, 50_000
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], dtype=np.uint64)


def _bin_minima(hashes: np.ndarray, bounds: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """One permutation: a hash's top bits choose its bin, and each bin keeps its smallest hash."""
    texts = len(bounds) - 1
    shift = np.uint64(64 - bins.bit_length() + 1)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    slot = text * bins + (hashes >> shift).astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]  # hashes are sorted within a text, so a bin's first is its least
    minima = np.zeros(texts * bins, dtype=np.uint64)
    filled = np.zeros(texts * bins, dtype=bool)
    minima[slot[first]] = hashes[first]
    filled[slot[first]] = True
    return minima.reshape(texts, bins), filled.reshape(texts, bins)


def _densify(minima: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin copies the first filled one in its own fixed random sequence of bins.

    Both texts of a pair follow the same sequences, so that each bin still agrees with the pair's Jaccard probability.
    """
    bins = minima.shape[1]
    out = minima.copy()
    rows, cols = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    turn = 0
    while len(rows):
        turn += 1
        source = (mix(cols.astype(np.uint64) * _GOLDEN + np.uint64(turn << 40)) % np.uint64(bins)).astype(np.int64)
        found = filled[rows, source]
        out[rows[found], cols[found]] = minima[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
    return out


def _band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), rows.shape[:2])
    for i in range(rows.shape[2]):
        key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + rows[:, :, i])
    return key


def _prints(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two numbers a set: sums of mixed hashes, equal for equal sets in any order."""
    out = []
    for salt in _SALTS:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + salt), dtype=np.uint64)])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out


def _signature_batches(shingle: int, bins: int, bands: int, separators: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(2)):
                hashes, at = distinct_by_text(*Words(data, bounds, separators).shingles(shingle))
                n = np.diff(at)
                keys = _band_keys(_densify(*_bin_minima(hashes, at, bins)), bands)
                keys = keys[n > 0].reshape(-1)
                key_bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                columns = [*(batch.column(i).slice(a, b - a) for i in range(2)), pa.array(n), *map(pa.array, _prints(hashes, at)), lists(keys, key_bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n_shingles", "print_a", "print_b", "bands"])

    return run


def signatures(texts: DataFrame, shingle: int, bins: int, bands: int, separators: bytes) -> DataFrame:
    """(id, text_hash, n_shingles, print_a, print_b, bands) of each row of (id, text_hash, text); texts without words have no bands."""
    schema = "id long, text_hash long, n_shingles long, print_a long, print_b long, bands array<long>"
    return texts.mapInArrow(_signature_batches(shingle, bins, bands, separators), schema)


def _classes(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(n_shingles, print_a, print_b, doc, text_hash, bands, node): the distinct sets, with the smallest id that has one and a text of it.

    node is that id, or a hash where one id has several sets.
    """
    same = ["n_shingles", "print_a", "print_b"]
    classes = scratch.save(signed.where("n_shingles > 0 and id is not null").groupBy(*same).agg(F.min(F.struct("id", "text_hash")).alias("least"), F.first("bands").alias("bands")).select(*same, F.col("least.id").alias("doc"), "least.text_hash", "bands"), "sets")
    several = classes.groupBy("doc").agg(F.count("*").alias("sets")).where("sets > 1").select("doc", F.lit(True).alias("several"))
    node = F.when(F.col("several"), F.xxhash64("doc", "print_a", "print_b")).otherwise(F.col("doc"))
    return scratch.save(classes.join(several, "doc", "left").select(*same, "doc", "text_hash", "bands", node.alias("node")), "classes")


def _members(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n, size) of the buckets that hold more than one class."""
    rows = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = scratch.save(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    return scratch.save(rows.join(buckets, "key"), "members")


def _set_batches(shingle: int, separators: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(2)):
                hashes, at = distinct_by_text(*Words(data, bounds, separators).shingles(shingle))
                own = pa.array(_prints(hashes, at)[0] == batch.column(1).slice(a, b - a).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), lists(hashes, at)], names=["node", "n", "shingles"]).filter(own)

    return run


def _sets(members: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, separators: bytes) -> DataFrame:
    """(node, n, shingles) of the classes that meet others: their sets, sorted, each once however many rows have its text."""
    wanted = classes.join(members.select("node").distinct(), "node").select(F.col("doc").alias("id"), "text_hash", "node", "print_a")
    one = texts.join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    return one.select("node", "print_a", "text").mapInArrow(_set_batches(shingle, separators), "node long, n long, shingles array<long>")


def _star_pairs(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(hub, node, parts): each member of a bucket with its hubs, the class that meets most others over all buckets and the smallest.

    A pair stands once, under one hub. Sets whose sizes alone rule a link out are left out.
    """
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = members.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("order"), "node", "n")).alias("central"), F.min(F.struct("node", "n")).alias("least"))
    hubs = scratch.save(ranked.select("key", F.array_distinct(F.array(*(F.struct(f"{x}.node", f"{x}.n") for x in ("central", "least")))).alias("hubs")), "hubs")
    stars = members.join(hubs, "key").select("node", "n", "size", F.explode("hubs").alias("hub"))
    stars = stars.where(f"node <> hub.node and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    one = stars.groupBy(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).agg(F.max(F.struct("size", "hub.node")).alias("top"))
    parts = F.expr(f"shiftleft(1, cast(ceil(log2(greatest(1, top.size / {PART}))) AS int))")
    return one.select(F.col("top.node").alias("hub"), F.expr("if(top.node = a, b, a)").alias("node"), parts.alias("parts"))


def _overlap_batches(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64)) for x in (batch.column(2), batch.column(3))]
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                one, two = (values[at[i] : at[i + 1]] for at, values in sides)
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked[i] = 100 * both >= percent * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (hub, node, parts) whose full sets overlap enough.

    A node's set goes to each of its few hubs. A hub's set goes once to each of its parts, so that a hub of many nodes is no
    hot key.
    """
    place = ["hub", "parts", "part"]
    held = pairs.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).join(sets.select("node", F.col("shingles").alias("two")), "node")
    hubs = pairs.select("hub", "parts", F.pmod(F.xxhash64("node"), "parts").alias("part")).distinct().join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("one")), "hub")
    sides = held.join(hubs, place).select("hub", "node", "one", "two")
    return sides.mapInArrow(_overlap_batches(percent), "a long, b long").distinct()


def _unresolved(members: DataFrame, component: DataFrame) -> DataFrame:
    """(node, component) of the classes in buckets that hold several components. Buckets of two are compared by their star."""
    rows = members.where("size > 2").select("key", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return rows.join(mixed.select("key"), "key").select("node", "component").distinct()


def _prefixes(held: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(shingle, node, component, n, sharers): the first shingles of each set of (node, component, n, shingles), where they can link components.

    Shingles are ordered by how many sets hold them, rare ones first. Of two linked sets, of n shingles each at least
    ``percent`` % are common, so the first n - ceil(percent * n / 100) + 1 of each share one. Shingles of one set only come
    first and pair nothing. sharers: how many sets have the shingle among their first.
    """
    rows = held.select("node", "component", "n", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("mixed")).where("df > 1")
    of_set = Window.partitionBy("node")
    ranks = rows.join(common, "shingle").withColumn("rank", F.dense_rank().over(of_set.orderBy("df", "shingle"))).withColumn("last", F.max("rank").over(of_set))
    first = ranks.where(F.expr(f"mixed and n - last + rank <= n - ({percent} * n + 99) div 100 + 1")).select("shingle", "node", "component", "n").distinct()
    first = scratch.save(first, "first")
    return first.join(first.groupBy("shingle").agg(F.count("*").alias("sharers")).where("sharers > 1"), "shingle")


def _block_links(percent: int) -> Callable:
    """Of the sets of two blocks, pairs of other components that overlap enough. One pass marks a set in all others."""

    def held(table: pa.Table) -> tuple[np.ndarray, ...]:
        sets = table.column(4).combine_chunks()
        at = sets.offsets.to_numpy()
        return table.column(2).to_numpy(), table.column(3).to_numpy(), sets.values.to_numpy()[at[0] : at[-1]], at - at[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        if left.num_rows and right.num_rows:
            (one, c_one, shingles, at), (two, c_two, others, bounds) = held(left), held(right)
            values, number = np.unique(others, return_inverse=True)
            size = np.diff(bounds)
            for i, node in enumerate(one):
                own = shingles[at[i] : at[i + 1]]
                place = np.minimum(np.searchsorted(values, own), len(values) - 1)
                marked = np.zeros(len(values), dtype=bool)
                marked[place[values[place] == own]] = True
                both = np.add.reduceat(marked[number], bounds[:-1], dtype=np.int64)
                near = (100 * both >= percent * (size + len(own) - both)) & (c_two != c_one[i])
                found.append(np.stack([np.full(int(near.sum()), node), two[near]], axis=1))
        links = np.concatenate(found)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return run


def _dense_links(dense: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The links of other components among sets that share prefix shingles with many: compared in blocks, without a row for each pair.

    Sets of one most shared prefix shingle lie in blocks of about BLOCK shingles. Two blocks meet if they share any prefix
    shingle, so that every pair that shares one is compared.
    """
    home = dense.groupBy("node").agg(F.max(F.struct("sharers", "shingle")).alias("most"), F.first("component").alias("component"), F.first("n").alias("n"))
    home = home.select("node", "component", "n", F.col("most.shingle").alias("home"))
    blocks = home.groupBy("home").agg(F.expr(f"(sum(n) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    placed = scratch.save(home.join(blocks, "home").select("node", "component", F.xxhash64("home", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "placed")
    spots = scratch.save(dense.select("shingle", "node").join(placed, "node").select("shingle", "block").distinct(), "spots")
    met = spots.withColumnRenamed("block", "i").join(spots.withColumnRenamed("block", "j"), "shingle").where("i <= j").select("i", "j").distinct()
    met = scratch.save(met, "met")
    body = scratch.save(placed.join(sets.select("node", "shingles"), "node"), "body")
    left = met.join(body.withColumnRenamed("block", "i"), "i").select("i", "j", "node", "component", "shingles")
    right = met.join(body.withColumnRenamed("block", "j"), "j").select("i", "j", "node", "component", "shingles").toDF("k", "l", "other", "c_other", "others")
    return left.groupBy("i", "j").cogroup(right.groupBy("k", "l")).applyInArrow(_block_links(percent), "a long, b long")


def _other_links(members: DataFrame, component: DataFrame, sets: DataFrame, tested: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): all links between other components of one bucket, by an exact prefix join."""
    unresolved = scratch.save(_unresolved(members, component), "unresolved")
    held = scratch.save(sets.join(unresolved, "node").select("node", "component", "n", "shingles"), "held")
    first = scratch.save(_prefixes(held, scratch, percent), "prefixes")
    light = first.where(f"sharers <= {LIGHT}")
    one, two = (light.select("shingle", F.col("node").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = one.join(two, "shingle").where(f"a < b and c_a <> c_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b").distinct()
    pairs = pairs.join(tested.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")), ["a", "b"], "left_anti")
    links = _confirmed(scratch.save(pairs.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(1).alias("parts")), "pairs-1"), held, percent)
    dense = first.where(f"sharers > {LIGHT}")
    return links if dense.isEmpty() else links.unionByName(_dense_links(dense, held, scratch, percent))


def _linked(classes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, percent: int, separators: bytes) -> DataFrame:
    """(node, component) of the classes that have links."""
    members = _members(classes, scratch)
    sets = scratch.save(_sets(members, classes, texts, shingle, separators), "member-sets")
    tested = scratch.save(_star_pairs(members, scratch, percent), "pairs-0")
    links = scratch.save(_confirmed(tested, sets, percent), "links-0")
    component = scratch.save(components(links, scratch), "component-0")
    more = scratch.save(_other_links(members, component, sets, tested, scratch, percent), "links-1")
    if more.isEmpty():
        return component
    return scratch.save(components(links.unionByName(more), scratch), "component-1")


def _resolved(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bins: int, bands: int, separators: bytes) -> DataFrame:
    """near_duplicates() with a hash of each row's text."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = scratch.save(signatures(texts, shingle, bins, bands, separators), "signed")
    same = ["n_shingles", "print_a", "print_b"]
    classes = _classes(signed, scratch)
    component = _linked(classes, texts, scratch, shingle, percent, separators)
    linked = classes.select("node", "doc").join(component, "node")
    smallest = linked.groupBy("component").agg(F.min("doc").alias("least"))
    of_class = classes.drop("bands", "text_hash").join(linked.join(smallest, "component").select("node", "least"), "node", "left")
    of_class = of_class.select(*same, F.col("doc").alias("class_id"), F.coalesce("least", "doc").alias("component_id"))
    out = signed.drop("bands").join(of_class, same, "left").select(
        F.col("id").alias("doc_id"), "text_hash", "n_shingles", *(F.expr(f"if(id is null, null, coalesce({x}, id))").alias(x) for x in ("component_id", "class_id"))
    )
    return out.select("doc_id", "n_shingles", "component_id", F.expr("coalesce(doc_id = component_id, true)").alias("kept"), "class_id", "text_hash")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bins: int = 128,
    bands: int = 32,
    separators: bytes = SPACES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id), one row for each row of ``docs``.

    A text's set: its distinct runs of ``shingle`` words, A-Z lower-cased; a shorter text is one run. Two texts are
    linked if 100 * intersection >= ``percent`` * union over their full sets. Texts of equal sets are one class
    (class_id: its smallest id), compared once. Classes meet in ``bands`` buckets of bins / bands rows each: with 32
    bands of 4, a pair at 0.8 shares no bucket with probability 5e-8. In a bucket, edges form stars instead of all
    pairs: the hubs are the class that meets most others over all buckets (the source of a group of altered copies)
    and the smallest one. The classes of buckets that hold several components after that are joined exactly: all pairs
    of other components whose sets share a shingle of their prefixes are compared (see _prefixes), pair by pair where
    few share it and in blocks where many do, so that no link between classes that share a bucket is lost.

    Null, empty or wordless texts have no shingles and are their own components. A null id is linked with nothing:
    component_id and class_id are null and kept is true. Repeated rows are one class. If one id has several texts, these
    are linked by their own sets only, and each row takes the component of its own text. An empty table gives no rows.
    Other columns are ignored.
    """
    return _resolved(docs, id_col, text_col, shingle, percent, bins, bands, separators).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document of the smallest id.

    Each row is judged by its own text, so that of several texts of one id those without a smaller near duplicate stay. Of
    repeated rows (equal id and text, with words) one stays, whichever their other columns. Null ids and texts without words stay.
    """
    own = "_d"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    row = {f"{own}id": F.col(id_col).cast("long"), f"{own}hash": F.xxhash64(text_col)}
    judged = _resolved(docs, id_col, text_col, shingle, percent, 128, 32, SPACES).select(*(F.col(x).alias(y) for x, y in zip(("doc_id", "text_hash"), row, strict=True)), "kept", "n_shingles")
    judged = Scratch(docs.sparkSession).save(judged, "judged")
    stay = docs.withColumns(row).join(judged.where("not kept").select(*row).distinct(), [*row], "left_anti")
    repeated = judged.where(f"kept and n_shingles > 0 and {own}id is not null").groupBy(*row).count().where("count > 1").select(*row)
    if not repeated.isEmpty():
        stay = stay.join(repeated, [*row], "left_anti").unionByName(stay.join(repeated, [*row], "left_semi").dropDuplicates([*row]))
    return stay.select(*(F.col(f"`{c}`") for c in docs.columns))
