"""Summary trees: soft clusters of a document's chunks, level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from passagework.functions.queries import squeeze
from passagework.operators.providers import Embedder, Summarizer, first_texts, hash_embedder
from passagework.plans.shared import shared_folder

# Limits of clustering and of the tree.
MOST_CLUSTERS, LEAST_PER_CLUSTER, LEAST_NODES, SHARE, MOST_LEVELS = 12, 4, 4, 0.15, 3
#: Rows of a block. A document of one block is fitted in one task, a larger one on all rows in rounds over its blocks.
FIT_ROWS = 2000
#: How many of a cluster's members a summarizer is given, unless it asks for more; the plain one shows fewer.
SHOWN = 256


def _densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    d2 = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ means.T + (means**2).sum(axis=1), 0)
    return np.log(weights) - 0.5 * (x.shape[1] * np.log(2 * np.pi * variances) + d2 / variances)


def _log_sum(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True)))[:, 0]


def fit_mixture(x: np.ndarray, k: int, seed: int = 42, steps: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, means, variances, BIC) of a mixture of ``k`` round normal clouds, by EM from spread-out rows."""
    random = np.random.default_rng(seed)
    means = x[[int(random.integers(len(x)))]]
    for _ in range(1, k):
        far = ((x[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1)
        means = np.concatenate([means, x[[int(random.choice(len(x), p=far / far.sum()) if far.sum() > 0 else random.integers(len(x)))]]])
    weights, variances, before = np.full(k, 1 / k), np.full(k, max(x.var(axis=0).mean(), 1e-6)), -np.inf
    for _ in range(steps):
        logs = _densities(x, weights, means, variances)
        total = _log_sum(logs)
        share = np.exp(logs - total[:, None])
        n = share.sum(axis=0) + 1e-9
        weights, means = n / n.sum(), share.T @ x / n[:, None]
        d2 = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ means.T + (means**2).sum(axis=1), 0)
        variances = (share * d2).sum(axis=0) / (n * x.shape[1]) + 1e-6
        if total.mean() - before < tolerance:
            break
        before = total.mean()
    likelihood = _log_sum(_densities(x, weights, means, variances)).sum()
    return weights, means, variances, (k * x.shape[1] + 2 * k - 1) * np.log(len(x)) - 2 * likelihood


def _fits(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    most = max(1, min(MOST_CLUSTERS, len(x) // 2, len(x) // LEAST_PER_CLUSTER, len(x) - 1)) if len(x) >= LEAST_NODES else 1
    return [fit_mixture(x, k) for k in range(1, most + 1)]


#: A document's models as one array: the vectors' width, then for each model k, a value, k weights, k variances and k means.
_STATE = "document_id string, active array<double>, best array<double>"
Model = tuple[int, float, np.ndarray, np.ndarray, np.ndarray]


def _packed(width: int, models: list[Model]) -> np.ndarray:
    """``models`` as (k, value, weights, variances, means); none: empty."""
    return np.concatenate([[width], *(np.concatenate([[k, value], weights, variances, np.ravel(means)]) for k, value, weights, variances, means in models)]) if models else np.zeros(0)


def _unpacked(flat: np.ndarray) -> list[Model]:
    out, at = [], 1
    while at < len(flat):
        width, k = int(flat[0]), int(flat[at])
        end = at + 2 + 2 * k
        out.append((k, float(flat[at + 1]), flat[at + 2 : at + 2 + k], flat[at + 2 + k : end], flat[end : end + k * width].reshape(k, width)))
        at = end + k * width
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (document_id, ids, vectors of a block, other arrays), one at a time, without an object for each number."""
    for batch in batches:
        documents, ids, flat, *others = batch.columns
        for i in range(batch.num_rows):
            names = ids[i].values
            x = flat[i].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
            yield documents[i].as_py(), names, x, *(c[i].values.to_numpy(zero_copy_only=False) for c in others)


def _states(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lists = [pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (1, 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *lists], names=["document_id", "active", "best"])


def _first_models(best_only: bool) -> Callable:
    """Of each block the mixture of least BIC as the best, or those of all numbers of clusters to go on with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for document, _, x in _rows_of(batches):
            fits = [(len(w), bic, w, v, m) for w, m, v, bic in _fits(x)]
            best = _packed(x.shape[1], [min(fits, key=lambda m: m[1])])
            active = _packed(x.shape[1], [(k, -np.inf, w, v, m) for k, _, w, v, m in fits])
            yield _states([(document, np.zeros(0), best) if best_only else (document, active, np.zeros(0))])

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of each document for its models: rows, log-likelihood, and each cluster's shares, shares * |x|^2 and shares * x."""
    held: dict[str, np.ndarray] = {}
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["document_id", "sums"])
    for document, _, x, active in _rows_of(batches):
        parts, square = [], (x**2).sum(axis=1)
        for _, _, weights, variances, means in _unpacked(active):
            logs = _densities(x, weights, means, variances)
            total = _log_sum(logs)
            share = np.exp(logs - total[:, None])
            parts.append(np.concatenate([[len(x), total.sum()], share.sum(axis=0), share.T @ square, (share.T @ x).ravel()]))
        sums = np.concatenate(parts)
        held[document] = held[document] + sums if document in held else sums
        if len(held) >= 256:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _next_models(last: bool, tolerance: float) -> Callable:
    """A document's models after a step, from the tasks' sums and the models before; those that are done stay what they were, and the best of them is kept."""

    def run(parts: pa.Table, state: pa.Table) -> pa.Table:
        before, best = (state.column(name)[0].values.to_numpy(zero_copy_only=False) for name in ("active", "best"))
        sums = np.sum([x.values.to_numpy(zero_copy_only=False) for x in parts.column("sums")], axis=0)
        width, active, ended, at = int(before[0]), [], _unpacked(best), 0
        for k, likely, weights, variances, means in _unpacked(before):
            v = sums[at : at + 2 + 2 * k + k * width]
            at += len(v)
            n_rows, likelihood, n, square, first = v[0], v[1], v[2 : 2 + k] + 1e-9, v[2 + k : 2 + 2 * k], v[2 + 2 * k :].reshape(k, width)
            if last or likelihood / n_rows - likely < tolerance:
                ended.append((k, (k * width + 2 * k - 1) * np.log(n_rows) - 2 * likelihood, weights, variances, means))
                continue
            centres = first / n[:, None]
            spread = np.maximum(square - 2 * (centres * first).sum(axis=1) + (centres**2).sum(axis=1) * n, 0)
            active.append((k, likelihood / n_rows, n / n.sum(), spread / (n * width) + 1e-6, centres))
        least = [min(ended, key=lambda m: (m[1], m[0]))] if ended else []
        return pa.Table.from_batches([_states([(state.column("document_id")[0].as_py(), _packed(width, active), _packed(width, least))])])

    return run


def _fit_large(blocks: DataFrame, folder: str, steps: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """The mixtures of least BIC of large documents, by EM over all of their rows: a round over the blocks for each step.

    All numbers of clusters go through a round together, so that a block is read once a round. The first round starts from a
    fit on a document's first block; likelihood, parameters and BIC are those of all rows. The models are tables as well,
    joined to the blocks by document, so that the driver holds none of them.
    """
    spark = blocks.sparkSession
    first = blocks.join(blocks.groupBy("document_id").agg(F.min("block").alias("block")), ["document_id", "block"])
    active, paths = _written(first.select("document_id", "ids", "flat").mapInArrow(_first_models(False), _STATE), f"{folder}/models-0"), []
    for step in range(steps + 1):
        joined = blocks.select("document_id", "ids", "flat").join(active.select("document_id", "active"), "document_id")
        parts = joined.mapInArrow(_sum_batches, "document_id string, sums array<double>")
        after = parts.groupBy("document_id").cogroup(active.groupBy("document_id")).applyInArrow(_next_models(step == steps, tolerance), _STATE)
        paths.append(f"{folder}/models-{step + 1}")
        active = _written(after, paths[-1]).where("size(active) > 0")
        if active.isEmpty():
            break
    return spark.read.schema(_STATE).parquet(*paths).where("size(active) = 0").select("document_id", "best")


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The clusters of a block's rows, all at once."""
    for document, ids, x, best in _rows_of(batches):
        _, _, weights, variances, means = _unpacked(best)[0]
        logs = _densities(x, weights, means, variances)
        share = np.exp(logs - _log_sum(logs)[:, None])
        has = share >= SHARE
        none = ~has.any(axis=1)
        has[none, share[none].argmax(axis=1)] = True
        node, cluster = np.nonzero(has)
        columns = [pa.array([document] * len(node), pa.string()), ids.take(pa.array(node)), pa.array(cluster.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["document_id", "chunk_id", "cluster"])


def soft_clusters(nodes: DataFrame) -> DataFrame:
    """(document_id, chunk_id, cluster) of nodes (document_id, chunk_id, vector): every cluster that a node has a share of.

    A document's rows lie in blocks of about FIT_ROWS. The number of clusters has the least BIC. Mixtures are fitted on all
    rows: those of documents of one block in one task, others in rounds over their blocks (see _fit_large). The vectors are
    written first, as they may be costly to make.
    """
    folder = shared_folder(nodes.sparkSession, "mixtures")
    points = _written(nodes.select("document_id", "chunk_id", "vector"), f"{folder}/points")
    counts = points.groupBy("document_id").agg(F.expr(f"(count(*) + {FIT_ROWS - 1}) div {FIT_ROWS}").alias("blocks"))
    placed = points.join(counts, "document_id").withColumn("block", F.pmod(F.xxhash64("chunk_id"), "blocks"))
    held = placed.groupBy("document_id", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "vector"))).alias("held"))
    flat = held.select("document_id", "blocks", "block", F.col("held.chunk_id").alias("ids"), F.flatten("held.vector").alias("flat"))
    blocks = _written(flat, f"{folder}/blocks")
    small, large = blocks.where("blocks = 1"), blocks.where("blocks > 1").drop("blocks")
    models = small.select("document_id", "ids", "flat").mapInArrow(_first_models(True), _STATE).select("document_id", "best")
    if not large.isEmpty():
        models = models.unionByName(_fit_large(large, folder))
    return blocks.select("document_id", "ids", "flat").join(_written(models, f"{folder}/models"), "document_id").mapInArrow(_assigned, "document_id string, chunk_id string, cluster int")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each document's rows, which come together and in order; a batch at a time is held."""
    name, digest = None, None
    make = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([digest.hexdigest()[:24]])], names=["document_id", "fingerprint"])
    for batch in batches:
        for document, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or document != name:
                if digest is not None:
                    yield make()
                name, digest = document, hashlib.sha256(row.encode())
            else:
                digest.update(b"," + row.encode())
    if digest is not None:
        yield make()


def fingerprint(nodes: DataFrame) -> DataFrame:
    """(document_id, fingerprint): 24 hex digits of the document's chunks, whatever their order in the table.

    A document's rows are sorted on disk and digested as they come, never gathered.
    """
    rows = nodes.select("document_id", F.sha2(F.concat_ws("\x00", "chunk_id", squeeze(F.col("text"))), 256).alias("row"))
    return rows.repartition("document_id").sortWithinPartitions("document_id", "row").mapInArrow(_digests, "document_id string, fingerprint string")


class Tree(NamedTuple):
    """nodes: document_id, chunk_id, node_type, level, text, n_children; edges: document_id, parent, child."""

    nodes: DataFrame
    edges: DataFrame


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _summaries(nodes: DataFrame, clusters: DataFrame, level: int, summarize: Summarizer, shown: int, path: str) -> Tree:
    """A summary node for each cluster, and its edges to all members; its text shows the first ``shown`` members by chunk_id.

    A node is named by sums of hashes of its members, so that no task gathers them; only the shown texts come together.
    """
    group = ["document_id", "cluster"]
    digest = F.sha2(F.concat_ws(",", F.count("*"), F.expr("bit_xor(xxhash64(chunk_id))"), F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)"))), 256).substr(1, 10)
    named = clusters.groupBy(*group).agg(digest.alias("digest"), F.count("*").alias("n_children"))
    named = _written(named.select(*group, F.concat("document_id", F.lit(f"_summary_{level}_"), "digest").alias("parent"), "n_children"), f"{path}/named")
    edges = _written(clusters.join(named, group).select("document_id", "parent", F.col("chunk_id").alias("child")), f"{path}/edges")
    order = Window.partitionBy(*group).orderBy("chunk_id")
    first = clusters.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shown).join(nodes.select("document_id", "chunk_id", "text"), ["document_id", "chunk_id"])
    held = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("held"))
    text = summarize(F.transform("held", lambda x: x["text"]))
    summaries = named.join(held.select(*group, text.alias("text")), group)
    return Tree(_written(summaries.select("document_id", F.col("parent").alias("chunk_id"), F.lit("summary").alias("node_type"), F.lit(level).alias("level"), "text", "n_children"), f"{path}/nodes"), edges)


def build_tree(chunks: DataFrame, folder: str, embed: Embedder = hash_embedder, summarize: Summarizer = first_texts, most_levels: int = MOST_LEVELS, shown: int = SHOWN) -> Tree:
    """Chunks at level 0 and the summaries above them.

    A document goes on while it has LEAST_NODES nodes; one cluster makes its top node. ``folder``: where levels are
    written, shared by all executors. Three levels at most, so that the driver's loop is bounded. ``summarize`` is given
    the first ``shown`` texts of a cluster, by chunk_id, as a model reads so many at most; the edges lead to all members.
    """
    nodes = chunks.select(
        F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.lit("raw").alias("node_type"), F.lit(0).alias("level"), "text", F.lit(0).cast("long").alias("n_children")
    )
    tree = Tree(nodes, chunks.sparkSession.createDataFrame([], "document_id string, parent string, child string"))
    for level in range(1, most_levels + 1):
        size = nodes.groupBy("document_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_NODES).select("document_id")
        nodes, path = nodes.join(size, "document_id"), f"{folder}/level-{level}"
        clusters = _written(soft_clusters(embed(nodes.select("document_id", "chunk_id", "text"), "text")), f"{path}/clusters")
        above = _summaries(nodes, clusters, level, summarize, shown, path)
        nodes = above.nodes
        tree = Tree(tree.nodes.unionByName(nodes), tree.edges.unionByName(above.edges))
        if nodes.isEmpty():
            break
    return tree


def cached_tree(chunks: DataFrame, folder: str, embed: Embedder = hash_embedder, summarize: Summarizer = first_texts, most_levels: int = MOST_LEVELS, shown: int = SHOWN) -> Tree:
    """build_tree(), where documents whose chunks have not changed keep the tree that ``folder`` has of them.

    ``folder`` holds a manifest (document_id, fingerprint, built_at, nodes, levels) and the nodes and edges, by fingerprint. New
    trees are added; old ones stay, so that a document may have several.
    """
    spark = chunks.sparkSession
    path, held = shared_folder(spark, "tree"), read_manifest(spark, folder)
    now = fingerprint(chunks.select(F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "text"))
    now = _written(now, f"{path}/now")
    fresh = now if held is None else _written(now.join(held.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti"), f"{path}/fresh")
    if held is None or not fresh.isEmpty():
        asked = chunks.withColumn("document_id", F.col("document_id").cast("string")).join(fresh.select("document_id"), "document_id", "left_semi")
        built = build_tree(asked, path, embed, summarize, most_levels, shown)
        nodes, edges = (_written(x.join(fresh, "document_id"), f"{path}/{name}") for x, name in zip(built, built._fields, strict=True))
        nodes.write.mode("append").parquet(f"{folder}/nodes")
        edges.write.mode("append").parquet(f"{folder}/edges")
        counted = nodes.groupBy("document_id", "fingerprint").agg(F.current_timestamp().alias("built_at"), F.count("*").alias("nodes"), F.max("level").alias("levels"))
        counted.write.mode("append").parquet(f"{folder}/manifest")
    return _stored(spark, folder, now)


def _stored(spark: SparkSession, folder: str, chosen: DataFrame) -> Tree:
    return Tree(*(spark.read.parquet(f"{folder}/{name}").join(chosen.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_semi").drop("fingerprint") for name in Tree._fields))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(document_id, fingerprint, built_at, nodes, levels) of the trees that a folder holds; None before the first."""
    try:
        return spark.read.parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_trees(spark: SparkSession, folder: str, fingerprints: DataFrame | None = None) -> Tree:
    """The trees of ``fingerprints`` (document_id, fingerprint), or each document's newest one, from the folder of cached_tree()."""
    held = read_manifest(spark, folder)
    if held is None:
        raise ValueError(f"{folder} holds no trees")
    return _stored(spark, folder, fingerprints or held.groupBy("document_id").agg(F.max_by("fingerprint", F.struct("built_at", "fingerprint")).alias("fingerprint")))


def _short(column: str) -> Column:
    return F.concat(F.lit("n"), F.sha2(F.col(column), 256).substr(1, 10))


def render_mermaid(tree: Tree) -> DataFrame:
    """(document_id, text): each document's tree as a Mermaid graph, nodes and edges in order."""
    label = F.regexp_replace(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 80), '["\\[\\]]', "'")
    lines = tree.nodes.select("document_id", F.lit(0).alias("part"), F.concat(F.lit("    "), _short("chunk_id"), F.lit('["'), label, F.lit('"]')).alias("line"))
    lines = lines.unionByName(tree.edges.select("document_id", F.lit(1).alias("part"), F.concat(F.lit("    "), _short("parent"), F.lit(" --> "), _short("child")).alias("line")))
    grouped = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("held"))
    return grouped.select("document_id", F.concat(F.lit("graph TD\n"), F.array_join(F.transform("held", lambda x: x["line"]), "\n")).alias("text"))


def render_dot(tree: Tree) -> DataFrame:
    """(document_id, text): each document's tree in Graphviz's language."""
    label = F.regexp_replace(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 90), r'["\\]', "'")
    lines = tree.nodes.select("document_id", F.lit(0).alias("part"), F.concat(F.lit("  "), _short("chunk_id"), F.lit(' [label="'), label, F.lit('"];')).alias("line"))
    lines = lines.unionByName(tree.edges.select("document_id", F.lit(1).alias("part"), F.concat(F.lit("  "), _short("parent"), F.lit(" -> "), _short("child"), F.lit(";")).alias("line")))
    grouped = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("held"))
    return grouped.select("document_id", F.concat(F.lit("digraph tree {\n"), F.array_join(F.transform("held", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("text"))
