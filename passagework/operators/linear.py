"""Linear models of sparse features fitted by sums over tasks: the driver keeps coefficients, never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Coefficients of a block in which gradients are added up.
BLOCK = 4096
#: (values, gradient) of a task's rows at some coefficients.
Losses = Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]]


def _add(rows: pa.Table) -> pa.Table:
    sums = np.sum([np.asarray(x.values) for x in rows.column("sums")], axis=0)
    return pa.table({"block": rows.column("block").slice(0, 1), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})


def summed(rows: DataFrame, losses: Losses, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, gradient) of all rows. Each task adds up its own; blocks of the tasks' sums are added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(w.size + 1)
        for batch in batches:
            loss, gradient = losses(batch, w)
            total[0] += loss
            total[1:] += gradient.ravel()
        blocks = [total[i : i + BLOCK] for i in range(0, len(total), BLOCK)]
        used = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i] for i in used], pa.list_(pa.float64()))], names=["block", "sums"])

    out = np.zeros(w.size + 1)
    for r in rows.mapInArrow(run, "block int, sums array<double>").groupBy("block").applyInArrow(_add, "block int, sums array<double>").collect():
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(r["sums"])] = r["sums"]
    return float(out[0]), out[1:].reshape(w.shape)


def minimised(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 60, tolerance: float = 1e-5, memory: int = 10) -> np.ndarray:
    """Where a smooth convex function is least, by L-BFGS with halved steps; each evaluation is one pass over the rows."""
    w, held = start.copy(), []
    value, gradient = objective(w)
    for _ in range(steps):
        if np.abs(gradient).max() <= tolerance * max(1.0, abs(value)):
            break
        direction, factors = gradient.copy(), []
        for s, y in reversed(held):
            a = (s * direction).sum() / (s * y).sum()
            direction -= a * y
            factors.append(a)
        if held:
            s, y = held[-1]
            direction *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(held, reversed(factors), strict=True):
            direction += s * (a - (y * direction).sum() / (s * y).sum())
        slope, step = -(gradient * direction).sum(), 1.0 if held else 1.0 / max(1.0, np.abs(gradient).sum())
        while True:
            new = w - step * direction
            after, next_gradient = objective(new)
            if after <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - w, next_gradient - gradient
        if (s * y).sum() > 1e-12:
            held = [*held[-(memory - 1) :], (s, y)]
        done = value - after <= tolerance * 1e-3 * max(1.0, abs(value))
        w, value, gradient = new, after, next_gradient
        if done:
            break
    return w
