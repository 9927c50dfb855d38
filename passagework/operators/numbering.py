"""Row numbers within few or large groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(rows: DataFrame, group: list[str], order: list[Column], cell: Column, name: str = "row_number") -> DataFrame:
    """``rows`` with their number from 1 within ``group``, by ``order``. ``cell`` must not fall as ``order`` rises.

    Rows are ordered within cells, each in its own task, and the sizes of the cells below are added: one row a group and
    cell is all that is ordered by group, so that cells are to be many but far fewer than rows. Null groups are groups.
    """
    own = "_n"
    while any(c.lower().startswith(own) for c in rows.columns):
        own += "_"
    counts = rows.groupBy(*(F.col(g).alias(f"{own}g{i}") for i, g in enumerate(group)), cell.alias(f"{own}cell")).agg(F.count("*").alias(f"{own}in"))
    below = Window.partitionBy(*(f"{own}g{i}" for i in range(len(group)))).orderBy(f"{own}cell")
    counts = counts.withColumn(f"{own}before", F.sum(f"{own}in").over(below) - F.col(f"{own}in"))
    placed = rows.withColumn(f"{own}of", cell)
    placed = placed.withColumn(f"{own}within", F.row_number().over(Window.partitionBy(*group, f"{own}of").orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"{own}g{i}")) for i, g in enumerate(group)] + [F.col(f"{own}of").eqNullSafe(F.col(f"{own}cell"))]
    joined = placed.join(counts, same)
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(f"{own}within") + F.col(f"{own}before")).alias(name))
