"""Exact positions in a sorted order without a task that sorts a whole group.

The rows are range-partitioned by (group, order) and sorted inside their
partitions; a row's place in its partition is read off the plan's row numbers.
Each partition's row count per group, a table of about as many rows as there are
partitions and groups, tells how many rows of the group come before. It is joined
on (partition, group), so that a group holding all rows is still spread over all
its partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def exact_ranks(df: DataFrame, group_by: Sequence[Column], order_by: Sequence[Column], rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank_col``, the row's number from 1 in its group by ``order_by``.

    ``order_by`` should be a total order: rows that tie on it are numbered in
    any order, and all of them go to one partition. Null groups are a group. An
    empty ``group_by`` numbers the whole table. The sorted rows are staged once, under
    ``staged_path`` of the result.
    """
    keys = [f"__g{i}" for i in range(len(group_by))]
    named = df.withColumns({k: g for k, g in zip(keys, group_by)}) if keys else df
    order = [F.col(k) for k in keys] + list(order_by)
    spread = named.repartitionByRange(partitions, *order) if partitions else named.repartitionByRange(*order)
    number = F.col("__n")
    placed = (spread.sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id())
              .withColumn("__part", F.shiftright(number, _ROW_BITS))
              .withColumn("__place", number.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__n"))
    placed = stage(placed, how="table")
    runs = placed.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__rows"), F.min("__place").alias("__first"))
    before = F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__rows")
    offsets = runs.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"{k}_") for k in keys],
                          (before - F.col("__first")).alias("__shift"))
    same = [F.col("__part") == F.col("__p")] + [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    out = placed.join(offsets, same).withColumn(rank_col, F.col("__place") + F.col("__shift") + 1)
    out = out.select(*df.columns, rank_col)
    out.staged_path = placed.staged_path
    return out
