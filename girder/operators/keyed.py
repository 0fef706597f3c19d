"""Joins and running totals for keys of any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key is large where it has more than 1 / LARGE of all rows, so there are fewer than LARGE such keys.
LARGE = 4096


def meet(many: DataFrame, few: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """``many`` joined with ``few``, which has one row for each key and in ``count`` about the rows that ``many`` has of it.

    Rows of large keys stay where they are, since the large keys' rows of ``few``
    are broadcast (fewer than LARGE); the others, each a small share, are shuffled.
    """
    by = list(by)
    total = few.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) * LARGE > total
    held = many.join(F.broadcast(few.filter(large)), by)
    rest = many.join(F.broadcast(few.filter(large).select(*by)), by, "left_anti").join(few.filter(~large), by)
    return held.unionByName(rest)


def running_sums(rows: DataFrame, by: Sequence[str], rank: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Rows with ``name``: the sum of ``value`` over the rows of their group up to their own rank (unique in the group).

    Sums within blocks of ranks and over whole blocks before them, so a group
    of any size spreads over tasks.
    """
    keys = [*by, "running_block_"]
    placed = rows.withColumn("running_block_", F.floor(F.col(rank) / block).cast("long"))
    sums = placed.groupBy(*keys).agg(F.sum(value).alias("running_sum_"))
    before = F.coalesce(F.sum("running_sum_").over(Window.partitionBy(*by).orderBy("running_block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(value).over(Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("running_within_", within).join(sums.select(*keys, before.alias("running_before_")), keys).withColumn(name, F.col("running_within_") + F.col("running_before_")).drop("running_block_", "running_within_", "running_before_")
