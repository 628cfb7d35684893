"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that are numbered in one task, about, and the least number of parts of a group.
PART_ROWS = 500_000
LEAST_PARTS = 4


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each group from 0, without bringing a group into one task.

    `df` must be materialized, as it is read twice: the places of its rows tell rows apart that are equal otherwise. A
    hash deals each group into parts, whose number follows from `rows`, the count of all rows, as any one group may
    hold most of them; a part's rows are numbered in place and begin after those of the parts before it. The offsets
    are at most one row for each part of each group that has rows; groups must be of a bounded number.
    """
    spread = max(LEAST_PARTS, -(-rows // PART_ROWS))
    parts = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.pmod(F.xxhash64(*order, "_row"), F.lit(spread)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = parts.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order, "_row")))
    return placed.join(offsets, [*keys, "_part"]).withColumn(name, (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_row", "_part", "_at", "_start")
