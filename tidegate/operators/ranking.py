"""Ranks inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", rows_per_part: int = 1_000_000, salt: Column | None = None, few_groups: bool = False) -> DataFrame:
    """Number the rows of each group of keys from 0, in an order that is fixed by salt and order.

    A group is split by a hash into as many parts as its size asks for, so a group with a third of all rows is spread
    over many tasks: rows are numbered inside (keys, part) and the counts of earlier parts are added. The table of
    counts has one row per (keys, part), that is, rows / rows_per_part beyond the number of groups. Null keys form a
    group. few_groups: the caller can prove that the groups are few (bounded values), so the counts are broadcast and
    the rows move once, by (keys, part). salt: what the parts are drawn from; it must be the same whenever a row is computed again.
    """
    salt = salt if salt is not None else F.xxhash64(*order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))
    small = F.broadcast if few_groups else (lambda x: x)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    parted = df.join(small(sizes), same, "left").withColumn("_part", F.pmod(salt, F.col("_parts")).cast("int")).drop("_parts", *[f"_k{i}" for i in range(len(keys))])
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = parted.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    joined = ranked.join(small(offsets), same & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumn(rank, F.col("_row") + F.col("_before")).drop("_row", "_before", "_part", "_p", *[f"_k{i}" for i in range(len(keys))])
