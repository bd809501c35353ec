"""Problem 2: percentiles of very large columns with a bound on the error, from sketches that can be added.

A value x falls in bucket sign(x) * ceil(log(|x|) / log(gamma)) with gamma = (1 + a) / (1 - a); the middle of a bucket,
2 * gamma^i / (gamma + 1), is within a * |x| of every value in it, down to the smallest normal double; only 0 counts as 0.
A sketch is the table of bucket counts: sketches of
partitions, shards or days are added by adding counts, and the result is the same in whatever order. All of it is
built-in aggregation: counts are combined before the shuffle, and a group has at most a few thousand buckets for all
doubles, whatever its rows, so no task holds a group's values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ZERO = 0
#: Bucket numbers are shifted so that those of positive values are positive and those of negative values negative.
_SHIFT = 1 << 20


def gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def bucket(value: Column, accuracy: float) -> Column:
    """Signed bucket number of a finite value."""
    size = F.abs(value)
    index = (F.ceil(F.log(size) / F.lit(math.log(gamma(accuracy)))) + _SHIFT).cast("int")
    return F.when(size == 0, _ZERO).when(value < 0, -index).otherwise(index)


def middle(number: Column, accuracy: float) -> Column:
    """The value that stands for a bucket."""
    g = gamma(accuracy)
    # In two factors: the power of a subnormal or of the greatest values alone would leave the range of doubles.
    power = (F.abs(number) - _SHIFT).cast("double")
    half = F.floor(power / 2)
    size = F.pow(F.lit(g), half) * (F.lit(2 / (g + 1)) * F.pow(F.lit(g), power - half))
    return F.when(number == _ZERO, F.lit(0.0)).otherwise(F.signum(number.cast("double")) * size)


def sketch(df: DataFrame, keys: list[str], columns: list[str], accuracy: float = 0.01, keep: Column | None = None) -> DataFrame:
    """Bucket counts (keys, metric, bucket, count) of several columns in one pass.

    Null, NaN and infinite values are not counted; keep, a condition on the column `value`, leaves out more. Null keys
    form a group. An empty table gives an empty sketch.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(*keys, pairs.alias("_pair")).select(*keys, "_pair.metric", "_pair.value")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    long = long.where(finite if keep is None else finite & keep)
    return long.groupBy(*keys, "metric", bucket(F.col("value"), accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of one accuracy added up to coarser keys."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("count").alias("count"))


def quantiles(sketches: DataFrame, keys: list[str], fractions: list[float], accuracy: float = 0.01) -> DataFrame:
    """(keys, metric, fraction, rank, value, low, high, values) from merged sketches.

    The value returned for fraction q stands for the value x of rank floor(q * (n - 1)) (from 0, ascending) and lies
    within accuracy * |x| of it; low and high bound x itself. The window runs over bucket counts, not over values.
    """
    if any(not 0 <= q <= 1 for q in fractions):
        raise ValueError("fractions must lie in 0..1")
    group = Window.partitionBy(*keys, "metric")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = sketches.withColumn("_upto", F.sum("count").over(upto)).withColumn("values", F.sum("count").over(group))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("fraction")
    ranked = counted.select("*", asked).withColumn("rank", F.floor(F.col("fraction") * (F.col("values") - 1)).cast("long"))
    found = ranked.where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("count")))
    value = middle(F.col("bucket"), accuracy)
    bounds = [value / F.lit(1 + accuracy), value / F.lit(1 - accuracy)]
    return found.select(*keys, "metric", "fraction", "rank", value.alias("value"), F.least(*bounds).alias("low"), F.greatest(*bounds).alias("high"), "values")
