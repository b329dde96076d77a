"""Bias curves: smoothing, factors and their application."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import as_float32
from tessera.operators.binning import bucket_means, clamped_bucket


def kernel(size: int = 5, kind: str = "gaussian", std: float = 1.0) -> list[float]:
    """Weights that sum to one."""
    if size % 2 == 0:
        raise ValueError("a kernel has an odd size")
    if kind == "uniform":
        return [1.0 / size] * size
    if kind != "gaussian":
        raise ValueError("a kernel is gaussian or uniform")
    w = [math.exp(-0.5 * ((i - size // 2) / std) ** 2) for i in range(size)]
    return [x / sum(w) for x in w]


def smooth(curve: DataFrame, col: str, weights: list[float], key: str = "chrom", order: str = "bucket") -> DataFrame:
    """Weighted mean of neighbours, zeros beyond the ends. With a NULL among them a value stays as it is.
    Curves shorter than the kernel stay as they are."""
    half, w = len(weights) // 2, Window.partitionBy(key).orderBy(order)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    terms = None
    for i, weight in enumerate(weights):
        d = i - half
        near = F.col(col) if d == 0 else (F.lag(col, -d, 0.0).over(w) if d < 0 else F.lead(col, d, 0.0).over(w))
        terms = near * weight if terms is None else terms + near * weight
    return curve.withColumn("__smooth", F.when(size >= len(weights), terms)).withColumn(col, F.coalesce("__smooth", col)).drop("__smooth")


def by_mean(curve: DataFrame, col: str, key: str = "chrom") -> DataFrame:
    """Divided by the mean of its values that aren't NULL."""
    return curve.withColumn(col, F.try_divide(F.col(col), F.avg(col).over(Window.partitionBy(key))))


def gc_factors(bins: DataFrame, edges: list[float], x: str = "gc", y: str = "cov_clip", weights: list[float] | None = None) -> DataFrame:
    """(chrom, bucket, mid, factor): bucket means without zeros and ends, smoothed, over their mean."""
    curve = bucket_means(bins, x, y, edges, nan_zeroes=True, nan_extremes=True).withColumnRenamed("mean", "factor")
    return by_mean(smooth(curve, "factor", weights or kernel()), "factor")


def apply_factors(bins: DataFrame, factors: DataFrame, x: str, col: str, edges: list[float], out: str, only: Column | None = None) -> DataFrame:
    """Adds *out*: *col* without negative values over its bucket's factor.

    Factors are divided by their mean and narrowed to 32 bits; zero factors are NULL. Values of *x* outside
    the edges take the end buckets. Rows that *only* doesn't hold for keep *col*. A factor table has a row
    for each bucket and chromosome, as an array for each chromosome, which is broadcast."""
    table = by_mean(factors.select("chrom", "bucket", "factor"), "factor")
    table = table.withColumn("factor", F.nullif(as_float32(F.col("factor")), F.lit(0.0)))
    table = table.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("bucket", "factor"))).alias("__f"))
    rows = bins.join(F.broadcast(table), "chrom", "left")
    k = clamped_bucket(F.col(x), edges)
    value = F.try_divide(F.when(F.col(col) < 0, 0.0).otherwise(F.col(col)), F.col("__f")[k]["factor"])
    if only is not None:
        value = F.when(F.coalesce(only, F.lit(False)), value).otherwise(F.col(col))
    return rows.withColumn(out, value).drop("__f")


def legacy_gc_factors(bins: DataFrame, x: str = "gc", y: str = "cov", buckets: int = 20) -> DataFrame:
    """Equal buckets of GC between 0 and 1, no smoothing, ends kept: bucket means (zeros as NULL) over their mean."""
    curve = bucket_means(bins, x, y, [i / buckets for i in range(buckets + 1)], nan_zeroes=True)
    return by_mean(curve.withColumnRenamed("mean", "factor"), "factor")


def apply_legacy_gc(bins: DataFrame, factors: DataFrame, x: str = "gc", col: str = "cov", buckets: int = 20, out: str = "cov_gc") -> DataFrame:
    """*col* over its bucket's factor as it is; negative results become zero."""
    k = clamped_bucket(F.col(x), [i / buckets for i in range(buckets + 1)])
    rows = bins.withColumn("bucket", k).join(F.broadcast(factors.select("chrom", "bucket", "factor")), ["chrom", "bucket"], "left")
    value = F.try_divide(F.col(col), F.nullif(F.col("factor"), F.lit(0.0)))
    return rows.withColumn(out, F.when(value < 0, 0.0).otherwise(value)).drop("bucket", "factor")
