"""Outliers of coverage under a zero-inflated Poisson."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import ZeroInflatedPoisson

#: One in the number of 10-base bins of a genome.
THRESHOLD = 1 / 263_000_000


def counted(col: str) -> Column:
    """A value as the model counts it: rounded to an integer, NULL and negative values as zero."""
    return F.greatest(F.coalesce(F.rint(col), F.lit(0.0)), F.lit(0.0))


def zip_stats(bins: DataFrame, col: str = "cov") -> DataFrame:
    """(chrom, n, mu, nonzero) of values rounded to integers; NULL and negative values count as zero."""
    v = counted(col)
    return bins.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mu"), F.count_if(v != 0).alias("nonzero"))


def thresholds(stats: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chrom, k): the least count whose tail probability is below *threshold*. A row a chromosome goes to Python."""

    @F.pandas_udf("long")
    def least(n: pd.Series, mu: pd.Series, nonzero: pd.Series) -> pd.Series:
        return pd.Series([ZeroInflatedPoisson(int(a), float(b), int(c)).clip_at(threshold) for a, b, c in zip(n, mu, nonzero, strict=True)])

    return stats.select("chrom", least("n", "mu", "nonzero").alias("k"))


def clip(bins: DataFrame, limits: DataFrame, col: str = "cov") -> DataFrame:
    """Adds cov_clip (values above k become k) and cov_raw (they become NULL)."""
    over = F.col(col) > F.col("k")
    rows = bins.join(F.broadcast(limits), "chrom")
    return rows.withColumn("cov_clip", F.when(over, F.col("k").cast("double")).otherwise(F.col(col))).withColumn("cov_raw", F.when(~over, F.col(col))).drop("k")
