"""Correlation of coverage with sparse masks, from mergeable sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import as_float32, correlation_p_value

#: The ten statistics in their order.
STATS = ["pearson_r", "p_value", "fraction_within", "cosine_similarity", "x_sum", "y_sum", "x_squared_sum", "y_squared_sum", "xy_sum", "n"]
_SUMS = ["n", "sx", "sxx", "sy", "syy", "sxy"]


def dense_sums(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """The six sums over rows where neither value is NULL. They merge by adding."""
    a, b = F.col(x), F.col(y)
    rows = pairs.filter(a.isNotNull() & b.isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(a * a).alias("sxx"), F.sum(b).alias("sy"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )


def without_consensus(bins: DataFrame, consensus: DataFrame, types: DataFrame) -> DataFrame:
    """The bins for each mask type, less its consensus bins. *types* has a row a mask type."""
    rows = bins.join(F.broadcast(types.select("mask_type").distinct()))
    return rows.join(consensus.select("mask_type", "chrom", "idx"), ["mask_type", "chrom", "idx"], "left_anti")


def removal_totals(bins: DataFrame, consensus: DataFrame, x: str) -> DataFrame:
    """(mask_type, x_sum, x_squared_sum, n) of the bins that the consensus takes out; NULL values are left out."""
    rows = bins.join(consensus.select("mask_type", "chrom", "idx"), ["chrom", "idx"])
    return rows.groupBy("mask_type").agg(F.sum(x).alias("x_sum"), F.sum(F.col(x) * F.col(x)).alias("x_squared_sum"), F.count(x).alias("n"))


def sparse_sums(bins: DataFrame, masks: DataFrame, manifest: DataFrame, x: str) -> DataFrame:
    """(mask_type, cell_type and the six sums) of *bins* (mask_type, chrom, idx, x) with masks of which only
    non-zero rows are stored.

    A bin without a mask row has 0, so sums with y need the stored rows alone; n and the sums of x are the
    same for all cell types of a chromosome. The join's output is the stored rows, not cell types x bins.
    Chromosomes for which a cell type has no mask at all (by *manifest*) don't count for it.
    """
    rows = bins.filter(F.col(x).isNotNull()).withColumn("x", F.col(x).cast("double"))
    per = rows.groupBy("mask_type", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    wide = manifest.join(F.broadcast(per), ["mask_type", "chrom"]).groupBy("mask_type", "cell_type").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx")])
    y = as_float32(F.col("overlap"))
    hits = masks.join(rows.select("mask_type", "chrom", "idx", "x"), ["mask_type", "chrom", "idx"]).withColumn("y", y)
    near = hits.groupBy("mask_type", "cell_type").agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    out = wide.join(near, ["mask_type", "cell_type"], "left")
    return out.select("mask_type", "cell_type", "n", "sx", "sxx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sy", "syy", "sxy")])


def consensus_sums(bins: DataFrame, consensus: DataFrame, x: str, name: str = "consensus") -> DataFrame:
    """The six sums of *bins* (chrom, idx, x), none removed, with the consensus (mask_type, chrom, idx, overlap) as a cell
    type of each mask type, over the chromosomes it has."""
    types = consensus.select("mask_type", "chrom").distinct()
    rows = types.join(bins.select("chrom", "idx", x), "chrom")
    return sparse_sums(rows, consensus.withColumn("cell_type", F.lit(name)), types.withColumn("cell_type", F.lit(name)), x)


def features(sums: DataFrame, p_values: bool = True, keep_small: bool = False) -> DataFrame:
    """The ten statistics from the six sums.

    r and the cosine are 0 where a norm is 0, and lie within [-1, 1]. With fewer than two pairs all are 0
    and p is 1 (*keep_small*: the sums and n stay). p comes from Python, a row for each mask."""
    n = F.col("n").cast("double")
    sx, sy, sxx, syy, sxy = (F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy"))
    unit = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    low = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    r = F.coalesce(F.try_divide(n * sxy - sx * sy, F.nullif(low(n * sxx - sx * sx) * low(n * syy - sy * sy), F.lit(0.0))), F.lit(0.0))
    cos = F.coalesce(F.try_divide(sxy, F.nullif(low(sxx) * low(syy), F.lit(0.0))), F.lit(0.0))
    enough = F.col("n") >= 2
    some = lambda v: F.when(enough, v).otherwise(0.0)
    raw = (lambda v: v.cast("double")) if keep_small else (lambda v: F.when(enough, v.cast("double")).otherwise(0.0))
    out = sums.withColumns(
        {
            "pearson_r": some(unit(r)),
            "fraction_within": some(F.try_divide(sxy, F.nullif(n, F.lit(0.0)))),
            "cosine_similarity": some(unit(cos)),
            "x_sum": raw(sx), "y_sum": raw(sy), "x_squared_sum": raw(sxx), "y_squared_sum": raw(syy), "xy_sum": raw(sxy),
        }
    ).withColumn("n", raw(F.col("n")))

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p_value(float(a), float(b)) for a, b in zip(r, n, strict=True)])

    names = STATS if p_values else [s for s in STATS if s != "p_value"]
    if p_values:
        out = out.withColumn("p_value", p_of("pearson_r", "n"))
    return out.select(*[c for c in sums.columns if c not in _SUMS], *names)


def standardize(feats: DataFrame, col: str = "pearson_r") -> tuple[DataFrame, DataFrame]:
    """*feats* with *col* less its mean over its population deviation (centred only where that is 0), over
    all rows together; and the one row of mean and std."""
    params = feats.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    rows = feats.join(F.broadcast(params))
    centred = F.col(col) - F.col("mean")
    return rows.withColumn(col, F.when(F.col("std") > 0, centred / F.col("std")).otherwise(centred)).drop("mean", "std"), params


def zscore(rows: DataFrame, col: str, by: str = "chrom") -> DataFrame:
    """Values less their mean over their population deviation, by chromosome; centred only if that is 0. A row
    a chromosome is broadcast."""
    per = rows.groupBy(by).agg(F.avg(col).alias("__mean"), F.stddev_pop(col).alias("__sd"))
    centred = F.col(col) - F.col("__mean")
    out = rows.join(F.broadcast(per), by)
    return out.withColumn(col, F.when(F.col("__sd") > 0, centred / F.col("__sd")).otherwise(centred)).select(*rows.columns)


def long_form(feats: DataFrame) -> DataFrame:
    """(feature, value, ord) with keys stat_masktype::celltype, stat after stat."""
    keys = ["mask_type", "cell_type"]
    stats = [c for c in feats.columns if c in STATS]
    rows = feats.unpivot(keys, stats, "stat", "value")
    name = F.concat_ws("", "stat", F.lit("_"), "mask_type", F.lit("::"), "cell_type")
    ord_ = F.array_position(F.array(*[F.lit(s) for s in STATS]), F.col("stat"))
    return rows.select(name.alias("feature"), "value", F.struct(ord_.alias("stat"), "mask_type", "cell_type").alias("ord"))
