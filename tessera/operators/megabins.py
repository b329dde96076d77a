"""Normalisation by overlapping large bins ("megabins").

Tilings of width *size* are offset by *stride*; the first starts at the smallest coordinate, the k-th at
``size - k * stride`` before it. Rows past a tiling's last edge belong to its last megabin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.select import quantiles
from tessera.sources.stage import stage_table

TINY = 1e-10


def with_ends(bins: DataFrame, width: int) -> DataFrame:
    """*bins* with their start and their chromosome's first and last start; a row a chromosome is broadcast."""
    rows = bins.withColumn("start", F.col("idx") * width)
    return rows.join(F.broadcast(rows.groupBy("chrom").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))), "chrom")


def tilings(bins: DataFrame, width: int, size: int, stride: int, col: str) -> DataFrame:
    """Every bin once for each tiling, with its megabin: the definition itself, and what quantiles need."""
    k = -(-size // stride)
    rows = with_ends(bins, width)
    rows = rows.withColumn("tiling", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    first = F.col("lo") - F.when(F.col("tiling") > 0, size - stride * F.col("tiling")).otherwise(0)
    last = F.ceil((F.col("hi") - first) / size).cast("long") - 1
    at = F.floor((F.col("start") - first) / size).cast("long")
    return rows.withColumn("mega", F.when(last >= 0, F.greatest(F.lit(0), F.least(at, last)))).select("chrom", "idx", F.col(col), "tiling", "mega")


def _blocks(bins: DataFrame, width: int, size: int, stride: int, *sums) -> DataFrame:
    """(chrom, b, *sums*, last, edge) for every block of *stride*, and for those before the first that megabins begin at."""
    rows = with_ends(bins, width).withColumn("b", F.expr(f"(start - lo) div {stride}"))
    blocks = rows.groupBy("chrom", "b").agg(*sums, F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    ends = rows.groupBy("chrom").agg(F.max("b").alias("last"), F.max(F.col("hi") - F.col("lo")).alias("span"))
    blocks = blocks.drop("lo", "hi")
    edge = ((F.col("span") > 0) & (F.col("span") % stride == 0)).alias("edge")
    spine = ends.select("chrom", F.explode(F.sequence(F.lit(1 - size // stride), F.col("last"))).alias("b"), "last", edge)
    return spine.join(blocks, ["chrom", "b"], "left")


def _spread(megas: DataFrame, k: int) -> DataFrame:
    """(chrom, b, means): from the mean of the megabin that begins at each block, those of the K that a block lies in."""
    order = Window.partitionBy("chrom").orderBy("b")
    at_edge = F.collect_list("mean").over(order.rangeBetween(-k, -1))
    usual = F.collect_list("mean").over(order.rangeBetween(1 - k, 0))
    return megas.select("chrom", "b", F.when(F.col("edge") & (F.col("b") == F.col("last")), at_edge).otherwise(usual).alias("means"))


def _block_means(bins: DataFrame, width: int, size: int, stride: int, col: str) -> DataFrame:
    """(chrom, b, means): the megabin means of each block's tilings, from sums of blocks of *stride*.

    Megabin j covers blocks j to j + K - 1, and block b lies in those from b - K + 1 to b. If the largest
    coordinate is on a tiling's edge (the span is a multiple of the stride), its row joins the megabin
    before that edge: its sums are added to megabin L - K, and block L reads that one instead of L."""
    k = size // stride
    dense = _blocks(bins, width, size, stride, F.sum(col).alias("s"), F.count(col).alias("n"))
    ahead = Window.partitionBy("chrom").orderBy("b").rangeBetween(0, k - 1)
    whole = Window.partitionBy("chrom").orderBy("b").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tail = lambda c: F.last(F.coalesce(F.col(c), F.lit(0))).over(whole)
    extra = F.col("edge") & (F.col("b") == F.col("last") - k)
    total = F.coalesce(F.sum("s").over(ahead), F.lit(0.0)) + F.when(extra, tail("s")).otherwise(0.0)
    count = F.coalesce(F.sum("n").over(ahead), F.lit(0)) + F.when(extra, tail("n")).otherwise(0)
    return _spread(dense.withColumn("mean", F.try_divide(total, F.nullif(count.cast("double"), F.lit(0.0)))), k)


def _capped_means(bins: DataFrame, width: int, size: int, stride: int, col: str, above: float, each: int = 64) -> DataFrame:
    """As :func:`_block_means`, of values capped at each megabin's own quantile *above*.

    A block's values are one sorted run; a task merges the runs of its *each* blocks' megabins, so a value is sent once,
    or twice near the end of a task's blocks, and not once a tiling."""
    k = size // stride
    dense = _blocks(bins, width, size, stride, F.sort_array(F.collect_list(F.col(col).cast("double"))).alias("run"))
    first, last = F.floor((F.col("b") - k) / each), F.floor(F.col("b") / each)
    dealt = dense.withColumn("part", F.explode(F.sequence(first, last)))

    def means(t: pa.Table) -> pa.Table:
        b, part = t["b"].to_pylist(), t["part"][0].as_py()
        runs = {i: np.asarray(r.as_py() or [], float) for i, r in zip(b, t["run"], strict=True)}
        end, edge = t["last"][0].as_py(), t["edge"][0].as_py()
        mine = [i for i in b if i // each == part]
        out = []
        for j in mine:
            own = [runs[i] for i in range(j, j + k) if i in runs] + ([runs[end]] if edge and j == end - k else [])
            v = np.concatenate(own)
            out.append(float(np.minimum(v, np.quantile(v, above)).mean()) if len(v) else None)
        n = len(mine)
        return pa.table({"chrom": pa.array([t["chrom"][0].as_py()] * n, pa.string()), "b": pa.array(mine, pa.int64()), "last": pa.array([end] * n, pa.int64()), "edge": pa.array([edge] * n, pa.bool_()), "mean": pa.array(out, pa.float64())})

    megas = dealt.withColumn("b", F.col("b").cast("long")).groupBy("chrom", "part").applyInArrow(means, "chrom string, b long, last long, edge boolean, mean double")
    return _spread(megas, k)


def _median(xs):
    s, n = F.array_sort(xs), F.size(xs)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _mean(xs):
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(xs).cast("double"), F.lit(0.0)))


def tile_means(bins: DataFrame, width: int, size: int, stride: int, col: str = "cov", clip_above: float | None = None) -> DataFrame:
    """*bins* with ``means``, the array of their megabins' means over the tilings."""
    if size % stride == 0:
        means = _block_means(bins, width, size, stride, col) if clip_above is None else _capped_means(bins, width, size, stride, col, clip_above)
        rows = with_ends(bins, width).withColumn("b", F.expr(f"(start - lo) div {stride}")).drop("start", "lo", "hi")
        return rows.join(means, ["chrom", "b"]).drop("b")
    rows = tilings(bins, width, size, stride, col)
    if clip_above is not None:
        cap = F.percentile(col, F.lit(clip_above)).over(Window.partitionBy("chrom", "tiling", "mega"))
        rows = rows.withColumn("v", F.when(F.col(col).isNotNull(), F.least(F.col(col), cap)))
    else:
        rows = rows.withColumn("v", F.col(col))
    per = rows.filter("mega is not null").groupBy("chrom", "tiling", "mega").agg(F.avg("v").alias("m"))
    means = rows.join(per, ["chrom", "tiling", "mega"]).groupBy("chrom", "idx").agg(F.collect_list("m").alias("means"))
    return bins.join(means, ["chrom", "idx"], "left")


def normalize(
    bins: DataFrame, width: int, size: int = 5_000_000, stride: int = 500_000, col: str = "cov", out: str = "cov_norm",
    scale: str | None = "mean", center: str | None = None, clip_above: float | None = None,
) -> DataFrame:
    """Adds *out*: *col* over the mean (or median) of its megabins' means; with another *scale*, less it.

    The median form is rescaled to the median of *col*. ``scale`` values other than mean and median don't
    scale. Negative results become zero."""
    if scale is None and center is None:
        raise ValueError("scale or center is needed")
    rows = tile_means(bins, width, size, stride, col, clip_above)
    v = F.col(col)
    if scale == "mean":
        value = F.try_divide(v, _mean(F.col("means")) + TINY)
    elif scale == "median":
        rows = stage_table(rows.withColumn("__v", F.try_divide(v, _median(F.col("means")) + TINY)), "tiled")
        per = quantiles(rows, ["chrom"], {"a": (col, 0.5), "b": ("__v", 0.5)}, stored=True)
        per = per.select("chrom", F.try_divide("a", F.nullif("b", F.lit(0.0))).alias("__s"))
        rows = rows.join(F.broadcast(per), "chrom")
        value = F.col("__v") * F.col("__s")
    elif center == "mean":
        value = v - _mean(F.col("means"))
    elif center == "median":
        value = v - _median(F.col("means"))
    else:
        value = v.cast("double")
    return rows.withColumn(out, F.when(value < 0, 0.0).otherwise(value)).drop("means", "__v", "__s")
