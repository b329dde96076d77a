"""The engine from reads to features, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import bias, binning, correlate, megabins, outliers
from tessera.operators.insert_size import correct_insert_sizes, insert_size_factors
from tessera.sources import tables as S
from tessera.sources.stage import stage_table

WIDTH = S.BIN
MEGA, STRIDE = 48 * WIDTH, 288
GC_EDGES = [i / 10 for i in range(11)]
LENGTH_EDGES = [float(x) for x in range(100, 221, 10)]


def include(spark: SparkSession, d: str) -> DataFrame:
    """The spine without excluded bins."""
    return binning.without(S.spine(spark, d), binning.excluded(*S.excludes(spark, d)))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return binning.aligned(include(spark, d), S.reads(spark, d), WIDTH)


def clipped(spark: SparkSession, d: str) -> DataFrame:
    """Bins are written once: thresholds come from them, and so does what they clip."""
    bins = stage_table(aligned(spark, d), "aligned")
    return outliers.clip(bins, outliers.thresholds(outliers.zip_stats(bins)))


def gc_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Clipped bins are written once, read for the factors and for what they correct; corrected ones too."""
    bins = stage_table(clipped(spark, d), "clipped")
    return stage_table(bias.apply_factors(bins, bias.gc_factors(bins, GC_EDGES), "gc", "cov_clip", GC_EDGES, "cov_gc"), "corrected")


def insert_size_corrected(spark: SparkSession, d: str) -> DataFrame:
    bins = gc_corrected(spark, d)
    return stage_table(correct_insert_sizes(bins, insert_size_factors(bins, LENGTH_EDGES), LENGTH_EDGES), "corrected")


def normalized(spark: SparkSession, d: str, insert_sizes: bool = False) -> DataFrame:
    bins, col = (insert_size_corrected(spark, d), "cov_is") if insert_sizes else (gc_corrected(spark, d), "cov_gc")
    return stage_table(megabins.normalize(bins, WIDTH, MEGA, STRIDE, col), "normalized")


def sums(spark: SparkSession, d: str, bins: DataFrame, col: str, keep_consensus: bool = False, masks: DataFrame | None = None, man: DataFrame | None = None) -> DataFrame:
    """The six sums for every mask (those of *masks*, if given), after the consensus bins have gone."""
    man = stage_table(S.manifest(spark, d), "manifest") if man is None else man
    rows = bins.select("chrom", "idx", col)
    none = S.consensus(spark, d)
    if keep_consensus:
        none = none.filter("false")
    rows = correlate.without_consensus(rows, none, man)
    return correlate.sparse_sums(rows, S.masks(spark, d) if masks is None else masks, man, col)


def features(spark: SparkSession, d: str, p_values: bool = True, keep_consensus: bool = False) -> DataFrame:
    """Slice: plain coverage against masks, no corrections."""
    bins = stage_table(aligned(spark, d), "aligned")
    return correlate.features(sums(spark, d, bins, "cov", keep_consensus), p_values)


def both_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The slice without and with consensus bins, from the same bins, masks and manifest. A mask of whose bins the consensus
    leaves none has no features without them, and so is in neither."""
    bins, masks, man = stage_table(aligned(spark, d), "aligned"), stage_table(S.masks(spark, d), "masks"), stage_table(S.manifest(spark, d), "manifest")
    without, with_ = (correlate.features(sums(spark, d, bins, "cov", keep, masks, man), p_values=False) for keep in (False, True))
    without = stage_table(without, "without")
    return without, with_.join(without.select("mask_type", "cell_type"), ["mask_type", "cell_type"], "left_semi")


def flagship(spark: SparkSession, d: str, p_values: bool = False, insert_sizes: bool = False) -> DataFrame:
    """Reads, coverage, clipping, GC correction, megabins, consensus, correlation; bins are written after each
    step that is read more than once."""
    return correlate.features(sums(spark, d, normalized(spark, d, insert_sizes), "cov_norm"), p_values)
