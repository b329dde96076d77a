"""Feature matrices: long to wide, order, and differences of two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import rint_to
from tessera.operators.correlate import STATS
from tessera.operators.select import quantiles
from tessera.sources.stage import stage_table


def wide_form(long: DataFrame, missing: float | None = None, default: str = "DNase") -> DataFrame:
    """(mask_type, cell_type, ten statistics) of (feature, value).

    A key is stat_masktype::celltype, or stat_celltype for the mask type *default*; where both are there, the
    first form counts. Keys of no statistic are an error; missing statistics are NULL, or *missing*."""
    form = "^(" + "|".join(STATS) + ")_(.*)$"
    stat, rest = F.regexp_extract("feature", form, 1), F.regexp_extract("feature", form, 2)
    bad = F.raise_error(F.concat(F.lit("no feature: "), "feature"))
    plain = ~F.contains(rest, F.lit("::"))
    rows = long.select(
        F.when(stat != "", stat).otherwise(bad).alias("stat"),
        F.when(plain, F.lit(default)).otherwise(F.split_part(rest, F.lit("::"), F.lit(1))).alias("mask_type"),
        F.when(plain, rest).otherwise(F.regexp_replace(rest, "^.*?::", "")).alias("cell_type"),
        plain.alias("plain"),
        "value",
    )
    out = rows.groupBy("mask_type", "cell_type").pivot("stat", STATS).agg(F.min_by("value", "plain"))
    return out if missing is None else out.fillna(missing, STATS)


def in_order(wide: DataFrame, dims: DataFrame, first: str, skip_empty: bool = False) -> DataFrame:
    """Columns of the matrix in order: mask type *first* before others, then the dimension's own order;
    adds col_idx. Cell types without features are an error, and so is any statistic that one of them lacks. With *skip_empty*
    cell types that *wide* doesn't have keep their number but give no row."""
    w = Window.orderBy((F.col("mask_type") != first).cast("int"), "mask_type", "row_ord")
    places = dims.select("mask_type", "cell_type", (F.row_number().over(w) - 1).cast("long").alias("__at"))
    rows = places.join(wide, ["mask_type", "cell_type"], "inner" if skip_empty else "left")
    stats = [c for c in STATS if c in wide.columns]
    lost = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in stats]))
    bad = F.raise_error(F.concat(F.lit("no features: "), F.col("mask_type"), F.lit("::"), F.col("cell_type"), F.lit(" ("), F.array_join(lost, ", "), F.lit(")")))
    # Both columns hold the check: one that nobody selects is never computed.
    checked = {"n": F.when(F.size(lost) == 0, F.col("n")).otherwise(bad.cast("double")), "col_idx": F.when(F.size(lost) == 0, F.col("__at")).otherwise(bad.cast("long"))}
    return rows.withColumns(checked).drop("__at")


def wanted_cells(dims: DataFrame, cells: dict[str, list[str] | None] | None = None) -> DataFrame:
    """The rows of *dims* (mask_type, cell_type, row_ord) of the mask types and cell types asked for, in the dimension's order
    whatever that of the request. A mask type with None has all its cell types; names that aren't there give no rows."""
    if cells is None:
        return dims
    keep = F.lit(False)
    for kind, names in cells.items():
        here = F.col("mask_type") == kind
        keep = keep | (here if names is None else here & F.col("cell_type").isin([n.strip() for n in names if n.strip()]))
    return dims.filter(keep)


def diffs(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("mask_type", "cell_type")) -> DataFrame:
    """(keys, stat, diff): absolute differences; a key that only one side has is an error."""
    stats = [c for c in STATS if c in a.columns and c in b.columns]
    left, right = (m.unpivot(list(keys), stats, "stat", v) for m, v in ((a, "va"), (b, "vb")))
    rows = left.join(right, [*keys, "stat"], "full_outer")
    one = F.raise_error(F.lit("the matrices have different keys")).cast("double")
    return rows.select(*keys, "stat", F.abs(F.coalesce("va", one) - F.coalesce("vb", one)).alias("diff"))


def diff_stats(d: DataFrame) -> DataFrame:
    """max, mean, median and 99th percentile (interpolated) by statistic."""
    d = stage_table(d.select("stat", "diff"), "diffs")
    ends = d.groupBy("stat").agg(F.max("diff").alias("max"), F.avg("diff").alias("mean"))
    return ends.join(quantiles(d, ["stat"], {"median": ("diff", 0.5), "p99": ("diff", 0.99)}, stored=True), "stat")


def value_counts(d: DataFrame, digits: int = 2) -> DataFrame:
    """(stat, diff, n) of rounded differences."""
    return d.groupBy("stat", rint_to(F.col("diff"), digits).alias("diff")).agg(F.count(F.lit(1)).alias("n"))


def _rank():
    return F.array_position(F.array(*[F.lit(s) for s in STATS]), F.col("stat"))


def top_columns(d: DataFrame, k: int) -> DataFrame:
    """The *k* columns of largest difference, with the statistic it occurs in (of equals the first)."""
    best = d.groupBy("mask_type", "cell_type").agg(F.max(F.struct(F.col("diff"), (-_rank()).alias("r"), F.col("stat"))).alias("b"))
    w = Window.orderBy(F.desc("b.diff"), "mask_type", "cell_type")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("rank", "mask_type", "cell_type", "b.stat", "b.diff")


def examples(d: DataFrame, each: int = 3, digits: int = 2) -> DataFrame:
    """The first *each* columns for every rounded difference of a statistic."""
    rows = d.withColumn("rounded", rint_to(F.col("diff"), digits))
    w = Window.partitionBy("stat", "rounded").orderBy("mask_type", "cell_type")
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).select("stat", "rounded", "k", "mask_type", "cell_type")


def worst(d: DataFrame, each: int = 5) -> DataFrame:
    """(stat, rank, mask_type, cell_type, diff): the *each* largest differences of every statistic, of equals the first columns."""
    w = Window.partitionBy("stat").orderBy(F.desc("diff"), "mask_type", "cell_type")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each).select("stat", "rank", "mask_type", "cell_type", "diff")
