"""From reads to bins: coverage, fragment lengths, GC, bucket means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import rint_to
from tessera.operators.select import quantiles
from tessera.sources.stage import stage_table


def good_reads(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Reads of enough mapping quality with usable coordinates."""
    return reads.filter((F.col("mapq") >= min_mapq) & (F.col("start") >= 0) & F.col("end").isNotNull())


def fragments(reads: DataFrame, low: float = 100, high: float = 220, min_mapq: int = 20) -> DataFrame:
    """First reads of proper pairs whose absolute template length lies in [low, high]; adds frag_len."""
    n = F.abs("tlen")
    return good_reads(reads, min_mapq).filter(F.col("proper_pair") & F.col("is_read1") & n.between(low, high)).withColumn("frag_len", n)


def touched_bins(reads: DataFrame, width: int) -> DataFrame:
    """A row for each bin from a read's start to its end (inclusive) with the share of the bin it covers.

    A read touches length / width bins, so this explode is linear in the reads; no range join is needed."""
    rows = reads.withColumn("idx", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    lo, hi = F.col("idx") * width, (F.col("idx") + 1) * width
    inside = F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(F.col("start"), lo))
    return rows.withColumn("share", inside / F.lit(float(width)))


def coverage(reads: DataFrame, width: int, min_mapq: int = 20) -> DataFrame:
    """(chrom, idx, cov) of touched bins: covered length over bin width."""
    return touched_bins(good_reads(reads, min_mapq), width).groupBy("chrom", "idx").agg(F.sum("share").alias("cov"))


def start_counts(reads: DataFrame, width: int, min_mapq: int = 20) -> DataFrame:
    """(chrom, idx, n): reads that start in a bin."""
    rows = good_reads(reads, min_mapq).withColumn("idx", F.expr(f"start div {width}"))
    return rows.groupBy("chrom", "idx").agg(F.count(F.lit(1)).alias("n"))


def on_spine(spine: DataFrame, values: DataFrame, col: str = "cov") -> DataFrame:
    """Every bin of the spine, with zero where there is no value."""
    return spine.join(values.select("chrom", "idx", col), ["chrom", "idx"], "left").withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))


def mean_lengths(reads: DataFrame, width: int, **limits) -> DataFrame:
    """(chrom, idx, mean_len): fragment lengths weighted by the share of the bin they cover; NULL without any."""
    rows = touched_bins(fragments(reads, **limits), width)
    agg = rows.groupBy("chrom", "idx").agg(F.sum(F.col("frag_len") * F.col("share")).alias("num"), F.sum("share").alias("den"))
    return agg.select("chrom", "idx", F.try_divide(F.col("num"), F.nullif(F.col("den"), F.lit(0.0))).alias("mean_len"))


def length_totals(reads: DataFrame, width: int, **limits) -> DataFrame:
    """(chrom, idx, total): sums of fragment lengths weighted by the share of the bin they cover."""
    return touched_bins(fragments(reads, **limits), width).groupBy("chrom", "idx").agg(F.sum(F.col("frag_len") * F.col("share")).alias("total"))


def start_lengths(reads: DataFrame, width: int, **limits) -> DataFrame:
    """(chrom, idx, mean_len, median_len) of fragments that start in a bin."""
    rows = fragments(reads, **limits).withColumn("idx", F.expr(f"start div {width}"))
    return rows.groupBy("chrom", "idx").agg(F.avg("frag_len").alias("mean_len"), F.median("frag_len").alias("median_len"))


def guarded_means(bins: DataFrame, total: str, cov: str, out: str = "mean_len", digits: int = 7) -> DataFrame:
    """Adds *out*: the *total* of lengths over the coverage, where that is above 0; elsewhere the total itself."""
    v = F.when(F.col(cov) > 0, F.col(total) / F.col(cov)).otherwise(F.col(total))
    return bins.withColumn(out, rint_to(v, digits))


def summary(rows: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Mean, population deviation and exact median; no task holds all values of a group."""
    rows = stage_table(rows.select(*by, col), "summed")
    out = rows.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    return out.join(quantiles(rows, by, {"median": (col, 0.5)}, stored=True), by)


def gc_fraction(seq: Column) -> Column:
    """Share of G and C in a string, in either case; an empty string has 0."""
    n = F.length(F.regexp_replace(seq, "[^GCgc]", ""))
    return F.coalesce(F.try_divide(n, F.length(seq)), F.lit(0.0))


def gc_per_bin(seqs: DataFrame, key: str, seq: str, width: int) -> DataFrame:
    """(key, idx, gc): GC of each *width* letters. There are ``length // width + 1`` bins: the last may be shorter,
    and has no letters and 0 where the length is a multiple of the width. A null sequence has none."""
    # The sequence is cut once, from its start to its end; a substring for each bin would walk to it each time.
    parts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    parts = F.when(F.length(seq) % width == 0, F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    rows = seqs.filter(F.col(seq).isNotNull()).select(key, F.posexplode(parts).alias("idx", "part"))
    return rows.select(key, F.col("idx").cast("long").alias("idx"), gc_fraction(F.col("part")).alias("gc"))


def rebin_mean(bins: DataFrame, col: str, factor: int = 10) -> DataFrame:
    """(chrom, idx, col): mean of *factor* neighbouring bins by their number."""
    rows = bins.withColumn("idx", F.expr(f"idx div {factor}"))
    return rows.groupBy("chrom", "idx").agg(F.avg(col).alias(col))


def at_bin_size(bins: DataFrame, col: str, size: int, width: int = 10) -> DataFrame:
    """Bins of *width* as they are, or the means of ten of them; other sizes are an error."""
    if size == width:
        return bins.select("chrom", "idx", col)
    if size == 10 * width:
        return rebin_mean(bins, col)
    raise ValueError(f"bins of {size} from bins of {width}: only {width} and {10 * width} can be had")


def rebin_positional(bins: DataFrame, col: str, by: list[str], factor: int = 10, block: int = 100_000) -> DataFrame:
    """Sum of every *factor* rows that are there, in order of idx (rows, not numbers, are counted).

    Rows are counted by blocks of *block* bins; a row's rank is its rank in its block plus the rows of the
    blocks before, so only the counts of blocks pass through a window over a whole key."""
    rows = bins.withColumn("__block", F.expr(f"idx div {block}"))
    counts = rows.groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    n = F.row_number().over(Window.partitionBy(*by, "__block").orderBy("idx")) - 1 + F.col("__before")
    rows = rows.join(counts, [*by, "__block"]).withColumn("grp", F.floor(n / factor).cast("long"))
    return rows.groupBy(*by, "grp").agg(F.sum(col).alias(col))


def excluded(*sets: DataFrame) -> DataFrame:
    """Union of exclude sets, each row once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def without(bins: DataFrame, exclude: DataFrame) -> DataFrame:
    """Bins that no row of *exclude* names (by idx, and by chrom where it has it)."""
    return bins.join(exclude, [c for c in ("chrom", "idx") if c in exclude.columns], "left_anti")


def only(bins: DataFrame, include: DataFrame) -> DataFrame:
    return bins.join(include, [c for c in ("chrom", "idx") if c in include.columns], "left_semi")


def tidy_edges(edges: list[float]) -> list[float]:
    return sorted({float(e) for e in edges})


def bucket_of(x: Column, edges: list[float]) -> Column:
    """Number of the half-open bucket of *x*; the last is closed. NULL outside and for NULL."""
    e = tidy_edges(edges)
    arr = F.array(*[F.lit(v) for v in e])
    k = F.size(F.filter(arr, lambda v: v <= x)) - 1
    return F.when((x >= e[0]) & (x <= e[-1]), F.least(k, F.lit(len(e) - 2)))


def clamped_bucket(x: Column, edges: list[float]) -> Column:
    """As :func:`bucket_of`, with values outside in the end buckets. NULL for NULL."""
    e = tidy_edges(edges)
    arr = F.array(*[F.lit(v) for v in e])
    k = F.size(F.filter(arr, lambda v: v <= x)) - 1
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(k, F.lit(len(e) - 2))))


def bucket_spine(keys: DataFrame, edges: list[float]) -> DataFrame:
    """Every bucket of every key, with its middle."""
    e = tidy_edges(edges)
    b = F.explode(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(lo + (hi - lo) / 2).alias("mid")) for i, (lo, hi) in enumerate(zip(e, e[1:], strict=False))]))
    return keys.select("*", b.alias("b")).select(*keys.columns, "b.bucket", "b.mid")


def bucket_means(rows: DataFrame, x: str, y: str, edges: list[float], nan_zeroes: bool = False, nan_extremes: bool | str = False) -> DataFrame:
    """(chrom, bucket, mid, mean): mean of non-NULL *y* by bucket of *x*, NULL where there is none.

    *nan_zeroes* makes zero means NULL; *nan_extremes* (True, 'min' or 'max') the end buckets."""
    if nan_extremes not in (True, False, "min", "max"):
        raise ValueError("nan_extremes is True, False, 'min' or 'max'")
    last = len(tidy_edges(edges)) - 2
    agg = rows.withColumn("bucket", bucket_of(F.col(x), edges)).filter("bucket is not null").groupBy("chrom", "bucket").agg(F.avg(y).alias("mean"))
    out = bucket_spine(rows.select("chrom").distinct(), edges).join(agg, ["chrom", "bucket"], "left")
    mean = F.col("mean")
    if nan_zeroes:
        mean = F.nullif(mean, F.lit(0.0))
    gone = {True: [0, last], "min": [0], "max": [last], False: []}[nan_extremes]
    if gone:
        mean = F.when(~F.col("bucket").isin(gone), mean)
    return out.withColumn("mean", mean)


def midpoints(edges: DataFrame) -> DataFrame:
    """(bucket, mid) from a table of edges."""
    w = Window.orderBy("edge")
    rows = edges.select("edge").distinct().withColumn("next", F.lead("edge").over(w)).withColumn("bucket", F.row_number().over(w) - 1)
    return rows.filter("next is not null").select("bucket", (F.col("edge") + (F.col("next") - F.col("edge")) / 2).alias("mid"))


def bed_bins(bed: DataFrame, chrom_len: int, width: int) -> DataFrame:
    """(chrom, idx) of bins from an interval's start bin to its end bin, inclusive. Intervals whose end bin
    lies past the last bin are dropped whole."""
    last = chrom_len // width
    rows = bed.filter((F.col("start") >= 0) & (F.expr(f"end div {width}") <= last) & (F.col("end") >= F.col("start")))
    return rows.select("chrom", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))).alias("idx")).distinct()


def aligned(bins: DataFrame, reads: DataFrame, width: int) -> DataFrame:
    """Bins with coverage (2 decimals) and mean fragment length (7 decimals; NULL without fragments)."""
    out = on_spine(bins, coverage(reads, width)).withColumn("cov", rint_to(F.col("cov"), 2))
    return out.join(mean_lengths(reads, width), ["chrom", "idx"], "left").withColumn("mean_len", rint_to(F.col("mean_len"), 7))
