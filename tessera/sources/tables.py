"""Typed loaders and writers of the engine's tables, and stand-ins made from the synthetic tables.

Stand-ins: reads come from ``events`` (a chromosome is an event type, coordinates are minutes), masks from
``lineitem``, excluded bins from ``orders``, cohorts from ``embeddings``. Bins are 60 minutes, 0 to 720.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import no_nan, rint_to

BIN, BINS = 60, 721


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Loaders of files


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """Include bins: Parquet with idx and GC; only these two columns are read, NaN becomes NULL."""
    return spark.read.parquet(path).select(F.col("idx").cast("long").alias("idx"), rint_to(no_nan(F.col("GC").cast("double")), 2).alias("gc"))


def read_reads(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Aligned reads (Parquet) of a chromosome that touch [start, end); all three reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows if chrom is None else rows.filter(F.col("chrom") == chrom)
    rows = rows if end is None else rows.filter(F.col("start") < end)
    return rows if start is None else rows.filter(F.col("end") > start)


def read_cell_types(spark: SparkSession, path: str) -> DataFrame:
    """Cell types in file order; without an idx column the position counts. ``row_ord`` keeps the order."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.withColumn("row_ord", F.monotonically_increasing_id())
    idx = F.col("idx").cast("int") if "idx" in rows.columns else F.col("row_ord").cast("int")
    return rows.select(idx.alias("idx"), "cell_type", "row_ord")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED intervals; blank lines, comments, short lines and lines without integers are skipped."""
    return parse_bed(spark.read.text(path))


def parse_bed(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), "\t")
    rows = lines.filter((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#") & (F.size(part) >= 3))
    rows = rows.select(part[0].alias("chrom"), F.expr("try_cast(split(trim(value), '\t')[1] as bigint)").alias("start"), F.expr("try_cast(split(trim(value), '\t')[2] as bigint)").alias("end"))
    return rows.filter(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_cohorts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Metadata of several cohorts under one another, by name, with their dataset; missing columns are NULL."""
    out = None
    for name, path in paths.items():
        rows = spark.read.option("header", True).csv(path).withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_labels(panel: DataFrame, column: str = "Cancer Status", positive: str = "Cancer") -> DataFrame:
    """Rows of :func:`tessera.sources.files.read_panel` as a cohort (sample_id, dataset, y, features): y is 1 where the metadata's
    *column* is *positive*, else 0, as it is for rows without the column."""
    y = F.coalesce(F.col("meta")[column] == positive, F.lit(False)).cast("int")
    sample = F.coalesce(F.col("meta")["Sample ID"], F.concat_ws(":", "dataset", "row"))
    return panel.select(sample.alias("sample_id"), "dataset", y.alias("y"), "features")


# Writers


def write_long_csv(features: DataFrame, path: str) -> None:
    """Columns feature, value, in the order of ``ord``, as one CSV file: the result of one sample, a few thousand rows."""
    features.orderBy("ord").select("feature", "value").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_matrix(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").parquet(path)


def write_params(params: DataFrame, path: str) -> None:
    """Mean and standard deviation as one JSON row."""
    params.coalesce(1).write.mode("overwrite").json(path)


# Stand-ins


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 60000000")
    return e.select(
        F.col("event_type").alias("chrom"),
        start.alias("start"),
        (start + F.ceil("value")).alias("end"),
        F.get_json_object("props", "$.k").cast("int").alias("mapq"),
        (F.col("user_id") % 10 != 0).alias("proper_pair"),
        (F.col("event_id") % 2 == 0).alias("is_read1"),
        F.col("value").alias("tlen"),
    )


def spine(spark: SparkSession, sf_dir: str, bins: int = BINS) -> DataFrame:
    """Every bin of every chromosome, with its GC score."""
    chroms = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct()
    return chroms.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("idx")).withColumn("gc", (F.col("idx") * 37 % 101) / 100)


def excludes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") < BINS)
    return (
        o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("idx")),
        o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("idx")),
    )



def mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (mask_type, supplier, chrom, idx, overlap); every fifth part key is another chromosome."""
    li = table(spark, sf_dir, "lineitem")
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct()
    names = names.withColumn("k", F.row_number().over(Window.orderBy("chrom")) - 1)  # a handful of rows
    return li.join(F.broadcast(names), li["l_partkey"] % 5 == names["k"]).select(
        F.col("l_linestatus").alias("mask_type"),
        F.col("l_suppkey").alias("supplier"),
        "chrom",
        (F.col("l_orderkey") % BINS).alias("idx"),
        (F.col("l_discount") * 10).alias("overlap"),
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask overlaps above zero after rounding: (mask_type, cell_type, chrom, idx, overlap)."""
    m = mask_rows(spark, sf_dir).groupBy("mask_type", "supplier", "chrom", "idx").agg(rint_to(F.max("overlap"), 2).alias("overlap"))
    return m.filter("overlap <> 0").select("mask_type", F.concat(F.lit("supp"), F.col("supplier")).alias("cell_type"), "chrom", "idx", "overlap")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which masks exist, whether or not they have rows above zero."""
    return mask_rows(spark, sf_dir).select("mask_type", F.concat(F.lit("supp"), F.col("supplier")).alias("cell_type"), "chrom").distinct()


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that many cell types share: suppliers whose key is a multiple of 10, above zero."""
    m = mask_rows(spark, sf_dir).filter("supplier % 10 = 0").groupBy("mask_type", "chrom", "idx").agg(rint_to(F.max("overlap"), 2).alias("overlap"))
    return m.filter("overlap >= 0.8")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.concat(F.lit("ds"), F.col("vec_id") % 5).alias("dataset"),
        (F.col("label") % 2).cast("int").alias("y"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )
