"""Loaders of the array, sequence and index files of a sample's resources.

Files come through Spark's own readers (``binaryFile``, ``text``), a row or a range each; the small array
formats are taken apart in the tasks. Rows of a sparse vector that aren't stored are zeros.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import rint_to
from tessera.sources.arrays import mask_paths, mask_set_rows, read_rows


def _sparse_rows(content: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, places and values of a stored (n, 1) sparse array; other shapes are an error."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        kind = z["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        n, width = (int(x) for x in z["shape"])
        if width != 1 or n < 2:
            raise ValueError(f"a sparse vector of shape ({n}, {width}); (n, 1) with n > 1 is expected")
        if kind == "coo":
            return n, z["row"].astype(np.int64), z["data"].astype(float)
        if kind == "csc":
            return n, z["indices"].astype(np.int64), z["data"].astype(float)
        if kind == "csr":
            return n, np.repeat(np.arange(n), np.diff(z["indptr"])), z["data"].astype(float)
        raise ValueError(f"sparse arrays of format {kind} aren't known")


def read_sparse_vectors(spark: SparkSession, path: str | list[str], decimals: int | None = None, single: bool = False, chrom: str | None = None) -> DataFrame:
    """(path, group, chrom, idx, value) of all ``.npz`` sparse vectors below *path*, a task row a file.

    group is a file's folder, chrom its name. Entries stored twice add up; values are rounded to
    *decimals*, and as 32-bit floats with *single*; zeros are left out. What isn't there has no rows."""
    name = F.regexp_extract("path", r"([^/]+)\.npz$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz" if chrom is None else f"{chrom}.npz").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, at, v = _sparse_rows(content)
                idx, inverse = np.unique(at, return_inverse=True)
                v = np.bincount(inverse, v, len(idx)) if len(idx) else v
                for i in range(0, len(idx), 100_000):
                    part = idx[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(part)), pa.array(part), pa.array(v[i : i + 100_000])], ["path", "idx", "value"])

    rows = files.select("path", "content").mapInArrow(run, "path string, idx long, value double")
    if single:
        rows = rows.withColumn("value", F.col("value").cast("float").cast("double"))
    if decimals is not None:
        rows = rows.withColumn("value", rint_to(F.col("value"), decimals))
    return rows.filter("value <> 0").select("path", F.regexp_extract("path", r"([^/]+)/[^/]+\.npz$", 1).alias("group"), name.alias("chrom"), "idx", "value")


def read_masks(spark: SparkSession, folder: str, mask_type: str, cell_types: list[str] | None = None, chrom: str | None = None) -> DataFrame:
    """(mask_type, cell_type, chrom, idx, overlap) of ``folder/<cell type>/<chrom>.npz``, 32-bit floats rounded to
    2 decimals. Cell types without a file are skipped; files of others and of other chromosomes aren't opened."""
    paths = mask_paths(spark, folder, cell_types, None if chrom is None else [chrom])
    if not paths:
        return spark.createDataFrame([], "mask_type string, cell_type string, chrom string, idx long, overlap double")
    rows = read_sparse_vectors(spark, paths, 2, True)
    return rows.select(F.lit(mask_type).alias("mask_type"), F.col("group").alias("cell_type"), "chrom", "idx", F.col("value").alias("overlap"))


def read_mask_sets(spark: SparkSession, folder: str, mask_type: str, chrom: str | None = None) -> DataFrame:
    """(mask_type, cell_type, chrom, idx, overlap) of all files that :func:`tessera.sources.arrays.write_mask_sets` wrote to
    ``folder/<mask type>``, rounded as those of :func:`read_masks`; files of other chromosomes aren't opened."""
    one = f"{folder}/{mask_type}" + ("" if chrom is None else f"/{chrom}")
    sets = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.npz").option("recursiveFileLookup", "true").load(one)

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells, idx, v = mask_set_rows(content)
                for i in range(0, len(idx), 100_000):
                    part = idx[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(part)), cells.slice(i, len(part)), pa.array(part), pa.array(v[i : i + 100_000])], ["chrom", "cell_type", "idx", "value"])

    rows = sets.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.npz$", 1).alias("chrom"), "content").mapInArrow(run, "chrom string, cell_type string, idx long, value double")
    overlap = rint_to(F.col("value").cast("float").cast("double"), 2).alias("overlap")
    return rows.select(F.lit(mask_type).alias("mask_type"), "cell_type", "chrom", "idx", overlap).filter("overlap <> 0")


def gather(bins: DataFrame, vector: DataFrame, name: str) -> DataFrame:
    """*bins* with *name*, the vector's value at (chrom, idx), 0.0 where none is stored."""
    rows = vector.select("chrom", "idx", F.col("value").alias(name))
    return bins.join(rows, ["chrom", "idx"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def read_indices(spark: SparkSession, paths: list[str], skip_bad: bool = True) -> DataFrame:
    """(chrom, idx), each once, of ``.npz`` files with an array of bin numbers for each chromosome. A path that
    isn't there or can't be read is skipped, unless *skip_bad* is off."""
    schema, out = "chrom string, idx long", None

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        found = {k: z[k].astype(np.int64).ravel() for k in z.files}
                except Exception as e:
                    if not skip_bad:
                        raise ValueError(f"{where} has no bin numbers: {e}") from e
                    continue
                for chrom, idx in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(idx)), pa.array(idx)], ["chrom", "idx"])

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            if not skip_bad:
                raise FileNotFoundError(path)
            continue
        rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return out.distinct() if out is not None else spark.createDataFrame([], schema)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq) of a small FASTA file: names up to the first blank, lines joined, a row a sequence. See
    :mod:`tessera.sources.fasta` for files of any size."""
    # Only a > that begins a line begins a sequence; the first one has no newline before it.
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^\\s*>", "").alias("value")).filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^(\S+)", 1)
    return rows.select(head.alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def fasta_range(seqs: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(chrom, seq) of letters start to end (half-open, from 0) of one sequence."""
    return seqs.filter(F.col("chrom") == chrom).select("chrom", F.substring("seq", start + 1, max(0, end - start)).alias("seq"))


def read_panel(spark: SparkSession, folders: dict[str, str], panel: int = 0) -> DataFrame:
    """(dataset, row, features, and the columns of the metadata) of several cohorts.

    A folder has ``feature_dataset.npy``, an array (samples, panels, features) of which one panel is taken, a range of rows a task,
    and ``meta_data.csv`` with a row for each sample in the same order; unlike numbers are an error."""
    import pandas as pd

    def meta_rows(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                m = pd.read_csv(io.BytesIO(content), dtype=str)
                keep = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in m.to_dict("records")]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(keep)), pa.int64()), pa.array([list(r.items()) for r in keep], pa.map_(pa.string(), pa.string()))], ["row", "meta"])

    out = None
    for name, folder in folders.items():
        tensor = read_rows(spark, f"{folder}/feature_dataset.npy", panel)
        meta = spark.read.format("binaryFile").load(f"{folder}/meta_data.csv").select("content").mapInArrow(meta_rows, "row long, meta map<string,string>")
        lost = F.raise_error(F.lit(f"{name}: features and metadata have different numbers of rows"))
        rows = tensor.withColumn("x", F.lit(True)).join(meta.withColumn("y", F.lit(True)), "row", "full_outer")
        rows = rows.filter(F.when(F.col("x") & F.col("y"), True).otherwise(lost.cast("boolean"))).select(F.lit(name).alias("dataset"), "row", "features", "meta")
        out = rows if out is None else out.unionByName(rows)
    return out


def choose(spark: SparkSession, official: str | None, local: str | None, use_official: bool) -> str:
    """The path of the source that is asked for; it must have been given and be there. Nothing falls back."""
    path = official if use_official else local
    kind = "official" if use_official else "local"
    if not path:
        raise ValueError(f"the {kind} source is asked for but has no path")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"the {kind} source isn't there: {path}")
    return path
