"""Stage tables: Parquet in the folder that all executors share, a cut of lineage that outlives executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path to write to, in a fresh folder of the shared one that goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    files, path = _files(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of queries run inside go as soon as each query has ended."""
    before = spark.conf.get(_CLEAN, None)
    try:
        if before is not None:
            spark.conf.set(_CLEAN, "true")
        yield
    finally:
        if before is not None:
            spark.conf.set(_CLEAN, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a stage table that nothing reads any more."""
    for folder in {f.rsplit("/data/", 1)[0] for f in df.inputFiles()}:
        files, path = _files(df.sparkSession, folder)
        files.delete(path, True)
