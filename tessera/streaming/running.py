"""Running sums and count models over streams: states that merge by adding and outlive a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.correlate import dense_sums
from tessera.operators.outliers import counted
from tessera.sources.stage import new_path


def running_sums(stream: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The six sums of a correlation so far, by key, as rows arrive."""
    return dense_sums(stream, by, x, y)


def run_to_end(result: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of sums over what is there now, in complete mode; the last state of each key. States are
    kept in *checkpoint* (a fresh place of the shared folder), and each batch's table is written there by
    the executors; nothing comes to the driver."""
    spark = result.sparkSession
    out = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = result.writeStream.outputMode("complete").foreachBatch(write).trigger(availableNow=True)
    q = q.option("checkpointLocation", checkpoint or new_path(spark, f"{name}-state")).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


class CountModels:
    """Parameters (n, mu, nonzero) of a count model for each key, as :func:`tessera.operators.outliers.zip_stats` has them, over
    all rows that streams have brought so far.

    Spark's state store keeps the sums in *checkpoint*; each micro-batch writes the keys it changed to a folder of its own
    below *path*, so a batch that is run again after a failure replaces what it wrote. With the same two places a new run,
    or a new process, goes on where the last one stopped."""

    def __init__(self, path: str, checkpoint: str, by: tuple[str, ...] = ("chrom",), col: str = "cov"):
        self.path, self.checkpoint, self.by, self.col = path, checkpoint, list(by), col

    def update(self, stream: DataFrame) -> None:
        """Take in what the stream has now, and stop."""
        v = counted(self.col)
        sums = stream.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.count_if(v != 0).alias("nonzero"))

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{number:09d}")

        q = sums.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", self.checkpoint).start()
        q.awaitTermination()

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(by, n, mu, nonzero) after the last batch."""
        rows = spark.read.parquet(f"{self.path}/*")
        last = rows.groupBy(*self.by).agg(F.max_by(F.struct("n", "total", "nonzero"), "batch").alias("s"))
        return last.select(*self.by, "s.n", (F.col("s.total") / F.col("s.n")).alias("mu"), "s.nonzero")
