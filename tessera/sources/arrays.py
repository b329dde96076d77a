"""Arrays in ``.npy`` files by ranges of rows, and sparse masks as a folder of ``.npz`` files.

An array's header gives its shape and type, so a task reads its rows' bytes alone. A mask's place in the folders gives its
cell type and chromosome, so files that aren't asked for are never opened.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.bam import open_at


def array_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and offset of the data of an open ``.npy`` file whose rows follow each other."""
    head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if by_column and len(shape) > 1:
        raise ValueError("the array is stored column by column; rows can't be read alone")
    return shape, kind, head.tell()


class Rows(InputPartition):
    """Rows start to stop of an array."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.panel = int(options.get("panel", 0))
        self.step = int(options.get("rangebytes", 32 << 20))

    def partitions(self) -> list[Rows]:
        files, path = open_at(self.path)
        with files.open_input_file(path) as f:
            shape, kind, _ = array_header(f)
        if len(shape) != 3 or not -shape[1] <= self.panel < shape[1]:
            raise ValueError(f"an array of shape {shape}; (samples, panels, features) with panel {self.panel} is expected")
        each = max(1, self.step // max(1, kind.itemsize * shape[1] * shape[2]))
        return [Rows(path, at, min(shape[0], at + each)) for at in range(0, shape[0], each)] or [Rows(path, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open_at(self.path)[0].open_input_file(partition.path) as f:
            (_, panels, width), kind, offset = array_header(f)
            each = panels * width * kind.itemsize
            batch = max(1, (4 << 20) // max(1, each))
            for at in range(partition.start, partition.stop, batch):
                n = min(batch, partition.stop - at)
                f.seek(offset + at * each)
                data = f.read(n * each)
                if len(data) != n * each:
                    raise ValueError(f"{partition.path} ends before row {at + n}")
                x = np.frombuffer(data, kind).reshape(n, panels, width)[:, self.panel].astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], ["row", "features"])


class ArrayRows(DataSource):
    """``spark.read.format("npy_rows").load(file)``: (row, features) of one panel of an array (samples, panels,
    features). Options: panel, rangeBytes (bytes of rows that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "row long, features array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)


def read_rows(spark: SparkSession, path: str, panel: int = 0, **options: str) -> DataFrame:
    spark.dataSource.register(ArrayRows)
    return spark.read.format("npy_rows").options(panel=str(panel), **options).load(path)


def mask_paths(spark: SparkSession, folder: str, cell_types: list[str] | None = None, chroms: list[str] | None = None) -> list[str]:
    """Files ``folder/<cell type>/<chrom>.npz`` of the wanted cell types and chromosomes that are there; folders are
    listed and no file is opened."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if cell_types is None:
        cells = [x.getPath() for x in files.listStatus(top) if x.isDirectory()]
    else:
        cells = [p for p in (hadoop.Path(top, c) for c in dict.fromkeys(cell_types)) if files.exists(p)]
    wanted = None if chroms is None else {f"{c}.npz" for c in chroms}
    found = (x.getPath() for cell in cells for x in files.listStatus(cell) if x.isFile())
    return sorted(p.toString() for p in found if (p.getName() in wanted if wanted is not None else p.getName().endswith(".npz")))


def write_masks(masks: DataFrame, folder: str, bins: int) -> int:
    """Write (mask_type, cell_type, chrom, idx, overlap) as ``folder/<mask type>/<cell type>/<chrom>.npz``, sparse columns of
    *bins* places each; the number of files. A mask of one chromosome is made in one task, as its file is. Each file gets
    its name when it is complete."""

    def run(table: pa.Table) -> pa.Table:
        kind, cell, chrom = (table[c][0].as_py() for c in ("mask_type", "cell_type", "chrom"))
        idx, v = table["idx"].to_numpy(), table["overlap"].to_numpy()
        order = np.argsort(idx, kind="stable")
        held = io.BytesIO()
        np.savez_compressed(held, format=np.array(b"csc"), shape=np.array([bins, 1]), indices=idx[order].astype(np.int32), indptr=np.array([0, len(idx)], np.int32), data=v[order])
        files, root = open_at(folder)
        files.create_dir(f"{root}/{kind}/{cell}")
        temp = f"{root}/{kind}/{cell}/_{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as f:
            f.write(held.getvalue())
        files.move(temp, f"{root}/{kind}/{cell}/{chrom}.npz")
        return pa.table({"n": pa.array([1], pa.int64())})

    return int(masks.groupBy("mask_type", "cell_type", "chrom").applyInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])


def write_mask_sets(masks: DataFrame, folder: str, bins: int, most: int = 500_000) -> dict[str, int]:
    """Write (mask_type, cell_type, chrom, idx, overlap) as files ``folder/<mask type>/<chrom>/part-*.npz``, each a sparse
    matrix of *bins* rows with a column for each of many cell types, and their names; the number of files by mask type.

    A cell type's rows are in one task, so files are some for a task, mask type and chromosome however many cell types
    there are. A file has about *most* entries; the column at its end may go on in the next. A task run again writes the
    same files, and each gets its name when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_at(folder)
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        now, size, n = None, 0, 0
        done: dict[str, int] = {}

        def flush() -> None:
            nonlocal size, n
            if held:
                kind, chrom = now
                table = pa.Table.from_batches(held)
                cells = table["cell_type"].combine_chunks().dictionary_encode()
                first = np.searchsorted(cells.indices.to_numpy(), np.arange(len(cells.dictionary) + 1))
                names = np.array([c.encode() for c in cells.dictionary.to_pylist()], object)
                out = io.BytesIO()
                np.savez_compressed(
                    out, format=np.array(b"csc"), shape=np.array([bins, len(names)]), indices=table["idx"].to_numpy(), indptr=first, data=table["overlap"].to_numpy(),
                    names=np.frombuffer(b"".join(names), np.uint8), name_ends=np.cumsum([len(c) for c in names]),
                )
                files.create_dir(f"{root}/{kind}/{chrom}")
                temp = f"{root}/{kind}/{chrom}/_{uuid.uuid4().hex}"
                with files.open_output_stream(temp) as f:
                    f.write(out.getvalue())
                files.move(temp, f"{root}/{kind}/{chrom}/part-{task:06d}-{n:06d}.npz")
                done[kind] = done.get(kind, 0) + 1
                held.clear()
                size, n = 0, n + 1

        for b in batches:
            codes = [b.column(k).dictionary_encode().indices.to_numpy() for k in (0, 1)]
            cuts = [0, *(np.flatnonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    key = (b.column(0)[lo].as_py(), b.column(1)[lo].as_py())
                    if key != now or size >= most:
                        flush()
                        now = key
                    held.append(b.slice(lo, hi - lo))
                    size += hi - lo
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.string()), pa.array(list(done.values()), pa.int64())], ["mask_type", "n"])

    order = ["mask_type", "chrom", "cell_type", "idx"]
    rows = masks.select(*order, F.col("overlap").cast("double").alias("overlap")).repartition("mask_type", "cell_type").sortWithinPartitions(*order)
    written = rows.mapInArrow(run, "mask_type string, n long").groupBy("mask_type").agg(F.sum("n").alias("n"))
    return {r["mask_type"]: r["n"] for r in written.collect()}


def mask_set_rows(content: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cell types, places and values of the entries of a file of :func:`write_mask_sets`."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        ends, first = z["name_ends"].astype(np.int64), z["indptr"].astype(np.int64)
        names = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends)), pa.py_buffer(z["names"]))
        cells = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(ends)), np.diff(first))), names.cast(pa.string()))
        return pc.cast(cells, pa.string()), z["indices"].astype(np.int64), z["data"].astype(float)
