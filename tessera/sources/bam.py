"""Aligned reads in BAM files: a data source that reads regions through the files' indexes, and a writer.

A path is a file or a folder of files ``*.bam``, each with its index ``*.bam.bai``. Partitions are ranges of virtual
offsets (place of a compressed block, place within it) that the index gives as starts of records. Filters on chrom,
start and end reach the reader, which then reads only the blocks that the binning index names for the region, from the
linear index's offset on. Blocks are decoded in arrays. Files are opened through pyarrow in the tasks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "chrom string, start long, end long, mapq int, flag int, proper_pair boolean, is_read1 boolean, tlen long"
# Fixed values of the format: the empty block at a file's end, the linear index's step, the largest place the
# binning index covers, the first bin of each of its levels with the bits of a bin's width, the number of bins (one
# more holds statistics), the bytes of a full block, and which CIGAR operations (MIDNSHP=X) take letters of the reference.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LINEAR, LARGEST, FULL = 14, 1 << 29, 65_280
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26), (0, 29))
ALL_BINS = 37450
ON_REFERENCE = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0], np.int64)
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("cigar", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])


def open_at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[6:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def bin_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds [start, end)."""
    out, done = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    for first, bits in LEVELS:
        here = ~done & (start >> bits == (end - 1) >> bits)
        out[here] = first + (start[here] >> bits)
        done |= here
    return out


def bins_over(start: int, end: int) -> list[range]:
    """Ranges of the bins that can hold something of [start, end), one a level."""
    return [range(first + (start >> bits), first + ((end - 1) >> bits) + 1) for first, bits in LEVELS]


# Blocks


def block_size(head: bytes | memoryview) -> int:
    """Bytes of the compressed block that begins with *head*."""
    if bytes(head[:4]) != b"\x1f\x8b\x08\x04":
        raise ValueError("no block begins here")
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at < 12 + extra:
        tag, n = bytes(head[at : at + 2]), struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC":
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("a block without its size")


def inflate(block: memoryview) -> bytes:
    (extra,) = struct.unpack_from("<H", block, 10)
    crc, size = struct.unpack_from("<2I", block, len(block) - 8)
    data = zlib.decompress(block[12 + extra : -8], -15, size or 1)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("a block's check sum differs")
    return data


class Blocks:
    """Inflated blocks of an open file, one after the other, in reads of *step* bytes. ``read`` counts the bytes."""

    def __init__(self, f, at: int, step: int = 1 << 20):
        self.f, self.at, self.step, self.data, self.read = f, at, step, memoryview(b""), 0

    def _have(self, n: int) -> bool:
        if len(self.data) < n:
            self.f.seek(self.at + len(self.data))
            more = self.f.read(max(self.step, n - len(self.data)))
            self.read += len(more)
            self.data = memoryview(bytes(self.data) + more)
        return len(self.data) >= n

    def next(self) -> tuple[int, bytes] | None:
        """(place, contents) of the next block; None at the end of the file."""
        if not self._have(18):
            return None
        n = block_size(self.data)
        if not self._have(n):
            raise ValueError(f"the block at {self.at} is cut off")
        place, out = self.at, inflate(self.data[:n])
        self.data, self.at = self.data[n:], self.at + n
        return place, out


def read_header(f) -> tuple[list[str], list[int], int]:
    """Names and lengths of the references, and the virtual offset of the first record."""
    blocks, data, starts = Blocks(f, 0, 1 << 16), bytearray(), []

    def need(n: int) -> None:
        while len(data) < n:
            got = blocks.next()
            if got is None:
                raise ValueError("the header is cut off")
            starts.append((len(data), got[0], blocks.at))
            data.extend(got[1])

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("no BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    names, lengths = [], []
    for _ in range(n_ref):
        need(at + 4)
        (n,) = struct.unpack_from("<i", data, at)
        need(at + 8 + n)
        names.append(data[at + 4 : at + 3 + n].decode())
        lengths.append(struct.unpack_from("<i", data, at + 4 + n)[0])
        at += 8 + n
    if at == len(data):
        return names, lengths, blocks.at << 16
    first, place, _ = next(s for s in reversed(starts) if s[0] <= at)
    return names, lengths, place << 16 | (at - first)


# Index


class Index:
    """A file's index: for each reference its bins' chunks (begin, end) and its linear offsets."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\x01":
            raise ValueError("no index")
        (n_ref,) = struct.unpack_from("<i", data, 4)
        at, self.bins, self.linear = 8, [], []
        for _ in range(n_ref):
            (n_bin,) = struct.unpack_from("<i", data, at)
            at += 4
            bins = {}
            for _ in range(n_bin):
                number, n = struct.unpack_from("<Ii", data, at)
                if number < ALL_BINS:
                    bins[number] = np.frombuffer(data, "<u8", 2 * n, at + 8).reshape(-1, 2)
                at += 8 + 16 * n
            (n,) = struct.unpack_from("<i", data, at)
            self.bins.append(bins)
            self.linear.append(np.frombuffer(data, "<u8", n, at + 4))
            at += 4 + 8 * n

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Merged ranges of virtual offsets that hold all records of [start, end), and maybe others."""
        bins, linear = self.bins[ref], self.linear[ref]
        least = int(linear[min(start >> LINEAR, len(linear) - 1)]) if len(linear) else 0
        wanted = bins_over(start, end)
        found = [c for number, of in bins.items() if any(number in w for w in wanted) for c in of.tolist() if c[1] > least]
        out: list[tuple[int, int]] = []
        for a, b in sorted((max(a, least), b) for a, b in found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def starts(self, ref: int) -> list[int]:
        """Virtual offsets at which a record is known to begin."""
        return sorted({int(c) for of in self.bins[ref].values() for c in of[:, 0]} | {int(x) for x in self.linear[ref] if x})


def split_chunks(chunks: list[tuple[int, int]], starts: list[int], step: int) -> list[list[tuple[int, int]]]:
    """*chunks* in groups of about *step* compressed bytes, cut at *starts*."""
    cuts, parts = np.array(starts, np.int64), []
    for a, b in chunks:
        inner = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b)].tolist()
        last = a
        for c in inner:
            if (c >> 16) - (last >> 16) >= step:
                parts.append((last, c))
                last = c
        parts.append((last, b))
    out: list[list[tuple[int, int]]] = []
    held = step
    for a, b in parts:
        if held >= step:
            out.append([])
            held = 0
        out[-1].append((a, b))
        held += (b >> 16) - (a >> 16) + 1
    return out


# Records


def record_starts(data: bytes, stop: int) -> tuple[list[int], int]:
    """Places of the whole records that begin before *stop*, and where the first of the others begins."""
    out, at, n, size = [], 0, len(data), struct.Struct("<i").unpack_from
    while at < stop and at + 4 <= n:
        end = at + 4 + size(data, at)[0]
        if end > n:
            break
        out.append(at)
        at = end
    return out, at


def decode(data: bytes, starts: list[int]) -> dict[str, np.ndarray]:
    """Arrays of the records at *starts*. A read without alignment has end -1."""
    raw, at = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
    rows = raw[at[:, None] + np.arange(FIXED.itemsize)].copy().view(FIXED).ravel()
    n = rows["cigar"].astype(np.int64)
    length, some = np.zeros(len(at), np.int64), np.flatnonzero(n)
    if len(some):
        first = np.cumsum(n[some]) - n[some]
        place = np.repeat(at[some] + FIXED.itemsize + rows["name"][some] - 4 * first, n[some]) + 4 * np.arange(n.sum())
        ops = raw[place[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64)
        length[some] = np.add.reduceat((ops >> 4) * ON_REFERENCE[ops & 15], first)
    start = rows["pos"].astype(np.int64)
    end = np.where((rows["flag"] & 4 == 0) & (n > 0), start + length, -1)
    return {"ref": rows["ref"], "start": start, "end": end, "mapq": rows["mapq"].astype(np.int32), "flag": rows["flag"].astype(np.int32), "tlen": rows["tlen"].astype(np.int64)}


class Chunks(InputPartition):
    """Ranges of virtual offsets of one file."""

    def __init__(self, path: str, chunks: list[tuple[int, int]], names: list[str]):
        self.path, self.chunks, self.names = path, chunks, names


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.step = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.chrom: str | None = None
        self.low, self.high = 0, LARGEST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """A chromosome, an upper bound of start and a lower bound of end narrow what is read; Spark applies all
        filters again, as blocks hold other reads too."""
        for f in filters:
            name, v = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == "chrom":
                self.chrom = v
            elif name == "start" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, v + isinstance(f, LessThanOrEqual))
            elif name == "end" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, v - isinstance(f, GreaterThanOrEqual))
            yield f

    def partitions(self) -> list[Chunks]:
        files, root = open_at(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root))
        out = []
        for x in sorted((x for x in found if x.path.endswith(".bam") and not x.base_name.startswith("_")), key=lambda x: x.path):
            with files.open_input_file(x.path) as f:
                names, _, first = read_header(f)
            if self.chrom is not None and self.chrom not in names or self.low >= self.high:
                continue
            with files.open_input_stream(x.path + ".bai") as f:
                index = Index(f.read())
            last = first
            for ref in range(len(names)) if self.chrom is None else [names.index(self.chrom)]:
                chunks = index.chunks(ref, self.low, self.high)
                out += [Chunks(x.path, part, names) for part in split_chunks(chunks, index.starts(ref), self.step)]
                last = max([last, *(b for _, b in chunks)])
            if self.chrom is None and (self.low, self.high) == (0, LARGEST):
                out.append(Chunks(x.path, [(last, x.size << 16)], names))  # reads without a place come last
        return out or [Chunks("", [], [])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open_at(self.path)[0].open_input_file(partition.path) as f:
            for begin, end in partition.chunks:
                for data, starts in self.records(f, begin, end):
                    yield self.out(decode(data, starts), partition.names)

    def records(self, f, begin: int, end: int) -> Iterator[tuple[bytes, list[int]]]:
        """(bytes, places of records) of the records that begin in [begin, end), about a batch at a time."""
        first, last = begin >> 16, end >> 16
        blocks, held, marks, skip = Blocks(f, first, min(1 << 20, last - first + (1 << 16))), b"", [], begin & 0xFFFF
        while True:
            got = blocks.next()
            if got is not None:
                place, data = got
                marks.append((len(held) - skip, place))  # where the block's first byte would be
                held, skip = held + data[skip:], 0
            passed = got is None or blocks.at >= last + (end & 0xFFFF > 0)
            if not passed and len(held) < self.batch:
                continue
            # Records that begin from *end* on belong to others.
            stop = next((m + (end & 0xFFFF if p == last else 0) for m, p in marks if p >= last), len(held))
            starts, at = record_starts(held, stop)
            if starts:
                yield held, starts
            if passed and at >= stop:
                return
            if got is None:
                raise ValueError(f"a record is cut off before {end:#x}")
            held, marks = held[at:], [(m - at, p) for m, p in marks]

    @staticmethod
    def out(x: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
        ref = pa.array(x["ref"], mask=x["ref"] < 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()).take(ref), pa.array(x["start"]), pa.array(x["end"], mask=x["end"] < 0), pa.array(x["mapq"]), pa.array(x["flag"]),
                pa.array(x["flag"] & 2 != 0), pa.array(x["flag"] & 64 != 0), pa.array(x["tlen"]),
            ],
            ["chrom", "start", "end", "mapq", "flag", "proper_pair", "is_read1", "tlen"],
        )


class BamFiles(DataSource):
    """``spark.read.format("bam").load(path)``. Options: rangeBytes (compressed bytes a task reads), batchBytes
    (inflated bytes of a record batch). Filters reach it where spark.sql.python.filterPushdown.enabled is on."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, **options: str) -> DataFrame:
    """Reads of BAM files that touch [start, end) of *chrom*; without limits all reads, those without a place too.

    start and end are 0-based and half-open; end is null for reads that aren't aligned. A filter by the caller on
    these columns narrows what is read in the same way. Secondary and duplicate reads are kept."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamFiles)
    rows = spark.read.format("bam").options(**options).load(path)
    rows = rows if chrom is None else rows.filter(F.col("chrom") == chrom)
    rows = rows if end is None else rows.filter(F.col("start") < end)
    return rows if start is None else rows.filter(F.col("end") > start)


# Writing


class _Writer:
    """A sorted BAM file and its index; records come in batches of arrays."""

    def __init__(self, out, names: list[str], lengths: list[int], level: int = 6):
        self.f, self.level, self.at, self.held = out, level, 0, bytearray()
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in zip(names, lengths, strict=True))
        self.held += b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(names))
        for n, x in zip(names, lengths, strict=True):
            self.held += struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", x)
        self.flush()
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in names]
        self.linear: list[dict[int, int]] = [{} for _ in names]

    def flush(self) -> None:
        """What is held becomes a block (a long header: several)."""
        for i in range(0, len(self.held), FULL):
            part = bytes(self.held[i : i + FULL])
            z = zlib.compressobj(self.level, zlib.DEFLATED, -15)
            data = z.compress(part) + z.flush()
            head = struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(data) + 25)
            self.f.write(head + data + struct.pack("<2I", zlib.crc32(part), len(part)))
            self.at += len(data) + 26
        self.held = bytearray()

    def add(self, ref: np.ndarray, start: np.ndarray, end: np.ndarray, mapq: np.ndarray, flag: np.ndarray, tlen: np.ndarray) -> None:
        """Records in the order of the file. end < 0: not aligned; ref < 0: without a place."""
        mapped = end >= 0
        stop = np.where(mapped & (end > start), end, start + 1)
        bins = bin_of(np.maximum(start, 0), np.maximum(stop, 1))
        for r, s, e, q, fl, t, m, b, x in zip(*(v.tolist() for v in (ref, start, end, mapq, flag, tlen, mapped, bins, stop)), strict=True):
            cigar = struct.pack("<I", (e - s) << 4) if m else b""
            fixed = struct.pack("<iiBBHHHiiii", r, s, 2, q, b if r >= 0 else 4680, len(cigar) // 4, fl if m else fl | 4, 0, -1, -1, t)
            record = struct.pack("<i", len(fixed) + 2 + len(cigar)) + fixed + b"*\0" + cigar
            if len(self.held) + len(record) > FULL:
                self.flush()
            begin = self.at << 16 | len(self.held)
            self.held += record
            if r < 0:
                continue
            chunks = self.bins[r].setdefault(b, [])
            after = self.at << 16 | len(self.held)
            if chunks and chunks[-1][1] >> 16 == begin >> 16:
                chunks[-1][1] = after
            else:
                chunks.append([begin, after])
            for k in range(s >> LINEAR, ((x - 1) >> LINEAR) + 1):
                self.linear[r].setdefault(k, begin)

    def close(self) -> bytes:
        """End the file; the index."""
        if self.held:
            self.flush()
        self.f.write(EOF_BLOCK)
        out = bytearray(b"BAI\x01" + struct.pack("<i", len(self.bins)))
        for bins, linear in zip(self.bins, self.linear, strict=True):
            out += struct.pack("<i", len(bins))
            for number, chunks in sorted(bins.items()):
                out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks)
            n, last = max(linear, default=-1) + 1, 0
            out += struct.pack("<i", n)
            for k in range(n):
                last = linear.get(k, last)
                out += struct.pack("<Q", last)
        return bytes(out)


def write_bam(reads: DataFrame, path: str, lengths: dict[str, int] | None = None) -> int:
    """Write (chrom, start, end, mapq, proper_pair, is_read1, tlen) as BAM files with indexes, a range of places each; the
    number of reads. Alignments are one match from start to end; a null end is a read that isn't aligned. *lengths* are
    those of the references (by default the largest end of each); a null or unknown chrom is a read without a place.

    A task writes to a name of its own and moves the file in place at the end, so that one run again does no harm."""
    spark = reads.sparkSession
    if lengths is None:
        ends = reads.filter("chrom IS NOT NULL").groupBy("chrom").agg(F.max(F.greatest(F.coalesce("end", F.lit(0)), F.col("start") + 1)).alias("n"))
        lengths = {r["chrom"]: int(r["n"]) for r in ends.collect()}
    names = sorted(lengths)
    number = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("chrom")) - 1 if names else F.lit(-1)
    flag = F.when(F.col("proper_pair"), 3).otherwise(1) + F.when(F.col("is_read1"), 64).otherwise(128)
    long = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none))
    ref = F.when(F.col("start") >= 0, F.coalesce(number, F.lit(-1))).otherwise(-1).cast("int").alias("ref")
    rows = reads.select(ref, long("start", -1).alias("start"), long("end", -1).alias("end"), F.coalesce(F.col("mapq").cast("int"), F.lit(255)).alias("mapq"), flag.alias("flag"), F.round(F.coalesce("tlen", F.lit(0))).cast("long").alias("tlen"))
    # Reads without a place come last.
    by = [(F.col("ref") < 0).asc(), F.col("ref").asc(), F.col("start").asc(), F.col("end").asc(), F.xxhash64("mapq", "flag", "tlen").asc()]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    sizes = [lengths[n] for n in names]
    made, root_ = open_at(path)
    made.create_dir(root_)  # a table without rows is a folder without files

    def run(batches):
        files, root = open_at(path)
        part, n = TaskContext.get().partitionId(), 0
        temp = f"{root}/_{part}-{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as f:
            w = _Writer(f, names, sizes)
            for b in batches:
                w.add(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
                n += b.num_rows
            index = w.close()
        if n:
            final = f"{root}/part-{part:06d}.bam"
            with files.open_output_stream(final + ".bai") as f:
                f.write(index)
            files.move(temp, final)
        else:
            files.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return int(rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
