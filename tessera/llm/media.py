"""Media columns: archives of 8-bit images, and a data source that reads them by byte range."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.llm.store import new_path

WIDTH = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes (null: none) with zero bytes up to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes((-len(raw)) % WIDTH if raw else WIDTH), len(raw)


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes, n_bytes: int) -> bytes:
    """A lossless 8-bit grey PNG, 64 samples a row; the unpadded length is a text note in it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _part(b"IHDR", head) + _part(b"tEXt", b"n_bytes\0%d" % n_bytes) + _part(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _part(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """The payload and unpadded length of :func:`to_image`'s result; ValueError if any part is damaged."""
    if image[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, n, height = 8, b"", -1, 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a part's check sum differs")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"tEXt":
            n = int(body.rpartition(b"\0")[2])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes(), n


def feature_of(payload: bytes) -> str:
    """Height, mean, deviation and entropy (bits) of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    mean = float(share @ np.arange(256))
    dev = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    return f"{len(x) // WIDTH}x{WIDTH} mean={mean:.4f} std={dev:.4f} entropy={float(-(some * np.log2(some)).sum()):.4f}"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else "file://" + path)


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Store every text as an image, one ZIP archive (members stored, directory at the end) per task.

    An archive gets its final name, that of the task's partition, once it is complete; a task run again
    writes the same archive. The number of documents is returned.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        files, root = _at(path)
        files.create_dir(root)
        part = TaskContext.get().partitionId()
        temp, n = f"{root}/_{part}-{uuid.uuid4().hex}", 0
        with files.open_output_stream(temp) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    member = zipfile.ZipInfo(f"{n}/{'' if i is None else i}.png")
                    z.writestr(member, to_image(*payload_of(t)))
                    n += 1
        if n:
            files.move(temp, f"{root}/part-{part:06d}.zip")
        else:
            files.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"ids of type {kind} can't be member names")
    done = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return int(done.head()["n"])


class Range(InputPartition):
    """Members of an archive whose headers begin in [start, stop)."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.step = int(options.get("rangebytes", 32 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[Range]:
        """Byte ranges over the archives' sizes; the archives themselves aren't opened here."""
        files, root = _at(self.path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [
            Range(x.path, at, min(x.size, at + self.step))
            for x in sorted(found, key=lambda x: x.path)
            if x.path.endswith(".zip")
            for at in range(0, x.size, self.step)
        ] or [Range("", 0, 0)]

    @staticmethod
    def parse(data: bytes, info: zipfile.ZipInfo) -> tuple[bytes, bytes, int]:
        """Image, payload and length of the member whose local header *data* begins with."""
        if data[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack_from("<HH", data, 26)
        image = bytes(data[30 + name + extra : 30 + name + extra + info.compress_size])
        if zlib.crc32(image) != info.CRC:
            raise ValueError("the member's check sum differs")
        return image, *from_image(image)

    def member(self, files: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple[bytes, bytes, int]:
        """The member at its offset, read alone; each try opens the archive again."""
        for k in range(self.tries):
            try:
                with files.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    return self.parse(f.read(self.most(info)), info)
            except (OSError, ValueError, struct.error, zlib.error) as e:
                if k + 1 == self.tries:
                    raise OSError(f"{path} at {info.header_offset}, {self.tries} tries: {e}") from e
        raise AssertionError

    @staticmethod
    def most(info: zipfile.ZipInfo) -> int:
        """Bytes that a member and its local header take at most."""
        return 30 + len(info.filename.encode()) + len(info.extra) + 64 + info.compress_size

    def stream(self, f, files: pafs.FileSystem, path: str, members: list[zipfile.ZipInfo]):
        """Members in the order of their offsets. They follow each other, so a read of the open archive takes as
        many as fit into a batch; one that can't be had from it is read again alone."""
        i = 0
        while i < len(members):
            lo, j = members[i].header_offset, i + 1
            while j < len(members) and members[j].header_offset + self.most(members[j]) - lo <= self.batch:
                j += 1
            try:
                f.seek(lo)
                data = memoryview(f.read(members[j - 1].header_offset + self.most(members[j - 1]) - lo))
            except OSError:
                data = memoryview(b"")
            for m in members[i:j]:
                try:
                    yield m, *self.parse(data[m.header_offset - lo :], m)
                except (ValueError, struct.error, zlib.error):
                    yield m, *self.member(files, path, m)
            i = j

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, rows, held = _at(self.path)[0], [], 0
        with files.open_input_file(partition.path) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.stop]
            for m, image, payload, n in self.stream(f, files, partition.path, sorted(members, key=lambda m: m.header_offset)):
                rows.append((m.filename.rpartition("/")[2].removesuffix(".png") or None, partition.path.rpartition("/")[2], m.header_offset, n, image, payload, feature_of(payload)))
                held += len(image) + len(payload)
                if held >= self.batch:
                    yield self.out(rows)
                    rows, held = [], 0
        if rows:
            yield self.out(rows)

    @staticmethod
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["id", "archive", "offset", "n_bytes", "media", "payload", "feature"],
        )


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: a row for each archive member.

    Options: rangeBytes (bytes of an archive that a task reads), batchBytes (bytes of a record batch),
    tries (reads of a member, each at its own offset, before the task fails)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "id string, archive string, offset long, n_bytes long, media binary, payload binary, feature string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of *docs*, from archives written and read back: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.

    A null or empty text is 64 zero bytes. Equal texts give equal values. A null id stays null. Rows that
    repeat an id are members of their own. An empty table gives no rows. A text, however long, is one member
    and passes through one task in memory; other columns are ignored.
    """
    path = new_path(docs.sparkSession, "media")
    write_archives(docs, path, id_col, text_col)
    return read_archives(docs.sparkSession, path).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
