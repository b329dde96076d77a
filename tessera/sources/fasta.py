"""Sequences in FASTA files, read by ranges of letters.

A file has an index beside it (``.fai``: name, letters, offset of the first letter, letters and bytes of a line), made by
:func:`index_fasta` where it is missing: tasks scan byte ranges, and only a row for each sequence and range is put
together. With the index, letter ranges are byte ranges; no row or task ever holds a whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessera.sources.bam import open_at

FIELDS = ["first", "name", "offset", "letters", "bases", "width", "begin", "end", "break", "gap"]
SCHEMA = "chrom string, start long, end long, seq string, length long"


class Entry(NamedTuple):
    """A line of the index."""

    name: str
    length: int
    offset: int
    bases: int
    width: int

    def place(self, letter: int) -> int:
        """Byte of a letter; for the letter after the last, the byte after the last."""
        if not self.bases:
            return self.offset
        line, at = divmod(letter, self.bases)
        if letter == self.length and letter and not at:
            line, at = line - 1, self.bases
        return self.offset + line * self.width + at


def read_index(text: str) -> list[Entry]:
    rows = (line.split("\t") for line in text.splitlines() if line)
    return [Entry(r[0], *map(int, r[1:5])) for r in rows]


# Making an index


def scan(f, start: int, stop: int, size: int, step: int = 1 << 20, head: int = 1 << 16) -> list[tuple]:
    """(first byte, name, offset, letters, bases, width, begin, end, break, gap) of each sequence whose header line begins in
    [start, stop), for its letters before *stop*; before them, with a null name, what belongs to a sequence begun earlier.
    begin is the byte of the first letter, end the one after the last; break the first line break between them (or -1) and
    gap the distance of those (0: one at most, -1: unequal). bases and width are of the first line, to its end even
    beyond *stop*. Header lines have at most *head* bytes."""

    def at(lo: int, hi: int) -> bytes:
        f.seek(lo)
        return f.read(hi - lo)

    def line_end(lo: int) -> int:
        """The byte after the newline that comes next."""
        for k in range(lo, size, step):
            found = at(k, min(size, k + step)).find(b"\n")
            if found >= 0:
                return k + found + 1
        return size

    before = b"\n" + at(0, start) if start < head else at(start - head, start)
    line = before.rfind(b"\n") + 1
    inside = before[line : line + 1] == b">"  # the range begins in a header line
    parts: list[tuple] = [(start, None, line_end(start) if inside else start, 0, 0)]
    last = before[-1:]
    for k in range(start, stop, step):
        data = last + at(k, min(stop, k + step))
        found = data.find(b"\n>")
        while found >= 0:
            first = k + found
            body = line_end(first)
            name = (at(first + 1, body).split() or [b""])[0].decode()
            end = line_end(body)
            if at(body, body + 1) == b">":
                end = body
            tail = at(max(body, end - 2), end)
            parts.append((first, name, body, end - body - len(tail) + len(tail.rstrip(b"\r\n")), end - body))
            found = data.find(b"\n>", found + 1)
        last = data[-1:]
    out = []
    for (first, name, body, bases, width), after in zip(parts, [*(p[0] for p in parts[1:]), stop], strict=True):
        letters, begin, end, breaks = 0, body, body, [np.zeros(0, np.int64)]
        for k in range(body, after, step):
            data = at(k, min(after, k + step))
            if n := len(data.translate(None, b" \t\r\n")):
                begin = begin if letters else k + len(data) - len(data.lstrip(b" \t\r\n"))
                letters += n
                end = k + len(data.rstrip(b" \t\r\n"))
            breaks.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + k)
        inner = np.concatenate(breaks)
        inner = inner[(inner > begin) & (inner < end)]
        gaps = np.unique(np.diff(inner))
        out.append((first, name, body, letters, bases, width if bases else 0, begin, end, int(inner[0]) if len(inner) else -1, 0 if not len(gaps) else int(gaps[0]) if len(gaps) == 1 else -1))
    return out


def merge(segments: list[tuple]) -> list[Entry]:
    """Entries of the index from the segments of all ranges of a file. Sequences whose lines differ in length (but for
    the last) can't be indexed and are an error."""
    found: list[list[tuple]] = []
    for x in sorted(segments, key=lambda s: (s[0], s[1] is not None)):
        if x[1] is not None:
            found.append([x])
        elif x[3]:
            if not found:
                raise ValueError("letters before the first header")
            found[-1].append(x)
    entries = []
    for parts in found:
        _, name, offset, _, bases, width, *_ = parts[0]
        e = Entry(name, sum(x[3] for x in parts), offset, bases, width)
        before, fits = 0, e.length <= e.bases or e.width > e.bases
        for _, _, _, letters, _, _, begin, end, first, gap in parts:
            # Where a range's letters begin and end, and its line breaks between, are where the index puts them.
            fits &= not letters or e.place(before) == begin and e.place(before + letters - 1) == end - 1
            fits &= first < 0 or (first + 1 - offset) % max(1, width) == 0 and gap in (0, width)
            before += letters
        if not fits:
            raise ValueError(f"sequence {e.name} has lines of unlike length")
        entries.append(e)
    return entries


def index_fasta(spark: SparkSession, path: str, step: int = 32 << 20) -> int:
    """Write ``.fai`` files beside a FASTA file, or all such files (.fa, .fasta, .fna, .txt) of a folder, that have none; their
    number. A task scans *step* bytes; a row for each sequence and range comes to the driver, as the index does anyway."""
    files, _ = open_at(path)
    todo = [x for x in fasta_files(path) if files.get_file_info(x.path + ".fai").type == pafs.FileType.NotFound]
    ranges = [(k, at, min(at + step, x.size), x.size) for k, x in enumerate(todo) for at in range(0, x.size, step)]
    names = [x.path for x in todo]

    def run(batches):
        for b in batches:
            for k, start, stop, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open_at(path)[0].open_input_file(names[k]) as f:
                    rows = scan(f, start, stop, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.string() if i == 1 else pa.int64()) for i in range(10))],
                    ["file", *FIELDS],
                )

    found: dict[int, list[tuple]] = {}
    if ranges:
        df = spark.createDataFrame(ranges, "file long, start long, stop long, size long").repartition(min(len(ranges), 10_000))
        for r in df.mapInArrow(run, "file long, " + ", ".join(f"`{c}` {'string' if c == 'name' else 'long'}" for c in FIELDS)).collect():
            found.setdefault(r["file"], []).append(tuple(r)[1:])
    for k, x in enumerate(todo):
        entries = merge(found.get(k, []))
        with files.open_output_stream(x.path + ".fai") as out:
            out.write("".join("\t".join(map(str, e)) + "\n" for e in entries).encode())
    return len(todo)


def fasta_files(path: str) -> list[pafs.FileInfo]:
    files, root = open_at(path)
    info = files.get_file_info(root)
    found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root))
    return sorted((x for x in found if x.path == root or x.path.endswith((".fa", ".fasta", ".fna", ".txt"))), key=lambda x: x.path)


# Reading


class Letters(InputPartition):
    """Letter ranges (entry, start, end) of one file."""

    def __init__(self, path: str, ranges: list[tuple[Entry, int, int]]):
        self.path, self.ranges = path, ranges


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.step = int(options.get("rangeletters", 16 << 20))
        self.chunk = int(options.get("chunkletters", 1 << 16))
        self.chrom: str | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """A name, an upper bound of start and a lower bound of end narrow what is read; Spark applies them again."""
        for f in filters:
            name, v = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == "chrom":
                self.chrom = v
            elif name == "start" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, v + isinstance(f, LessThanOrEqual))
            elif name == "end" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, v - isinstance(f, GreaterThanOrEqual))
            yield f

    def partitions(self) -> list[Letters]:
        """Chunks that begin before the upper and end after the lower bound, in ranges of about *step* letters.
        Chunks begin at multiples of their size, so a row is the same whatever is asked for."""
        files, out = open_at(self.path)[0], []
        for x in fasta_files(self.path):
            with files.open_input_stream(x.path + ".fai") as f:
                entries = read_index(f.read().decode())
            held, size = [], 0
            for e in entries:
                if self.chrom not in (None, e.name):
                    continue
                at = self.low // self.chunk * self.chunk
                stop = min(e.length, -(-self.high // self.chunk) * self.chunk)
                while at < stop or e.length == 0 == at:
                    end = min(stop, at + max(self.chunk, self.step // self.chunk * self.chunk))
                    held.append((e, at, end))
                    size += end - at + 100
                    if size >= self.step:
                        out.append(Letters(x.path, held))
                        held, size = [], 0
                    if end == at:
                        break
                    at = end
            if held:
                out.append(Letters(x.path, held))
        return out or [Letters("", [])]

    def read(self, partition: Letters) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, held = [], 0
        with open_at(self.path)[0].open_input_file(partition.path) as f:
            for e, start, end in partition.ranges:
                for at in range(start, max(end, start + 1), self.chunk):
                    stop = min(end, at + self.chunk)
                    lo = e.place(at)
                    f.seek(lo)
                    seq = f.read(e.place(stop) - lo).translate(None, b"\r\n").decode("latin-1")
                    if len(seq) != stop - at:
                        raise ValueError(f"{partition.path}: the index doesn't fit at {e.name}:{at}")
                    rows.append((e.name, at, stop, seq, e.length))
                    held += stop - at + 100
                    if held >= 4 << 20:
                        yield self.out(rows)
                        rows, held = [], 0
        if rows:
            yield self.out(rows)

    @staticmethod
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chrom", "start", "end", "seq", "length"])


class FastaFiles(DataSource):
    """``spark.read.format("fasta").load(path)``: rows of chunks. Options: chunkLetters (of a row), rangeLetters (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def read_sequences(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, **options: str) -> DataFrame:
    """(chrom, start, end, seq, length): the letters of a FASTA file or folder with indexes, in chunks, cut to
    [start, end); length is that of the whole sequence. An empty sequence is one empty chunk."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaFiles)
    rows = spark.read.format("fasta").options(**options).load(path)
    rows = rows if chrom is None else rows.filter(F.col("chrom") == chrom)
    if start is None and end is None:
        return rows
    lo, hi = start or 0, (1 << 62) if end is None else end
    rows = rows.filter((F.col("start") < hi) & (F.col("end") > lo))
    first, last = F.greatest(F.col("start"), F.lit(lo)), F.least(F.col("end"), F.lit(hi))
    seq = F.substring("seq", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    return rows.select("chrom", first.alias("start"), last.alias("end"), seq.alias("seq"), "length")


def gc_of_chunks(chunks: DataFrame, width: int) -> DataFrame:
    """(chrom, idx, gc): share of G and C of each *width* letters of sequences that come in chunks, as
    :func:`tessera.operators.binning.gc_per_bin` has it for whole ones. What a chunk has of a bin is counted, and counts of
    bins that cross chunks add up."""
    lead = ((F.lit(width) - F.col("start") % width) % width).cast("int")
    parts = F.regexp_extract_all(F.substring("seq", lead + 1, F.length("seq")), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    parts = F.when(lead > 0, F.concat(F.array(F.substring("seq", F.lit(1), lead)), parts)).otherwise(parts)
    last = (F.col("end") == F.col("length")) & (F.col("length") % width == 0)
    parts = F.when(last, F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    rows = chunks.select("chrom", F.col("start"), F.posexplode(parts).alias("i", "part"))
    gc = F.length(F.regexp_replace("part", "[^GCgc]", ""))
    rows = rows.select("chrom", (F.expr(f"start div {width}") + F.col("i")).alias("idx"), gc.alias("gc"), F.length("part").alias("n"))
    return rows.groupBy("chrom", "idx").agg(F.coalesce(F.try_divide(F.sum("gc"), F.sum("n")), F.lit(0.0)).alias("gc"))


def write_fasta(seqs: DataFrame, path: str, name: str = "chrom", seq: str = "seq", line: int = 60) -> None:
    """Write sequences as FASTA files, one a partition, lines of *line* letters. Names must have no white space."""
    body = F.rtrim(F.regexp_replace(F.col(seq), f"(?s)(.{{1,{line}}})", "$1\n"), F.lit("\n"))
    rows = seqs.filter(F.col(name).isNotNull() & F.col(seq).isNotNull())
    rows.select(F.concat(F.lit(">"), F.col(name), F.when(F.length(seq) > 0, F.concat(F.lit("\n"), body)).otherwise("")).alias("value")).write.text(path)
