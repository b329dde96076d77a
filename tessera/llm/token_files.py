"""Token id files: canonical length-limited Huffman codes, blocks that decode on their own.

A file is: magic; u32 size and zlib bytes of the code lengths (u8 an id); blocks; u64 places of the blocks'
starts, u32 their number and magic. A block is: u32 documents, u32 checkpoints, u64 ids in the file before
it; i64 document ids (with a u8 null mark each); u64 numbers of ids; u64 bit offsets, from the block's first
data byte, of every 256th id of a document; the documents' bits, each document beginning at a byte. A block
ends with the document that brings its data to a size, or at a number of documents.
All numbers are little-endian, bits run from the highest of a byte.
"""

from __future__ import annotations

import array
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import by_units
from tessera.llm.bpe import MARKS, ODD, VOCABULARY, WORDS, _at, byte_letters, units, vocabulary_path
from tessera.llm.store import drop_table, freed_shuffles, new_path, slices, stage_table

STEP, LIMIT, MAGIC = 256, 20, b"TSHF0002"
# Characters that every Unicode version puts into the same class, so words of such units are the library's.
_PLAIN = re.compile("[\t-\r -~\u00a0-\u017e]+").fullmatch


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (0 for unused ids) of an optimal prefix code of at most *limit* bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit into {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.float64)
    levels, packs = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))  # is it an id, and not a package
        merged = both[rank]
        even = len(merged) // 2 * 2
        packs = merged[0:even:2] + merged[1:even:2]
    length, take = np.zeros(len(order), np.int64), 2 * (len(order) - 1)
    for single in reversed(levels):
        n = int(single[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by id."""
    out, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        out[i] = code
        code += 1
    return out


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Bits, and checkpoints (u64 bit offsets of every 256th id), of documents whose *ids* follow each other."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(sizes)
    total = np.diff(ends[last - 1], prepend=0)
    n_bytes = (total + 7) // 8
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    before = np.repeat(np.concatenate([[0], ends[last - 1][:-1]]), sizes)
    inner = ends - bits - before
    at = inner + np.repeat(base[:-1] * 8, sizes)
    word, off = at >> 5, at & 31
    value = code[ids].astype(np.uint64) << (64 - off - bits).astype(np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    buf = np.zeros(int(base[-1]) // 4 + 3, np.uint64)
    buf[word[starts]] += np.add.reduceat(value >> np.uint64(32), starts)
    buf[word[starts] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), starts)
    data = buf.astype(">u4").tobytes()
    first = last - sizes
    marks = [inner[a:b:STEP].astype("<u8").tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return [data[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)], marks


class Table:
    """Decoding table of a canonical code: the next *limit* bits give an id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.limit = int(lengths.max()) if len(lengths) else 1
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = 1 << (self.limit - lengths[order].astype(np.int64))
        self.ids, self.bits = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.int64)
        end = int(span.sum())
        self.ids[:end], self.bits[:end] = np.repeat(order, span), np.repeat(lengths[order], span)

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Ids of streams that begin at bit *starts*, in rising order, and have *sizes* ids each. Streams of about
        *most* bytes at a time advance together."""
        starts, out, lo = starts.astype(np.int64), np.empty(int(sizes.sum()), np.uint32), 0
        first, done = starts >> 3, 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, side="right")))
            end = len(data) if hi == len(starts) else int(first[hi]) + 1
            n = int(sizes[lo:hi].sum())
            out[done : done + n] = self._streams(data[int(first[lo]) : end], starts[lo:hi] - 8 * first[lo], sizes[lo:hi])
            lo, done = hi, done + n
        return out

    def _streams(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
        window = (b[:-4] << np.uint64(32)) | (b[1:-3] << np.uint64(24)) | (b[2:-2] << np.uint64(16)) | (b[3:-1] << np.uint64(8)) | b[4:]
        order = np.argsort(-sizes, kind="stable")
        at, n = starts[order], sizes[order]
        to = (np.cumsum(sizes) - sizes)[order]
        out = np.empty(int(sizes.sum()), np.uint32)
        mask, shift = np.uint64((1 << self.limit) - 1), 40 - self.limit
        for k in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -k, side="left"))
            p = at[:m]
            x = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint64)) & mask
            out[to[:m] + k] = self.ids[x]
            at[:m] = p + self.bits[x]
        return out


_memo: dict[str, object] = {}


class LibraryEncoder:
    """text -> little-endian u32 bytes of its ids, as the tokenizers library encodes it. Units between cuts that no word
    crosses are encoded one by one and kept without their blank, *most* words and a quarter as many units."""

    def __init__(self, vocabulary: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(vocabulary_path(vocabulary))
        lib.no_truncation()
        lib.no_padding()
        model, letters, blank = lib.model.tokenize, dict(enumerate(byte_letters())), byte_letters()[32]

        class Words(dict):
            # Words go to the library's model without its word splitter.
            def __missing__(self, w: str) -> bytes:
                shown = w.replace(" ", blank) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters)
                v = array.array("I", [t.id for t in model(shown)]).tobytes()
                if len(self) < most:
                    self[w] = v
                return v

        self.words = Words()
        word = self.words.__getitem__

        def unit(u: str) -> bytes:
            core = u.rstrip(MARKS)
            if (core[1:] if core[:1] == " " else core).isalpha():
                # Letters with a blank before and marks after them are one word and another.
                return word(core) + word(u[len(core) :]) if len(core) < len(u) else word(core)
            if _PLAIN(u):
                return b"".join(map(word, WORDS(u)))
            return whole(u)

        class Units(dict):
            def __missing__(self, u: str) -> bytes:
                v = unit(" " + u)
                if len(self) < most // 4:
                    self[u] = v
                return v

        def whole(t: str) -> bytes:
            return array.array("I", lib.encode(t, add_special_tokens=False).ids).tobytes()

        self.special = [t.content for t in lib.get_added_tokens_decoder().values()]
        self.whole, self.unit, self.get = whole, unit, Units().__getitem__

    def __call__(self, t: str) -> bytes:
        if any(s in t for s in self.special):
            return self.whole(t)
        return b"".join(self.get(u[1:]) if u[:1] == " " else self.unit(u) for u in units(t))

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of all *texts*, *end* after each, and where each one's begin."""
        return by_units(texts, lambda found: list(map(self.get, found)), self, self.special, self.unit, ODD, end)


def library_encoder(vocabulary: str, most: int = 800_000) -> LibraryEncoder:
    """A worker's encoder."""
    if _memo.get("name") != vocabulary:
        _memo.clear()
        _memo["f"] = LibraryEncoder(vocabulary, most)
        _memo["name"] = vocabulary
    return _memo["f"]


def tokenize(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, rows: int = 4096) -> DataFrame:
    """(id, n, ids as little-endian u32 bytes with the end id)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        f, end = library_encoder(vocabulary), struct.pack("<I", end_id)
        for whole in batches:
            for b in slices(whole, 1, rows, 8 << 20):
                data, at = f.batch(b.column(1), end)
                for lo in range(0, b.num_rows, 256):
                    hi = min(b.num_rows, lo + 256)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at[lo : hi + 1].copy()), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at[lo : hi + 1]) // 4), ids.cast(pa.binary())], ["id", "n", "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; one row an id, at most the vocabulary, comes to the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            column = b.column(0).cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
            for lo in range(0, len(ids), 1 << 20):
                c = np.bincount(ids[lo : lo + (1 << 20)])
                if len(c) > len(total):
                    total, c = c, total
                total[: len(c)] += c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 2, file_ids: int = 8_000_000, block_docs: int = 512, block_bytes: int = 16 << 20, max_files: int = 100_000) -> list[tuple[str, int]]:
    """Write the ids of *docs* in ascending order of id (nulls first; equal ids by their bits) to files of
    about *file_ids* ids, more where that would make over *max_files*; returns (file, ids in it) in that order.
    The list of files, at most *max_files* rows, is all that comes to the driver besides the ids' counts.

    Documents are coded where they are; a row's file follows from the ids' ranges, and only coded bits are
    shuffled. A task run again writes the same file under the same name.
    """
    tokens = stage_table(tokenize(docs, id_col, text_col, vocabulary, end_id), "tokens")
    counts = id_counts(tokens)
    lengths = code_lengths(counts)
    kind, total = dict(tokens.dtypes)["id"], int(counts.sum())
    if kind not in ("bigint", "int", "smallint"):
        raise TypeError("ids must be integers, as files are in their order")
    code, n_files = codes(lengths), max(1, -(-total // max(file_ids, -(-total // max_files))))
    # The least id of every range but the first; Spark finds ranges of like numbers of rows.
    bounds = np.zeros(0, np.int64)
    if n_files > 1:
        ranged = tokens.select(F.col("id").cast("long")).filter("id is not null").repartitionByRange(n_files, "id")
        least = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id")).collect()
        bounds = np.array(sorted(r["id"] for r in least)[1:], np.int64)

    def coded(batches):
        for whole in batches:
            for b in slices(whole, 2, 256, 16 << 20):
                ids = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4")
                bits, marks = pack(ids, b.column(1).to_numpy(), lengths, code)
                part = np.searchsorted(bounds, b.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary()), pa.array(marks, pa.binary()), pa.array(part, pa.int32())], ["id", "n", "bits", "marks", "part"])

    rows = tokens.mapInArrow(coded, f"id {kind}, n long, bits binary, marks binary, part int")
    rows = rows.repartitionById(n_files, "part").sortWithinPartitions("part", F.asc_nulls_first("id"), "bits")

    def write(batches):
        files, root = _at(path)
        files.create_dir(root)
        done, out, name = [], None, ""
        for b in batches:
            for rest in slices(b, 2, block_docs, block_bytes):
                parts = rest.column(4).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if f"part-{int(parts[lo]):06d}" != name:
                        if out:
                            done.append(out.close())
                        name = f"part-{int(parts[lo]):06d}"
                        out = _Writer(files, root, name, lengths)
                    out.block(rest.slice(lo, hi - lo))
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "n"])

    with freed_shuffles(docs.sparkSession):
        written = sorted((r["file"], int(r["n"])) for r in rows.mapInArrow(write, "file string, n long").collect())
    drop_table(tokens)
    return written


class _Writer:
    def __init__(self, files, root: str, name: str, lengths: np.ndarray):
        self.files, self.temp, self.name = files, f"{root}/_{uuid.uuid4().hex}", f"{root}/{name}.ids"
        self.out = files.open_output_stream(self.temp)
        head = zlib.compress(lengths.tobytes(), 9)
        self.at, self.n, self.places = 0, 0, []
        self.put(MAGIC + struct.pack("<I", len(head)) + head)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def block(self, b: pa.RecordBatch) -> None:
        ids, sizes, bits, marks = (b.column(k).to_pylist() for k in range(4))
        self.places.append(self.at)
        offsets, at = [], 0
        for x, m in zip(bits, marks, strict=True):
            offsets.append((np.frombuffer(m, "<u8") + np.uint64(8 * at)).tobytes())
            at += len(x)
        checks = b"".join(offsets)
        self.put(struct.pack("<IIQ", len(ids), len(checks) // 8, self.n))
        self.put(np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids))
        self.put(np.array(sizes, "<u8").tobytes() + checks)
        for x in bits:
            self.put(x)
        self.n += sum(sizes)

    def close(self) -> tuple[str, int]:
        end = self.at
        self.put(np.array([*self.places, end], "<u8").tobytes() + struct.pack("<I", len(self.places)) + MAGIC)
        self.out.close()
        self.files.move(self.temp, self.name)
        return self.name, self.n


def read_file(path: str, files=None, blocks: range | None = None):
    """(document id, ids before it in the file, ids as u32 array) of a file, or of some of its blocks."""
    files, inner = (files, path) if files else _at(path)
    with files.open_input_file(inner) as f:
        size = f.size()
        f.seek(size - 12)
        n = struct.unpack("<I", f.read(4))[0]
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} isn't complete")
        f.seek(size - 12 - 8 * (n + 1))
        places = np.frombuffer(f.read(8 * (n + 1)), "<u8").tolist()
        f.seek(8)
        head = struct.unpack("<I", f.read(4))[0]
        table = Table(np.frombuffer(zlib.decompress(f.read(head)), np.uint8))
        for k in blocks or range(n):
            f.seek(places[k])
            data = f.read(places[k + 1] - places[k])
            docs, checks, before = struct.unpack_from("<IIQ", data)
            at = 16
            ids, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
            null, at = data[at : at + docs], at + docs
            sizes, at = np.frombuffer(data, "<u8", docs, at).astype(np.int64), at + 8 * docs
            starts, at = np.frombuffer(data, "<u8", checks, at), at + 8 * checks
            # Streams: 256 ids from each checkpoint, fewer at a document's end.
            per = -(-sizes // STEP)
            first = np.cumsum(per) - per
            length = np.full(checks, STEP, np.int64)
            length[first + per - 1] = sizes - (per - 1) * STEP
            tokens, end = table.decode(data[at:], starts, length), np.cumsum(sizes)
            for i in range(docs):
                lo = int(end[i] - sizes[i])
                yield (None if null[i] else int(ids[i])), before + lo, tokens[lo : int(end[i])]


def read_files(spark, written: list[tuple[str, int]], kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, read back from files, a task each."""
    base, rows = 0, []
    for k, (file, n) in enumerate(written):
        rows.append((k, file, base))
        base += n

    def run(batches):
        for b in batches:
            for file, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held, size = [], 0
                for i, at, ids in read_file(file, _at("file://" + file)[0] if file.startswith("/") else None):
                    held.append((i, before + at, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if len(held) == 256 or size > 4_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    frame = spark.createDataFrame(rows, "k int, file string, base long")
    frame = frame.repartitionById(max(1, len(rows)), "k")
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write the files of *docs* to the shared folder and read them back: (doc_id, start, n_tokens, ids).

    A null or empty text has the end id alone. Null ids come first; rows that repeat an id are documents
    of their own. An empty table gives no rows. Texts may be of any length, and other columns are ignored.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    return read_files(spark, write_files(docs, path, id_col, text_col, **how), docs.schema[id_col].dataType.simpleString())
