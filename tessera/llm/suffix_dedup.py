"""Substring dedup by bytes with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.sequences import ByteSymbols, Hashes, Shape, mask_of, ranges, sample, sift, split_hot, unpack, with_ranges
from tessera.llm.store import drop_table, stage_table

U = np.uint64


class SuffixLevels:
    """Suffix arrays of geometrically growing sizes, each in the order of its suffixes' first *length* bytes.

    A new batch of suffixes gets an array of its own, is merge-scanned against every level for common
    prefixes of *length* bytes, and joins the family as its smallest level; levels of like size merge, so that
    a suffix is merged O(log n) times. Of suffixes with a common prefix of that length the first one stays;
    the places of the others are handed out.
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def array(self, data: np.ndarray, pos: np.ndarray, doc: np.ndarray, at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
        """Suffix array (prefix, doc, at, more) of the suffixes of *data* at *pos*; equal prefixes by doc and at."""
        prefix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.length)[pos]).view(f"S{self.length}").ravel()
        o = np.lexsort((at, doc))
        o = o[np.argsort(prefix[o], kind="stable")]
        return prefix[o], doc[o], at[o], more[o]

    def add(self, new: tuple[np.ndarray, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take in a batch's suffix array; (doc, at) of the suffixes that it shows to repeat."""
        same = np.zeros(len(new[0]), bool)
        same[1:] = new[0][1:] == new[0][:-1]
        first = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(same) else np.zeros(0, np.int64)
        late = same & ((new[1] != new[1][first]) | (new[2] != new[2][first]))  # a repeated row is no repeat
        found = [(new[1][late], new[2][late])]
        new = tuple(x[~same] for x in new)
        for i, level in enumerate(self.levels):
            new, self.levels[i], repeats = self._scan(new, level)
            found += repeats
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = tuple(np.concatenate(x) for x in zip(a, b, strict=True))
            o = np.argsort(both[0], kind="stable")  # two sorted runs: a merge
            self.levels.append(tuple(x[o] for x in both))
        return found

    def _scan(self, new: tuple, level: tuple) -> tuple[tuple, tuple, list]:
        """Scan a new array against a level: of two equal prefixes the first place stays, in either one."""
        at = np.searchsorted(level[0], new[0])
        ok = at < len(level[0])
        ok[ok] = level[0][at[ok]] == new[0][ok]
        i, j = np.flatnonzero(ok), at[ok]
        later = (new[1][i] > level[1][j]) | ((new[1][i] == level[1][j]) & (new[2][i] > level[2][j]))
        equal = (new[1][i] == level[1][j]) & (new[2][i] == level[2][j])  # a repeated row
        out, back, gone = i[later], j[~later & ~equal], i[later | equal]
        found = [(new[1][out], new[2][out]), (level[1][back], level[2][back])]
        keep = np.ones(len(new[0]), bool)
        keep[gone] = False
        if len(back):
            left = np.ones(len(level[0]), bool)
            left[back] = False
            level = tuple(x[left] for x in level)
        return tuple(x[keep] for x in new), level, found


def contexts(docs: DataFrame, open_: DataFrame, id_col: str, text_col: str, shape: Shape) -> DataFrame:
    """(key, doc, start, raw): the bytes that an open entry's windows cover, in two rows: windows that reach
    its whole left half, keyed by that half and the seed, and the others, which reach its whole right half,
    keyed by the seed and that. Halves that recur nowhere are left out. Equal windows have equal keys."""
    per = open_.groupBy("doc").agg(F.collect_list(F.struct("at", "context")).alias("o"))
    per = per.select(F.col("doc").alias("__doc"), F.transform("o", lambda x: x["at"]).alias("at"), F.transform("o", lambda x: x["context"]).alias("flags"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    both = texts.join(per, texts["doc"] == per["__doc"]).select("doc", "text", "at", "flags")

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b, out = whole.slice(k, 256), ([], [], [], [])
                for i, t, place, flag in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = (t or "").encode("utf-8", "replace")
                    place, flag = np.unique(np.array([place, flag], np.int64), axis=1)
                    start, end = unpack(place, shape.length)
                    at, last = place >> 24, end - shape.length
                    turn = at - shape.left  # the last start that reaches the whole left half
                    for bit, lo, hi, half in ((1, start, np.minimum(last, turn), turn), (2, np.maximum(start, turn + 1), last, at)):
                        ok = (flag & bit > 0) & (lo <= hi)
                        size = shape.seed + (shape.left if bit == 1 else shape.right)
                        for x, y, h in zip(lo[ok].tolist(), hi[ok].tolist(), half[ok].tolist(), strict=True):
                            key = int.from_bytes(hashlib.blake2b(raw[h : h + size], digest_size=8, key=bytes([bit])).digest(), "little", signed=True)
                            for c, v in zip(out, (key, i, x, raw[x : y + shape.length]), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["key", "doc", "start", "raw"])

    return both.mapInArrow(run, "key long, doc long, start long, raw binary")


def compare(rows: DataFrame, length: int, hot_rows: int, task_suffixes: int, batch_suffixes: int, broadcast_rows: int = 500_000) -> DataFrame:
    """Ranges (doc, start, end) of the suffixes of *rows* (a stage table of contexts) whose first *length*
    bytes also start at an earlier place.

    Suffixes that may be equal have one key and meet in one task, in order of document and place; there
    they go through a :class:`SuffixLevels` in batches. Tasks are as many as keep about *task_suffixes* in
    each. A key with more than *hot_rows* rows is dealt by document to pieces of about that many; the
    suffixes that stay first in a piece meet once more by 128-bit hashes of their bytes. Keys are counted
    exactly; hot ones, at most rows / *hot_rows*, are broadcast if a count shows at most *broadcast_rows*.
    """
    total = rows.agg(F.sum(F.length("raw") - (length - 1))).head()[0] or 0
    parts = max(1, -(-int(total) // task_suffixes))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot_rows)
    hot = stage_table(hot.select("key", F.ceil(F.col("c") / hot_rows).alias("pieces")), "hot")
    rows = rows.join(F.broadcast(hot) if hot.count() <= broadcast_rows else hot, "key", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("pieces")), F.lit(0))

    def run(batches):
        levels = SuffixLevels(length)

        def flush(b):
            raw = b.column(3).to_pylist()
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            n = size - length + 1
            which = np.repeat(np.arange(len(raw)), n)
            off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            data = np.frombuffer(b"".join(raw), np.uint8)
            hot, doc, start = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            new = levels.array(data, (np.cumsum(size) - size)[which] + off, doc[which], start[which] + off, hot[which])
            for d, at in levels.add(new):
                if len(d):
                    r = ranges(d, at, at + length)
                    none = pa.nulls(r.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([r.column(4), r.column(5), r.column(2), none, none], ["doc", "start", "end", "x", "y"])

        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                held.append(b.slice(i, 1000))
                size += held[-1].column(3).nbytes - 99 * held[-1].num_rows
                if size >= batch_suffixes:
                    yield from flush(pa.concat_batches(held))
                    held, size = [], 0
        if held:
            yield from flush(pa.concat_batches(held))
        for prefix, doc, at, hot in levels.levels:
            where = np.flatnonzero(hot)
            for i in range(0, len(where), 4096):
                w = where[i : i + 4096]
                h = np.arange(len(w)) * length
                symbols = ByteSymbols.table[np.ascontiguousarray(prefix[w]).view(np.uint8)]
                x, y = (Hashes(symbols, k).of(h, h + length).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[w], at[w], at[w] + length, x, y)], ["doc", "start", "end", "x", "y"])

    rows = rows.repartition(parts, "key", piece).sortWithinPartitions("doc", "start")
    rows = rows.select(F.col("pieces").isNotNull().alias("hot"), "doc", "start", "raw")
    out = stage_table(rows.mapInArrow(run, "doc long, start long, end long, x long, y long"), "repeats")
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy("x", "y"))
    late = out.filter("x is not null").withColumn("first", first).filter(F.struct("doc", "start") > F.col("first"))
    return out.filter("x is null").select("doc", "start", "end").unionByName(late.select("doc", "start", "end"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    seed: int = 20,
    hot_entries: int = 50_000,
    hot_rows: int = 2_000,
    task_suffixes: int = 500_000,
    batch_suffixes: int = 200_000,
) -> DataFrame:
    """Per row of *docs*: id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte of a text's UTF-8 form goes if a string of *length* bytes covers it that also starts earlier: in
    a document of smaller id, or before in the same one. Overlaps count, the input decides, not what is
    left, and strings don't cross documents.
    1. Suffixes are sampled by content (one in about ``(length - seed) / 2`` bytes) so that every string of
       that length has a sampled place. Fingerprints of what surrounds a sampled place tell which contexts
       repeat whole and where nothing can repeat (:func:`sift`).
    2. All suffixes of the contexts left open go through families of suffix arrays (:func:`compare`).
    An anchor with more than *hot_entries* entries is split over many tasks in step 1, a seed and half context
    with more than *hot_rows* in step 2.

    A null or empty text has no bytes. A null id is compared with none. Rows that repeat an id must repeat
    its text; they are treated alike. An empty table gives no rows.
    """
    shape = Shape(length, seed)
    rows = stage_table(sample(docs, id_col, text_col, shape, ByteSymbols, True), "entries")
    found = stage_table(sift(split_hot(rows, hot_entries), shape, True), "sifted")
    drop_table(rows)
    open_ = stage_table(contexts(docs, found.filter("kind = 2"), id_col, text_col, shape), "contexts")
    late = compare(open_, length, hot_rows, task_suffixes, batch_suffixes)
    known = found.filter("kind = 1").select("doc", F.col("at").alias("start"), F.col("context").alias("end"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, gone, spans, kept = [], [], [], []
            for t, s, e in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
                mask = mask_of(len(raw), s, e)
                n.append(len(raw))
                gone.append(int(mask.sum()))
                spans.append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(raw[~mask].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_ranges(docs, known.unionByName(late), id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
