"""Repeated windows in sequences: winnowed anchors, their contexts, and exact windows around them.

A window is *length* consecutive symbols. Of its runs of *seed* symbols the one of least hash (the first of
equals) is its anchor, so equal windows have equal anchors at equal offsets. An anchor's entry stands for all
windows that chose it: its context is what these windows cover. Two entries of equal context repeat each other
whole; entries of unlike contexts may share some of their windows, and then also the symbols next to the seed
on one side at least ("half contexts"), since a window reaches that far left or right of its seed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.store import stage_table

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}
#: Rows between the steps. kind 0: an entry (anchor, context, halves, document, place). kind 1: a range of
#: *doc* that repeats (at: start, context: end). kind 2: an entry whose windows must be compared (context:
#: 1 if its left half recurs, plus 2 if its right half does).
SCHEMA = "kind byte, anchor long, context long, halves long, doc long, at long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 15) * 2, base, U)
        p[0] = 1
        _powers[base] = p = np.multiply.accumulate(p)
    return p[:n]


class Hashes:
    """Hashes of any stretch of a sequence of 64-bit symbols, from sums of symbol * base^place."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        base = _BASES[which]
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * _power(base, len(symbols)), out=self.sums[1:])
        self.back = _power(pow(base, -1, 1 << 64), len(symbols) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(U) * U(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Shape:
    length: int  # symbols of a window
    seed: int  # symbols of a seed

    @property
    def left(self) -> int:
        return (self.length - self.seed + 1) // 2

    @property
    def right(self) -> int:
        return self.length - self.seed + 1 - self.left


def anchors(h: Hashes, n: int, shape: Shape, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each anchor, and the first and last start of the windows that chose it. Long sequences go
    in parts; an anchor at their border then has two entries, which compare like any others."""
    w, windows = shape.length - shape.seed + 1, n - shape.length + 1
    out = []
    for s in range(0, max(0, windows), part):
        m = min(part, windows - s)
        at = np.arange(s, s + m + w - 1)
        key = (h.of(at, at + shape.seed) & U(0xFFFFFFFFFFE00000)) | (at - s).astype(U)
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if w > span:
            key = np.minimum(key[: -(w - span)], key[w - span :])
        place = (key & U(0x1FFFFF)).astype(np.int64) + s
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], m) - 1
        out.append((place[first], first + s, last + s))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def entries(symbols: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """anchor, context, halves and place of each entry. place packs the anchor's place, how far its first
    window begins before it, and how many windows follow the first."""
    n = len(symbols)
    h = Hashes(symbols)
    at, s0, s1 = anchors(h, n, shape)
    context = mix(h.of(s0, s1 + shape.length) + (at - s0).astype(U) * U(0x9FB21C651E98DF25))
    l0, r1 = np.maximum(at - shape.left, 0), np.minimum(at + shape.seed + shape.right, n)
    left = np.where(at >= shape.left, h.of(l0, at) >> U(32), U(0))
    right = np.where(at + shape.seed + shape.right <= n, h.of(at + shape.seed, r1) >> U(32), U(0))
    place = (at << 24) | ((at - s0) << 12) | (s1 - s0)
    return h.of(at, at + shape.seed), context, (left << U(32)) | right, place


def unpack(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of what an entry's windows cover."""
    start = (place >> 24) - ((place >> 12) & 0xFFF)
    return start, start + (place & 0xFFF) + length


def rows_of(kind: int, anchor, context, halves, doc, at) -> pa.RecordBatch:
    i64 = lambda x: pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == U else np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int8)), *map(i64, (anchor, context, halves, doc, at))],
        ["kind", "anchor", "context", "halves", "doc", "at"],
    )


def ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 1, touching ranges of a document joined."""
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    if len(doc):
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
        first = np.flatnonzero(fresh)
        doc, start, end = doc[first], start[first], np.maximum.reduceat(end, first)
    spread = mix(doc.astype(U) * U(_BASES[0]) + start.astype(U))  # so that ranges go to all tasks
    return rows_of(1, spread, end, np.zeros(len(doc), np.int64), doc, start)


def sample(docs: DataFrame, id_col: str, text_col: str, shape: Shape, symbols_of, same_doc: bool) -> DataFrame:
    """Entries of all documents, combined in every task before they are shuffled: of a batch's entries of
    equal context only the first document's (with *same_doc*, only the first) go on, the others' ranges
    are known to repeat. So a passage in a third of all documents sends a few rows per batch."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint"):
        raise TypeError("ids must be integers, as repeats are kept in their order")

    def run(batches):
        symbols = symbols_of()
        for b in batches:
            parts, ids = [], b.column(0).to_pylist()
            for i, t in zip(ids, b.column(1).to_pylist(), strict=True):
                if t and i is not None:
                    s = symbols(t)
                    if len(s) >= shape.length:
                        e = entries(s, shape)
                        parts.append((*e, np.full(len(e[0]), i, np.int64)))
            if not parts:
                continue
            anchor, context, halves, place, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            o = np.lexsort((place, doc, context))
            head = np.flatnonzero(np.diff(context[o], prepend=context[o][:1] + U(1)))
            first = np.repeat(o[head], np.diff(np.append(head, len(o))))
            again = (doc[o] > doc[first]) | ((place[o] != place[first]) if same_doc else False)
            again &= anchor[o] == anchor[first]
            k, r = o[~again], o[again]
            yield rows_of(0, anchor[k], context[k], halves[k], doc[k], place[k])
            if len(r):
                yield ranges(doc[r], *unpack(place[r], shape.length))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def sift(rows: DataFrame, shape: Shape, same_doc: bool, chunk: int = 200_000) -> DataFrame:
    """Rows of kinds 1 and 2 from entries that :func:`split_hot` has dealt, anchor by anchor.

    A context that an earlier document (with *same_doc*, an earlier place) has too repeats whole. Of the others those stay open (kind 2) whose left
    or right half some other entry of their anchor shares; those that were salted, whose half many share, stay
    open. Anchors come sorted, so a task holds *chunk* rows and one anchor's.
    """

    def flush(held):
        anchor, context, halves, doc, at, salt = (np.concatenate(x) for x in zip(*held, strict=True))
        o = np.lexsort((at, doc, context, anchor))
        anchor, context, halves, doc, at, salt = (x[o] for x in (anchor, context, halves, doc, at, salt))
        same = np.zeros(len(o), bool)
        same[1:] = (context[1:] == context[:-1]) & (anchor[1:] == anchor[:-1])
        first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        late = same & ((doc != doc[first]) | ((at != at[first]) if same_doc else False))
        gone = same if same_doc else late
        if late.any():
            yield ranges(doc[late], *unpack(at[late], shape.length))
        anchor, halves, doc, at, salt = (x[~gone] for x in (anchor, halves, doc, at, salt))
        flags = np.zeros(len(anchor), np.int64)
        for bit, half in ((1, halves >> U(32)), (2, halves & U(0xFFFFFFFF))):
            key = mix(anchor + half * U(0x9E3779B97F4A7C15))
            by = np.argsort(key, kind="stable")
            twice = np.zeros(len(key) + 1, bool)
            twice[1:-1] = key[by][1:] == key[by][:-1]
            flags[by[twice[:-1] | twice[1:]]] |= bit
            flags[salt > 0] |= bit
            flags[half == 0] &= ~bit
        k = flags > 0
        yield rows_of(2, anchor[k], flags[k], halves[k], doc[k], at[k])  # context: the flags

    def run(batches):
        held, size = [], 0
        for b in batches:
            kind = b.column(0).to_numpy()
            if (kind == 1).any():
                yield b.filter(pa.array(kind == 1)).drop_columns(["salt"])
            c = [b.column(k).to_numpy()[kind == 0] for k in range(1, 7)]
            if not len(c[0]):
                continue
            new = (c[0].view(U), c[1].view(U), c[2].view(U), c[3], c[4], c[5].astype(np.int64))
            if size >= chunk and (cut := int((new[0] != held[-1][0][-1]).argmax())) + int(new[0][0] != held[-1][0][-1]):
                held.append(tuple(x[:cut] for x in new))
                yield from flush(held)
                new, held, size = tuple(x[cut:] for x in new), [], 0
            held.append(new)
            size += len(new[0])
        if held:
            yield from flush(held)

    rows = rows.select("kind", "anchor", "context", "halves", "doc", "at", "salt")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SCHEMA).select("kind", "doc", "at", "context")


def windows(docs: DataFrame, open_: DataFrame, id_col: str, text_col: str, shape: Shape, symbols_of, same_doc: bool) -> DataFrame:
    """(x, y, doc, start, late): 128-bit hashes of the windows of entries of kind 2. Windows that reach past
    a half context that doesn't recur can't recur and are left out. Each task combines its own: ``late``
    marks those that repeat within a batch, so that a window sends a row or so per batch to be compared."""
    per = open_.groupBy("doc").agg(F.collect_list(F.struct("at", "context")).alias("open"))
    per = per.select(F.col("doc").alias("__doc"), F.transform("open", lambda x: x["at"]).alias("at"), F.transform("open", lambda x: x["context"]).alias("flags"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    both = texts.join(per, texts["doc"] == per["__doc"]).select("doc", "text", "at", "flags")

    def run(batches):
        symbols = symbols_of()
        for b in batches:
            out, held = [], 0
            for i, t, at, flags in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                place, flag = np.array(at, np.int64), np.array(flags, np.int64)
                s = symbols(t or "")
                n = (place & 0xFFF) + 1
                which = np.repeat(np.arange(len(place)), n)
                start = np.repeat(unpack(place, shape.length)[0], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                before = (place >> 24)[which] - start
                after = shape.length - shape.seed - before
                ok = ((before < shape.left) | (flag[which] & 1 > 0)) & ((after < shape.right) | (flag[which] & 2 > 0))
                start = np.unique(start[ok])
                out.append((Hashes(s).of(start, start + shape.length), Hashes(s, 1).of(start, start + shape.length), np.full(len(start), i, np.int64), start))
                held += len(start)
                if held > 500_000:
                    yield _windows(out, same_doc)
                    out, held = [], 0
            if out:
                yield _windows(out, same_doc)

    return both.mapInArrow(run, "x long, y long, doc long, start long, late boolean")


def _windows(out: list, same_doc: bool) -> pa.RecordBatch:
    x, y, doc, start = (np.concatenate(c) for c in zip(*out, strict=True))
    o = np.lexsort((start, doc, y, x))
    x, y, doc, start = x[o], y[o], doc[o], start[o]
    head = np.ones(len(x), bool)
    head[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (doc > doc[first]) | ((start != start[first]) if same_doc else False)
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(doc), pa.array(start), pa.array(late)], ["x", "y", "doc", "start", "late"])


def covered(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, shape: Shape, symbols_of, same_doc: bool) -> DataFrame:
    """*docs* (id, text) with ``starts`` and ``ends`` of the ranges that repeat earlier, null if none, from
    rows of kinds 1 and 2. The windows of kind 2 meet on their hashes, once, combined before the shuffle."""
    rows = stage_table(windows(docs, found.filter("kind = 2"), id_col, text_col, shape, symbols_of, same_doc), "windows")
    order = F.struct("doc", "start") if same_doc else F.struct("doc")
    once = rows.filter("not late").withColumn("first", F.min(order).over(Window.partitionBy("x", "y")))
    late = once.filter(order > F.col("first")).unionByName(rows.filter("late"), allowMissingColumns=True)
    late = late.select("doc", "start", (F.col("start") + shape.length).alias("end"))
    known = found.filter("kind = 1").select("doc", F.col("at").alias("start"), F.col("context").alias("end"))
    return with_ranges(docs, known.unionByName(late), id_col, text_col)


def with_ranges(docs: DataFrame, ranges_: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """*docs* (id, text) with ``starts`` and ``ends`` of their *ranges_* (doc, start, end), null if none."""
    per = ranges_.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("r"))
    per = per.select(F.col("doc").alias("__doc"), F.transform("r", lambda x: x["start"]).alias("starts"), F.transform("r", lambda x: x["end"]).alias("ends"))
    per = stage_table(per, "ranges")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(per, texts["doc_id"] == per["__doc"], "left").select("doc_id", "text", "starts", "ends")


def _hot(rows: DataFrame, most: int, broadcast_rows: int = 500_000) -> DataFrame | None:
    """Anchors with over *most* entries, by an exact count: at most rows / *most* of them, which are broadcast if
    a count shows at most *broadcast_rows*. None if there are none."""
    hot = rows.filter("kind = 0").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
    hot = stage_table(hot.select("anchor"), "hot")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= broadcast_rows else hot


def split_hot(rows: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """*rows* (a stage table of entries) with anchors that have not many more than *most* entries each.

    An entry of an anchor with more is taken twice, under its anchor with the left and with the right half
    of its context; equal contexts share one of these at least. Where even so many share anchor and half
    (the border of a common passage), they are dealt by context to *salts* anchors; ``salt`` marks them with 1.
    """
    hot = _hot(rows, most)
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    cold = rows.join(hot, "anchor", "left_anti").withColumn("salt", F.lit(0))
    left, right = F.shiftleft(F.shiftrightunsigned("halves", 32), 32), F.col("halves").bitwiseAND(F.lit(0xFFFFFFFF))
    sides = F.filter(F.array(F.struct(F.lit(1).alias("s"), left.alias("h")), F.struct(F.lit(2).alias("s"), right.alias("h"))), lambda x: x["h"] != 0)
    mine = rows.filter("kind = 0").join(hot, "anchor", "left_semi").withColumn("x", F.explode(sides))
    mine = mine.select("kind", F.xxhash64("anchor", "x.s", "x.h").alias("anchor"), "context", F.col("x.h").alias("halves"), "doc", "at")
    mine = stage_table(mine, "sides")
    hot = _hot(mine, most)
    if hot is None:
        mine = mine.withColumn("salt", F.lit(0))
    else:
        mine = mine.join(hot.withColumn("hot", F.lit(True)), "anchor", "left")
        place = F.xxhash64("anchor", F.pmod("context", F.lit(salts)))
        mine = mine.withColumn("anchor", F.when(F.col("hot"), place).otherwise(F.col("anchor"))).withColumn("salt", F.when(F.col("hot"), 1).otherwise(0)).drop("hot")
    return cold.unionByName(mine)


def mask_of(n: int, starts: list[int] | None, ends: list[int] | None) -> np.ndarray:
    """Which of *n* places some range covers."""
    edge = np.zeros(n + 1, np.int64)
    if starts:
        np.add.at(edge, np.array(starts), 1)
        np.add.at(edge, np.array(ends), -1)
    return np.cumsum(edge[:n]) > 0


class ByteSymbols:
    """A text's UTF-8 bytes as 64-bit symbols."""

    table = mix(np.arange(1, 257, dtype=U) * U(_BASES[1]))

    def __call__(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


class WordSymbols(dict):
    """A text's words as 64-bit symbols; hashes of at most *most* words are kept."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: bytes) -> int:
        v = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) < self.most:
            self[w] = v
        return v

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").split()
        return np.fromiter(map(self.__getitem__, words), U, len(words))
