"""Packing documents into windows of tokens by lexical retrieval.

Documents are encoded once. Whole windows of long ones are sequences already; what is left of each document is laid
next to documents that share its rarest words (a range shuffle by the largest ids of the vocabulary, whose order is that
of the merges, so commoner ones come first). Each task goes through its range in shards of a bounded number of
tokens, builds an inverted index of a shard with BM25 weights, and fills a window for one seed after the other with the
seed's best unused neighbours. Document frequencies and mean length are those of all documents.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import by_units
from tessera.llm.bpe import byte_letters, vocabulary_path
from tessera.llm.store import slices, stage_table

VOCABULARY, WINDOW, END_ID = "word_bpe_49k.json", 4096, 2
_memo: dict = {}
# Units of printable ASCII and Latin letters up to U+017E (but for one whose lower case is two characters) are in
# composed form, and their lower case is that of each character; the vocabulary's pattern on them, in lower case.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017e]+").fullmatch
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017e"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+").findall


class WordEncoder:
    """text -> bytes of its ids (*dtype*), as the tokenizers library encodes it. The vocabulary drops white space, so
    what stands between blanks is encoded alone and kept, and so are the words of such units; *most* of each.
    Words of plain units go to the library's model without its normalizer and splitter."""

    def __init__(self, vocabulary: str, dtype: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(vocabulary_path(vocabulary))
        lib.no_truncation()
        lib.no_padding()
        whole = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, dtype).tobytes()
        model, letters, code = lib.model.tokenize, dict(enumerate(byte_letters())), "H" if dtype == "<u2" else "I"

        class Words(dict):
            def __missing__(self, w: str) -> bytes:
                v = array(code, [t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]).tobytes()
                if len(self) < most:
                    self[w] = v
                return v

        word = Words().__getitem__

        class Units(dict):
            def __missing__(self, u: str) -> bytes:
                v = b"".join(map(word, _WORDS(u.lower()))) if _PLAIN(u) else whole(u) if u else b""
                if len(self) < most:
                    self[u] = v
                return v

        self.special = [t.content for t in lib.get_added_tokens_decoder().values()]
        self.whole, self.get = whole, Units().__getitem__

    def __call__(self, t: str) -> bytes:
        if any(s in t for s in self.special):
            return self.whole(t)
        return b"".join(map(self.get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of all *texts*, *end* after each, and where each one's begin."""
        return by_units(texts, lambda found: list(map(self.get, found)), self.whole, self.special, end=end, blanks="\n\t\r")


def word_encoder(vocabulary: str, dtype: str, most: int = 800_000) -> WordEncoder:
    """A worker's encoder."""
    key = (vocabulary, dtype)
    if key not in _memo:
        _memo.clear()
        _memo[key] = WordEncoder(vocabulary, dtype, most)
    return _memo[key]


def cut(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the pieces of documents of *sizes* ids, cut at every *window*."""
    n = -(-sizes // window)
    of = np.repeat(np.arange(len(sizes)), n)
    return of, (np.arange(len(of)) - (np.cumsum(n) - n)[of]) * window


def largest(ids: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The largest, second and third distinct id (else 0) of pieces of *sizes* ids that follow each other, and the
    distinct ids of each document (*of* is a piece's, rising), one document's after the other's."""
    n, span = len(sizes), int(ids.max(initial=0)) + 1
    key = np.repeat(np.arange(n) * span, sizes) + ids
    key = np.sort(key.astype(np.int32) if n * span < 1 << 31 else key).astype(np.int64)
    key = key[np.append(True, np.diff(key) > 0)] if len(key) else key
    ends = np.searchsorted(key, np.arange(n + 1) * span)
    at = ends[1:, None] - [1, 2, 3]
    top = np.where(at >= ends[:-1, None], key[np.maximum(at, 0)] % span, 0)
    piece = key // span
    several = np.bincount(of)[of[piece]] > 1
    return list(top.T), np.concatenate([key[~several] % span, np.unique(of[piece[several]] * span + key[several] % span) % span])


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, window: int, dtype: str) -> DataFrame:
    """(id, doc_tokens, start, ids, k1, k2, k3) of all documents, cut at every *window* ids; k1 to k3 are the largest
    ids of a piece. Rows whose doc_tokens is null hold in k1 an id and in start the number of a task's documents with it."""
    kind, itemsize = docs.schema[id_col].dataType.simpleString(), np.dtype(dtype).itemsize

    def run(batches):
        f, end = word_encoder(vocabulary, dtype), np.array([end_id], dtype).tobytes()
        seen, of = np.zeros(0, np.int64), None
        for whole in batches:
            of = whole.schema.field(0).type
            for b in slices(whole, 1, 4096, 8 << 20):
                data, at = f.batch(b.column(1), end)
                for lo in range(0, b.num_rows, 512):
                    ends = at[lo : lo + 513]
                    sizes = np.diff(ends) // itemsize
                    i, start = cut(sizes, window)
                    begin = np.append(ends[i] + start * itemsize, ends[-1])
                    top, distinct = largest(data[ends[0] : ends[-1]].view(dtype).astype(np.int64), np.diff(begin) // itemsize, i)
                    c = np.bincount(distinct)
                    if len(c) > len(seen):
                        seen, c = c, seen
                    seen[: len(c)] += c
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(begin), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(i + lo)), pa.array(sizes[i]), pa.array(start), ids.cast(pa.binary()), *(pa.array(t.astype(np.int32)) for t in top)],
                        ["id", "doc_tokens", "start", "ids", "k1", "k2", "k3"],
                    )
        some = np.flatnonzero(seen)
        if len(some):
            none = lambda t: pa.nulls(len(some), t)
            yield pa.RecordBatch.from_arrays(
                [none(of), none(pa.int64()), pa.array(seen[some]), none(pa.binary()), pa.array(some, pa.int32()), none(pa.int32()), none(pa.int32())],
                ["id", "doc_tokens", "start", "ids", "k1", "k2", "k3"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, doc_tokens long, start long, ids binary, k1 int, k2 int, k3 int")


class Index:
    """BM25 weights of a shard's pieces by term, and the pieces that are still to be used."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        n = len(ids)
        self.left = np.array([len(x) for x in ids], np.int64)
        key = np.concatenate(ids).astype(np.int64) * n + np.repeat(np.arange(n), self.left)
        key = np.sort(key.astype(np.int32) if key.max(initial=0) < 1 << 31 else key).astype(np.int64)  # half as wide sorts faster
        own = np.flatnonzero(np.diff(key, prepend=-1))
        key, tf = key[own], np.diff(own, append=len(key))
        self.docs, term = key % n, key // n
        self.weights = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * self.left[self.docs] / mean))
        by_doc = np.argsort(self.docs.astype(np.uint16) if n <= 1 << 16 else self.docs, kind="stable")
        self.first_term = np.searchsorted(self.docs[by_doc], np.arange(n + 1))
        # Terms get numbers of their own in the shard.
        new = np.diff(term, prepend=-1) > 0
        self.terms = (np.cumsum(new) - 1)[by_doc]
        self.first = np.append(np.flatnonzero(new), len(term))
        self.open = n
        self.live = n

    def neighbours(self, seed: int) -> np.ndarray:
        """All pieces with something left, by falling score against *seed*; equal scores as they come."""
        own = self.terms[self.first_term[seed] : self.first_term[seed + 1]]
        lo, hi = self.first[own].tolist(), self.first[own + 1].tolist()
        docs = np.concatenate([self.docs[a:b] for a, b in zip(lo, hi, strict=True)])
        score = np.bincount(docs, np.concatenate([self.weights[a:b] for a, b in zip(lo, hi, strict=True)]), len(self.left))
        some = np.flatnonzero(self.left)
        return some[np.argsort(-score[some], kind="stable")]

    def used(self, some: int) -> None:
        """*some* more pieces are used up; their entries go when a quarter of the index is of such pieces."""
        self.open -= some
        if self.open < 0.75 * self.live:
            keep = self.left[self.docs] > 0
            ends = np.concatenate([[0], np.cumsum(keep)])
            self.first, self.docs, self.weights, self.live = ends[self.first], self.docs[keep], self.weights[keep], self.open


def fill(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows as lists of (piece, from, length), and what is left, less than a window.

    A seed is the first piece with something left. Its neighbours follow by score as long as they fit; the
    first that doesn't is cut, and its rest stays among the pieces to be used.
    """
    index = Index(ids, idf, mean)
    begun, out, seed, total = np.zeros(len(ids), np.int64), [], 0, int(index.left.sum())
    while total >= window:
        while not index.left[seed]:
            seed += 1
        length = int(index.left[seed])
        row = [(seed, int(begun[seed]), length)]
        index.left[seed] = 0
        room, gone = window - length, 1
        if room:
            order = index.neighbours(seed)
            ends = np.cumsum(index.left[order])
            n = int(np.searchsorted(ends, room, side="right"))
            whole = order[:n]
            row += zip(whole.tolist(), begun[whole].tolist(), index.left[whole].tolist(), strict=True)
            index.left[whole] = 0
            gone += n
            room -= int(ends[n - 1]) if n else 0
            if room:
                last = int(order[n])
                row.append((last, int(begun[last]), room))
                begun[last] += room
                index.left[last] -= room
        index.used(gone)
        total -= window
        out.append(row)
    rest = np.flatnonzero(index.left)
    return out, list(zip(rest.tolist(), begun[rest].tolist(), index.left[rest].tolist(), strict=True))


def powers(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences whose lengths are falling powers of two, from *parts* in order."""
    parts, out = parts[::-1], []
    total = sum(p[2] for p in parts)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        row = []
        while room:
            i, begin, length = parts.pop()
            if length > room:
                parts.append((i, begin + room, length - room))
                length = room
            row.append((i, begin, length))
            room -= length
        out.append(row)
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    window: int = WINDOW,
    shard_tokens: int = 1 << 20,
    range_tokens: int = 32 << 20,
    max_ranges: int = 20_000,
) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and *end_id*; a null or empty text is *end_id* alone. Every id is in
    exactly one piece. Sequences are full windows without padding but for the last ids of each range, less
    than a window, which become sequences of power-of-two lengths. Rows that repeat are packed each, whatever their
    ids; where scores tie, pieces follow by their rarest words and then as they were read. Other columns may have any
    name. An empty table gives no rows. A task holds *shard_tokens* ids and what was left over before.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    from tokenizers import Tokenizer

    size = max(end_id, *Tokenizer.from_file(vocabulary_path(vocabulary)).get_vocab(with_added_tokens=True).values()) + 1
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    table = stage_table(pieces(docs, id_col, text_col, vocabulary, end_id, window, dtype), "pieces")
    width = np.dtype(dtype).itemsize
    real = table.filter("doc_tokens IS NOT NULL")
    # A row an id of the vocabulary comes to the driver.
    df = np.zeros(size)
    for r in table.filter("doc_tokens IS NULL").groupBy("k1").agg(F.sum("start").alias("n")).collect():
        df[r["k1"]] = r["n"]
    is_tail = F.octet_length("ids") < window * width
    known = real.agg(F.sum(F.when(F.col("start") == 0, 1)).alias("docs"), F.sum(F.when(is_tail, F.octet_length("ids") / width)).alias("tokens"), F.count(F.when(is_tail, 1)).alias("tails")).first()
    n_docs, tokens, tails = known["docs"] or 0, int(known["tokens"] or 0), known["tails"]
    idf = spark.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))
    mean = tokens / max(1, tails)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(max_ranges, tokens // range_tokens))
    keys = ["k1", "k2", "k3", "tie"]
    tail = real.filter(is_tail).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def wide(part) -> bytes:
        return part.astype("<u4").tobytes()

    def heads(batches):
        for whole in batches:
            for b in slices(whole, 3, 1024, 8 << 20):
                ids = [wide(np.frombuffer(x, dtype)) for x in b.column(3).to_pylist()]
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([window] * n, pa.int64()), pa.array(ids, pa.binary()), b.column(1), b.column(4), pa.array([0] * n, pa.int64())], names)

    def tails_of(batches):
        sequence = 2 * (TaskContext.get().partitionId() << 33)
        held: list[tuple] = []  # (id, doc_tokens, start, ids)
        of = None

        def packed(rows):
            nonlocal sequence
            for lo in range(0, len(rows), 256):
                got = rows[lo : lo + 256]
                flat = [(*held[i], begin, length, at) for row in got for (i, begin, length), at in zip(row, accumulate([0, *(p[2] for p in row)]))]  # noqa: B905
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in flat], of),
                        pa.array([x[2] + x[4] for x in flat], pa.int64()),
                        pa.array([x[5] for x in flat], pa.int64()),
                        pa.array([wide(x[3][x[4] : x[4] + x[5]]) for x in flat], pa.binary()),
                        pa.array([x[1] for x in flat], pa.int64()),
                        pa.array([sequence + 2 * k for k, row in enumerate(got) for _ in row], pa.int64()),
                        pa.array([x[6] for x in flat], pa.int64()),
                    ],
                    names,
                )
                sequence += 2 * len(got)

        def shard():
            full, rest = fill([h[3] for h in held], idf.value, mean, window)
            yield from packed(full)
            # Leftovers are the first pieces of the next shard.
            held[:] = [(held[i][0], held[i][1], held[i][2] + begin, held[i][3][begin : begin + length]) for i, begin, length in rest]

        size_ = 0
        for whole in batches:
            of = whole.schema.field(0).type
            for b in slices(whole, 3, 1024, 4 << 20):
                for row in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                    held.append((*row[:3], np.frombuffer(row[3], dtype)))
                    size_ += len(held[-1][3])
                    if size_ >= shard_tokens:
                        yield from shard()
                        size_ = sum(len(h[3]) for h in held)
        if held:
            yield from shard()
            if held:
                yield from packed(powers([(i, 0, len(h[3])) for i, h in enumerate(held)]))

    columns = ["id", "doc_tokens", "start", "ids"]
    one = real.filter(~is_tail).select(*columns, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id")).mapInArrow(heads, schema)
    return one.unionByName(tail.select(*columns).mapInArrow(tails_of, schema))
