"""Byte-level BPE: a minimal acyclic transducer of frequent words, exact merges for all others."""

from __future__ import annotations

import array
import heapq
import json
import mmap
import os
import re
import shutil
import struct
import tempfile
from collections import Counter
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import by_units, split
from tessera.llm.store import frugal, new_path, slices, stage_table

VOCABULARY = "byte_bpe_50k.json"
# White space as the pattern's \s has it, and the vocabulary's word pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RUN = re.compile(f" (?=[{_SPACE}]|\\Z)")
#: Marks that form one word at the end of a unit whatever letter is before them (an apostrophe may not).
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_CUT = re.compile(f"(?= [^{_SPACE}])")
#: Arrow's pattern of what may follow a blank that begins no unit: nothing, or a space.
ODD = "^(?:$|[" + re.sub(r"\\u(....)", r"\\x{\1}", _SPACE) + "])"
WORDS = _WORDS.findall


def vocabulary_path(name: str) -> str:
    """*name* if it is a file's path, else the place of the public tokenizer file of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """*text* cut before every blank that a non-space follows. No word of the pattern crosses a cut, as
    such a blank belongs to what follows it; so units can be encoded one by one."""
    if _RUN.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + u for u in rest]] if first else [" " + u for u in rest]


def byte_letters() -> str:
    """The letter that stands for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return "".join(chr(b if b in set(shown) else next(free)) for b in range(256))


class Merges:
    """Ranks and ids of a byte-level BPE file."""

    def __init__(self, name: str = VOCABULARY):
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.table = {b: self.letters[b] for b in range(256)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(self.letters)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in self.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank, the first of equals, is merged until none is left."""
        text = word.decode("latin-1")
        # Printable ASCII stands for itself.
        parts = list(text.replace(" ", self.letters[32]) if word.isascii() and text.isprintable() else text.translate(self.table))
        if len(parts) > 48:
            return self._encode_long(parts)
        rank, none = self.ranks.get, 1 << 60
        ranks = list(map(rank, zip(parts, parts[1:]), repeat(none)))  # noqa: B905
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return [self.ids[p] for p in parts]

    def _encode_long(self, parts: list[str]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [self.ids[p] for p in parts if p]


class Lexicon:
    """Words with ids in a minimal acyclic automaton, read from a memory map.

    States with equal endings are shared. Every transition carries how many words come before those
    beyond it, so the sum along a word's path is its place in sorted order, and that place has its ids.
    """

    MAGIC = b"TSLX0001"

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != self.MAGIC:
            raise ValueError(f"{path} is no lexicon")
        states, moves, words, ids = struct.unpack_from("<4I", self.map, 8)
        view, at = memoryview(self.map), 24
        sizes = {"first": states + 1, "target": moves, "skip": moves, "offsets": words + 1, "ids": ids}
        for name, n in sizes.items():
            setattr(self, name, view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.final, at = view[at : at + states], at + states
        self.labels = bytes(view[at : at + moves])  # a byte a transition; searching bytes is quicker than a map

    def find(self, word: bytes) -> list[int] | None:
        state, place, find, first, target, skip = 0, 0, self.labels.find, self.first, self.target, self.skip
        for c in word:
            t = find(c, first[state], first[state + 1])
            if t < 0:
                return None
            place += skip[t]
            state = target[t]
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist() if self.final[state] else None

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> bytes:
        """The file of a lexicon. Words are added in order; what the next word can't extend any more is
        replaced by an equal state if there is one."""
        known: dict[tuple, int] = {}
        finished: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # the last word's states: [final, [(label, state)]]

        def close(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                final, moves = path.pop()
                key = (final, tuple(moves))
                if key not in known:
                    known[key] = len(finished)
                    finished.append(key)
                path[-1][1].append((word[len(path) - 1], known[key]))

        last, words = b"", sorted(entries)
        for w in words:
            same = len(os.path.commonprefix([last, w]))
            close(same, last)
            path.extend([False, []] for _ in w[same:])
            path[-1][0] = True
            last = w
        close(0, last)
        finished.append((path[0][0], tuple(path[0][1])))
        n = len(finished)  # the root is the last; it gets number 0
        count = [0] * n
        for s, (final, moves) in enumerate(finished):
            count[s] = final + sum(count[t] for _, t in moves)
        first, target, skip, labels = [0], [], [], bytearray()
        for s in range(n - 1, -1, -1):
            final, moves = finished[s]
            before = int(final)
            for label, t in moves:
                labels.append(label)
                target.append(n - 1 - t)
                skip.append(before)
                before += count[t]
            first.append(len(labels))
        ids = [entries[w] for w in words]
        offsets = [0, *accumulate(len(x) for x in ids)]
        flat = [i for x in ids for i in x]
        out = cls.MAGIC + struct.pack("<4I", n, len(labels), len(words), len(flat))
        for part in (first, target, skip, offsets, flat):
            out += array.array("I", part).tobytes()
        return out + bytes(finished[s][0] for s in range(n - 1, -1, -1)) + bytes(labels)


class Units(dict):
    """Little-endian int32 ids of text units that follow a blank, as bytes, kept for at most half of *most* units without
    that blank; their words, *most* of which are kept as well, come from the lexicon, and those it doesn't have are merged."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None, most: int):
        super().__init__()
        self.merges, self.lexicon, self.most = merges, lexicon, most
        self.words: dict[str, bytes] = {}

    def __missing__(self, u: str) -> bytes:
        v = self.ids_of(" " + u)
        if len(self) < self.most // 2:
            self[u] = v
        return v

    def ids_of(self, u: str) -> bytes:
        """Ids of a whole unit, with its blank if it has one."""
        # Letters, with a blank before, are one word; so are marks after them.
        core = u.rstrip(MARKS)
        words = [core, u[len(core) :]] if (core[1:] if core[:1] == " " else core).isalpha() else _WORDS.findall(u)
        return b"".join(self.words.get(w) or self.word(w) for w in words if w)

    def word(self, w: str) -> bytes:
        raw = w.encode("utf-8", "replace")
        v = array.array("i", (self.lexicon.find(raw) if self.lexicon else None) or self.merges.encode(raw)).tobytes()
        if len(self.words) < self.most:
            self.words[w] = v
        return v


class Encoder:
    """Ids of whole texts as little-endian int32 bytes, and back."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None, most: int = 800_000):
        self.merges, self.units = merges, Units(merges, lexicon, most)
        self.get = self.units.__getitem__
        # A token's bytes at its id's place.
        self.bytes_at = pa.array([merges.bytes_of.get(i, b"") for i in range(max(merges.bytes_of) + 1)], pa.large_binary())

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of all *texts*, one after the other, and where each one's begin; null is empty."""
        return by_units(texts, lambda found: list(map(self.get, found)), self, list(self.merges.special), self.units.ids_of, ODD)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids between each two *ends*."""
        laid = self.bytes_at.take(pa.array(ids))
        at = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1][ends].tolist()
        data = (laid.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]  # noqa: B905

    def __call__(self, text: str) -> bytes:
        special = self.merges.special
        if self.merges.split and any(t in text for t in special):
            parts = (p for p in self.merges.split.split(text) if p)
            return b"".join(struct.pack("<i", special[p]) if p in special else self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens; see :func:`units` for where it may be cut."""
        if _RUN.search(text):
            return b"".join(self.get(u[1:]) if u[:1] == " " else self.units.ids_of(u) for u in _CUT.split(text))
        first, *rest = text.split(" ")
        return (self.units.ids_of(first) if first else b"") + b"".join(map(self.get, rest))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes_of.__getitem__, memoryview(ids).cast("i"))).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = 65_536, local: int = 40_000) -> list[str]:
    """The commonest words of all texts, by the pattern, at most *words*; ties in code point order.

    Every task counts the units of its texts and passes on the counts of all their words, at the end and
    whenever it holds more than 10 * *local* units; Spark adds them up, so counts are exact. At most 4 * *words*
    rows come to the driver.
    """

    def run(batches):
        forget()
        seen: Counter[str] = Counter()  # units without the blank before them
        others: Counter[str] = Counter()  # units as they are

        def counted():
            for some, blank in ((seen, " "), (others, "")):
                while some:
                    found: Counter[str] = Counter()
                    for u, n in (some.popitem() for _ in range(min(10_000, len(some)))):
                        core = u.rstrip(MARKS)
                        for w in [blank + core, u[len(core) :]] if core.isalpha() else _WORDS.findall(blank + u):
                            if w:
                                found[w] += n
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["u", "n"])

        for whole in batches:
            for b in slices(whole, 0, 4096, 8 << 20):
                texts = b.column(0).cast(pa.large_string()).fill_null("")
                names, places, size, heads, apart = split(texts, True, ODD)
                found = np.bincount(places[~np.repeat(apart, size)], minlength=len(names)).tolist()
                for u, n in zip(names, found, strict=True):
                    if n:
                        seen[u] += n
                others.update(h for h, other in zip(heads, apart.tolist(), strict=True) if h and not other)
                for i in np.flatnonzero(apart).tolist():
                    others.update(units(texts[i].as_py()))
                if len(seen) + len(others) > 10 * local:
                    yield from counted()
        yield from counted()

    counts = stage_table(docs.select(text_col).mapInArrow(frugal(run), "u string, n long").groupBy("u").agg(F.sum("n").alias("n")), "words")
    # How many words have a count from 2^k on tells which can be among the first; those few go to few tasks, as
    # every task sends its own first *words* to the driver.
    left, least = words, 1
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect(), reverse=True):
        left, least = left - r["count"], 2 ** r["k"]
        if left <= 0:
            break
    top = counts.filter(F.col("n") >= least).coalesce(4).orderBy(F.desc("n"), "u").limit(words)
    return [r["u"] for r in sorted(top.collect(), key=lambda r: (-r["n"], r["u"]))]


def build_lexicon(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, words: int = 65_536) -> str:
    """Compile the frequent words of *docs* into a lexicon file in the shared folder; its path."""
    merges = Merges(vocabulary)
    data = Lexicon.compile({w.encode("utf-8", "replace"): merges.encode(w.encode("utf-8", "replace")) for w in frequent_words(docs, text_col, words)})
    path = new_path(docs.sparkSession, "lexicon")
    files, inner = _at(path)
    with files.open_output_stream(inner) as f:
        f.write(data)
    return path


def _at(path: str):
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[6:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


_opened: dict[tuple[str, str], Encoder] = {}


def opened(vocabulary: str, lexicon: str | None) -> Encoder:
    """A worker's encoder. Lexicons on a local or mounted path are mapped in place, others (a few MB) after a copy."""
    key = (vocabulary, lexicon or "")
    if key not in _opened:
        _opened.clear()
        found = None
        if lexicon:
            files, inner = _at(lexicon)
            if isinstance(files, pafs.LocalFileSystem):
                found = Lexicon(inner)
            else:
                with files.open_input_stream(inner) as f, tempfile.NamedTemporaryFile() as copy:
                    shutil.copyfileobj(f, copy)
                    copy.flush()
                    found = Lexicon(copy.name)
        _opened[key] = Encoder(Merges(vocabulary), found)
    return _opened[key]


def forget() -> None:
    """Free what a worker keeps of an earlier lexicon and its words. By name, as tasks get copies of globals."""
    _opened.clear()


def encode(docs: DataFrame, lexicon: str | None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rows: int = 256, keep: list[str] | None = None) -> DataFrame:
    """Per row of *docs*: id, columns *keep*, ids (those of the vocabulary's own library), decoded (text of the ids).

    A null or empty text has no ids and decodes to the empty text. Special tokens' names in a text are
    those tokens, as the library has it. Whole texts; rows that repeat are encoded each. An empty table
    gives no rows. Work goes in parts of *rows* rows, which bounds a worker's memory.
    """
    keep = keep or []
    types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        e = opened(vocabulary, lexicon)
        for whole in batches:
            for b in slices(whole, 1, 16 * rows, 8 << 20):
                data, at = e.batch(b.column(1))
                for lo in range(0, b.num_rows, rows):
                    part, ends = b.slice(lo, rows), at[lo : lo + rows + 1]
                    ids, ends = data[ends[0] : ends[-1]].view("<i4"), (ends - ends[0]) // 4
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], lists, pa.array(e.decode_all(ids, ends), pa.string())], ["doc_id", *keep, "ids", "decoded"])

    return docs.select(F.col(id_col), F.col(text_col), *keep).mapInArrow(frugal(run), f"doc_id {kind}{types}, ids array<int>, decoded string")
