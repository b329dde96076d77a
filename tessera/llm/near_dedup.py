"""Near duplicates: MinHash signatures in a multi-index Hamming join, links confirmed on full shingle sets.

A signature is 48 minima of 16 bits, four to a 64-bit chunk. Two signatures that differ in at most
``chunks * (errors + 1) - 1`` places have a chunk with at most *errors* differing places (pigeonhole). Each
chunk is indexed once for every choice of places that may differ, with those places masked, so all pairs
within that distance share a key. At similarity 0.8, 23 of 48 places are exceeded about once in 10^5 links.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import frugal, known_texts, shuffled, stage_table

CHUNKS, LANES = 12, 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.Generator(np.random.PCG64(20_2)).integers(1, 1 << 63, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, n: int) -> set[bytes]:
    """Distinct n-word shingles after lower-casing A-Z; with fewer words all of them as one; without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHash(dict):
    """64-bit word hashes, kept for at most *most* words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: bytes) -> int:
        v = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) < self.most:
            self[w] = v
        return v


def signature(words: list[bytes], n: int, get) -> tuple[int, bytes, np.ndarray] | None:
    """Set size, digest of the set and packed minima of a text's words; None without words."""
    if not words:
        return None
    h = np.fromiter(map(get, words), np.uint64, len(words))
    if len(h) > n:
        m = len(h) - n + 1
        s = h[:m].copy()
        for k in range(1, n):
            s = _mix(s) * _ODD + h[k : m + k]
    else:
        s = h[:1].copy()
        for k in range(1, len(h)):
            s = _mix(s) * _ODD + h[k : k + 1]
    s = np.unique(_mix(s))
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    low = np.full(len(_SALT), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        z = s[i : i + 4096, None] * _SALT
        z ^= z >> np.uint64(31)
        low = np.minimum(low, z.min(0))
    places = (_mix(low) & np.uint64(0xFFFF)).reshape(CHUNKS, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(16))
    return len(s), digest, np.bitwise_or.reduce(places, 1).view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Per row: id, n_shingles, digest, sig (array of 12 longs); digest and sig are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        get = WordHash().__getitem__
        for b in batches:
            got = [signature((t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), n, get) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g[0] if g else 0 for g in got], pa.int64()),
                    pa.array([g[1] if g else None for g in got], pa.binary()),
                    pa.array([g[2] if g else None for g in got], pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "digest", "sig"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), f"id {kind}, n_shingles long, digest binary, sig array<long>")


def _unlike(a: Column, b: Column) -> Column:
    """Number of places in which two packed signatures differ."""
    # A lane of 16 bits in a slot of 32 carries into the slot's next bit, if 0xFFFF is added, unless it is 0. The chunk is
    # named twice, not sixteen times as when bits are folded: this expression is in several plans of each turn.
    lane, carry = 0x0000FFFF0000FFFF, 0x0001000000010000
    total = F.lit(0)
    for c in range(CHUNKS):
        x = a[c].bitwiseXOR(b[c])
        low, high = ((y.bitwiseAND(F.lit(lane)) + F.lit(lane)).bitwiseAND(F.lit(carry)) for y in (x, F.shiftrightunsigned(x, 16)))
        total = total + F.bit_count(low.bitwiseOR(F.shiftrightunsigned(high, 1)))
    return total


def keys(classes: DataFrame, errors: int) -> DataFrame:
    """Index rows (k, v, rep): chunk and masked places, the chunk's other places, class."""
    out = []
    for c in range(CHUNKS):
        for i, gone in enumerate(combinations(range(LANES), errors)):
            mask = 0
            for g in gone:
                mask |= 0xFFFF << (16 * g)
            keep = ~mask & 0xFFFFFFFFFFFFFFFF
            keep -= (keep >> 63) << 64
            out.append(F.struct(F.lit(c * 100 + i).alias("k"), F.col("sig")[c].bitwiseAND(F.lit(keep)).alias("v")))
    return classes.select("rep", F.explode(F.array(*out)).alias("x")).select("x.k", "x.v", "rep")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Those of *pairs* (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = stage_table(pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct(), "ids")
    texts = stage_table(known_texts(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")), ids, id_col).dropDuplicates([id_col]), "texts")
    both = pairs.join(shuffled(texts.select(F.col(id_col).alias("b"), F.col("t").alias("tb"))), "b")
    both = both.join(shuffled(texts.select(F.col(id_col).alias("a"), F.col("t").alias("ta"))), "a")

    def run(batches):
        last, held = None, set()
        for b in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if a != last:
                    last, held = a, shingles(ta, n)
                other = shingles(tb, n)
                common = len(held & other)
                if 100 * common >= percent * (len(held) + len(other) - common) and other:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(frugal(run), "a long, b long")


def forests(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) with the same components: every task ties the vertices of its edges to their least."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        tied = [(v, r) for v in list(parent) if (r := find(v)) != v]
        for i in range(0, len(tied), 50_000):
            part = tied[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in part], pa.int64()), pa.array([t[1] for t in part], pa.int64())], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, task_edges: int = 200_000) -> DataFrame:
    """(v, root), a stage table: the smallest vertex reachable from each vertex of *edges* (a, b) but the smallest itself.

    Tasks of about *task_edges* edges first contract their share to stars; where that took one task, it is
    the result. Else alternating large- and small-star steps go on until nothing changes, each written to
    the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: each vertex ties its larger neighbours to the least of all; small: the smaller ones.
        d = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = d.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = d.join(shuffled(low), "a")
        if large:
            return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))

    tidy = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
    now = stage_table(tidy(edges), "edges")
    parts = max(1, -(-now.count() // task_edges))
    now = stage_table(forests(now, parts), "forests")
    if parts == 1:
        return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    seen = mark(now)
    while seen[0]:
        now = stage_table(tidy(star(stage_table(tidy(star(now, True)), "edges"), False)), "edges")
        if (after := mark(now)) == seen:
            break
        seen = after
    return stage_table(now.select(F.col("a").alias("v"), F.col("b").alias("root")).groupBy("v").agg(F.min("root").alias("root")), "components")


def nearest_leads(rows: DataFrame, info: DataFrame, turn: int, alike) -> DataFrame:
    """(a, b): for every class of bucket rows (k, v, rep, comp) the nearest of its buckets' leads that is in
    another component. A bucket's lead is its least class by a hash that changes with *turn*."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "comp") if turn else F.struct(F.lit(0), "rep", "comp")
    lead = rows.groupBy("k", "v").agg(F.min(order).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    lead = lead.select("k", "v", F.col("l.rep").alias("lead"), F.col("l.comp").alias("its"))
    star = rows.join(shuffled(lead), ["k", "v"]).filter("comp <> its").select("rep", "lead").distinct()
    p, q = info.alias("p"), info.alias("q")
    star = star.join(shuffled(p), F.col("p.rep") == star["rep"]).join(shuffled(q), F.col("q.rep") == star["lead"])
    star = star.filter(alike({c: F.col(f"p.{c}") for c in ("n", "sig")}, {c: F.col(f"q.{c}") for c in ("n", "sig")}))
    near = F.struct(_unlike(F.col("p.sig"), F.col("q.sig")).alias("d"), F.col("q.rep").alias("a"))
    best = star.select(F.col("p.rep").alias("b"), near.alias("near")).groupBy("b").agg(F.min("near").alias("near"))
    return best.select(F.least("near.a", "b").alias("a"), F.greatest("near.a", "b").alias("b")).distinct()


def cells(open_: DataFrame, size: int) -> DataFrame:
    """*open_* with the cells (i, j) of its bucket that a row takes part in, and ``block``, its own.

    A bucket of up to 2 * *size* rows is one cell. The rows of a larger one are dealt by a hash to blocks of
    about *size*: 0, 1 .. for those outside the main component, -1, -2 .. for the main one's. Each pair of
    blocks, but for two main ones, is a cell, so a cell has about 2 * *size* rows at most and every pair of rows
    that must be compared has its cell. Rows: k, v, rep, comp, main, others, mains (numbers of either kind)."""
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("int")
    one, out = F.col("others") + F.col("mains") <= 2 * size, F.col("comp") != F.col("main")
    own = F.pmod(F.xxhash64("rep"), F.when(out, blocks("others")).otherwise(blocks("mains"))).cast("int")
    rows = open_.withColumn("block", F.when(one, 0).when(out, own).otherwise(-1 - own))
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    b = F.col("block")
    with_others = F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda x: cell(F.least(b, x), F.greatest(b, x)))
    with_mains = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(1), blocks("mains")), lambda x: cell(b, -x))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    for_main = F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda x: cell(x, b))
    all_ = F.when(one, F.array(cell(F.lit(0), F.lit(0)))).when(out, F.concat(with_others, with_mains)).otherwise(for_main)
    return rows.withColumn("cell", F.explode(all_)).select("*", "cell.i", "cell.j").drop("cell")


def candidates(open_: DataFrame, percent: int, errors: int, size: int = 1_000) -> DataFrame:
    """(y, xs): for classes of buckets that hold several components, those classes outside the bucket's main
    component that they may be linked with, as packed ids. Rows: k, v, rep, comp, main, others, mains, n, sig.

    The rows of a bucket's cell (:func:`cells`) meet in one task, those outside the main component first, by
    id, so that each meets all lesser ones in whatever batches they come; the rest stream by. Pairs are
    compared there by signature and size and stay packed, a row for each class and cell, never a pair."""
    most = CHUNKS * (errors + 1) - 1

    def run(batches):
        key, xs = None, []
        for b in batches:
            k, v, ci, cj, block, rep, comp, main, n = (b.column(i).to_numpy() for i in range(9))
            sig = b.column(9).flatten().to_numpy().reshape(-1, CHUNKS).view(np.uint16)
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(ci) != 0) | (np.diff(cj) != 0)) + 1
            out_y, out_x = [], []
            for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(k)).tolist(), strict=True):
                if hi == lo:
                    continue
                if (k[lo], v[lo], ci[lo], cj[lo]) != key:
                    key, xs = (k[lo], v[lo], ci[lo], cj[lo]), []
                out = np.flatnonzero(comp[lo:hi] != main[lo:hi]) + lo
                if len(out):
                    xs.append((rep[out], comp[out], n[out], sig[out], block[out]))
                if not xs:
                    continue
                xr, xc, xn, xsig, xb = (np.concatenate(c) for c in zip(*xs, strict=True))
                for i in range(lo, hi):
                    ok = (xc != comp[i]) & (100 * np.minimum(xn, n[i]) >= percent * np.maximum(xn, n[i]))
                    if comp[i] != main[i]:
                        ok &= xr < rep[i]
                        if ci[i] != cj[i]:  # pairs within a block have a cell of their own
                            ok &= xb != block[i]
                    at = np.flatnonzero(ok)
                    if len(at):
                        same = xsig[at] == sig[i]
                        near = same.sum(1) >= CHUNKS * LANES - most
                        if errors == 1:  # a pair counts in the first bucket that it shares
                            lanes = same.reshape(-1, CHUNKS, LANES)
                            chunk = (lanes.sum(2) >= LANES - 1).argmax(1)
                            which = lanes[np.arange(len(at)), chunk]
                            near &= chunk * 100 + np.where(which.all(1), 0, (~which).argmax(1)) == k[i]
                        at = at[near]
                        if len(at):
                            out_y.append(rep[i])
                            out_x.append(xr[at].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_y, pa.int64()), pa.array(out_x, pa.binary())], ["y", "xs"])

    rows = cells(open_, size).repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", F.col("comp") == F.col("main"), "rep")
    rows = rows.select("k", "v", "i", "j", "block", "rep", "comp", "main", "n", "sig").mapInArrow(run, "y long, xs binary")
    return rows.groupBy("y").agg(F.collect_list("xs").alias("xs"))


def confirm_blocks(cands: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, block: int = 400) -> DataFrame:
    """Links (a, b) among packed candidates. The classes that are asked for go in blocks of about *block*;
    a task holds the sets of one block, and the classes with candidates in it pass by, once each."""
    def split(batches):
        for b in batches:
            ys, blocks, parts = [], [], []
            for y, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.unique(np.frombuffer(b"".join(xs), "<i8"))
                home = x % count
                for h in np.unique(home).tolist():
                    ys.append(y)
                    blocks.append(h)
                    parts.append(x[home == h].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int64()), pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], ["id", "home", "xs"])

    def asked(batches):
        for b in batches:
            x = np.unique(np.frombuffer(b"".join(p for xs in b.column(1).to_pylist() for p in xs), "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(x)], ["id"])

    wanted = stage_table(cands.mapInArrow(asked, "id long").distinct(), "asked")
    count = max(1, -(-wanted.count() // block))
    ids = stage_table(cands.select(F.col("y").alias(id_col)).unionByName(wanted.select(F.col("id").alias(id_col))).distinct(), "ids")
    texts = known_texts(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")), ids, id_col).dropDuplicates([id_col])
    texts = stage_table(texts.withColumnRenamed(id_col, "id"), "texts")
    ys = cands.mapInArrow(split, "id long, home long, xs binary").join(shuffled(texts), "id").select("home", F.lit(1).alias("ask"), "id", "xs", "t")
    xs = wanted.join(shuffled(texts), "id").select(F.pmod("id", F.lit(count)).alias("home"), F.lit(0).alias("ask"), "id", F.lit(None).cast("binary").alias("xs"), "t")
    rows = xs.unionByName(ys).repartition("home").sortWithinPartitions("home", "ask")

    def run(batches):
        home, sets = None, {}
        for b in batches:
            a_, b_ = [], []
            for h, ask, i, x, t in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if h != home:
                    home, sets = h, {}
                own = shingles(t, n)
                if not ask:
                    sets[i] = own
                    continue
                for j in np.frombuffer(x, "<i8").tolist():
                    other = sets[j]
                    small, large = sorted((len(own), len(other)))
                    if 100 * small >= percent * large:
                        common = len(own & other)
                        if 100 * common >= percent * (small + large - common):
                            a_.append(min(i, j))
                            b_.append(max(i, j))
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return rows.mapInArrow(frugal(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, errors: int = 1, turns: int = 3) -> DataFrame:
    """Per row of *docs*: id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of n-word shingles.
    1. Equal sets are one class (its smallest id stands for it), so copies never multiply.
    2. *turns* times every class is compared with one lead in each of its buckets, and the nearest that is
       in another component is confirmed. This joins most of what belongs together, at a pair a class.
    3. Buckets that still hold several components are searched whole: every class outside a bucket's main
       component meets all classes of other components there, large buckets block by block. Nothing is
       capped; what is left out are pairs already connected. Candidates stay packed and are confirmed block by block.
    All confirmations use the full sets.

    Null or empty texts and texts without words have the empty set, linked with nothing. Null ids stand
    alone too, without a component, and are kept. Ids are integers. Rows that repeat an id are one document, with one row's text in a link's
    confirmation. An empty table gives no rows.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint"):
        raise TypeError("ids must be integers")
    feats = stage_table(features(docs, id_col, text_col, n), "features")
    classes = feats.filter("digest is not null and id is not null").groupBy("digest", "n_shingles", "sig").agg(F.min("id").cast("long").alias("rep"))
    classes = stage_table(classes, "classes")
    most = CHUNKS * (errors + 1) - 1
    alike = lambda p, q: (
        (100 * F.least(p["n"], q["n"]) >= percent * F.greatest(p["n"], q["n"])) & (_unlike(p["sig"], q["sig"]) <= most)
    )
    info = classes.select("rep", F.col("n_shingles").alias("n"), "sig")
    index = keys(classes, errors)
    company = index.groupBy("k", "v").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("k", "v")
    rows = stage_table(index.join(shuffled(company), ["k", "v"]), "buckets")
    marked, roots = rows.withColumn("comp", F.col("rep")), None
    # What is known so far goes on as stars, an edge for each class that is tied: it has the components of all links.
    tied = lambda found: found if roots is None else found.unionByName(roots.select(F.col("v").alias("a"), F.col("root").alias("b")))
    for turn in range(turns):
        found = confirm(stage_table(nearest_leads(marked, info, turn, alike), "star"), docs, id_col, text_col, n, percent)
        roots = components(tied(found))
        marked = rows.join(shuffled(roots), rows["rep"] == roots["v"], "left").select("k", rows["v"], "rep", F.coalesce("root", "rep").alias("comp"))
    sizes = marked.groupBy("k", "v", "comp").agg(F.count(F.lit(1)).alias("c"))
    large = F.max(F.struct("c", "comp"))
    mixed = sizes.groupBy("k", "v").agg(F.count(F.lit(1)).alias("parts"), large.alias("m"), F.sum("c").alias("all")).filter("parts > 1")
    mixed = mixed.select("k", "v", F.col("m.comp").alias("main"), F.col("m.c").alias("mains"), (F.col("all") - F.col("m.c")).alias("others"))
    open_ = marked.join(shuffled(mixed), ["k", "v"]).join(shuffled(info), "rep")
    cands = stage_table(candidates(open_, percent, errors), "candidates")
    late = stage_table(confirm_blocks(cands, docs, id_col, text_col, n, percent), "late")
    if late.head(1):
        roots = components(tied(late))
    by_set = classes.join(shuffled(roots), classes["rep"] == roots["v"], "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = feats.select("id", "n_shingles", "digest").join(shuffled(by_set), "digest", "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, most: int = 500_000) -> DataFrame:
    """The rows of *docs*, all columns (of any names), that stand for their component: those of its smallest
    id, every one that repeats it. Rows of null id stay. Empty texts are linked with nothing and stay. The ids that go are broadcast if a count shows at most *most* of them."""
    gone = stage_table(near_duplicates(docs, id_col, text_col, n, percent).filter("not kept").select(F.col(id_col).alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= most else shuffled(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
