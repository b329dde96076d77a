"""A Merkle manifest of a dataset: a tree of digests for each group, one tree over the groups' roots, and proofs.

Leaves are range-sorted by (group, order); counting the groups of every partition gives each leaf its place in its
group. A partition then builds all complete aligned subtrees of its leaves by itself. Nodes whose parent needs
leaves of another partition are the ragged rest, a few for each partition and level; they are shuffled by
coordinate and finished in bands of nine levels, a task never holding more than the nodes below one node nine levels
up. On the way back every such node gets its path to the root, and each partition joins its leaves' own paths to it.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import id_crc, stage_table  # noqa: F401

ARITY, BAND = 3, 9
PATH = "array<struct<left:string,right:string>>"


def join_digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*cols: Column) -> Column:
    """Hex SHA-256 of the values one after the other: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = [c.cast("string") for c in cols]
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def width(leaves: int, level: int) -> int:
    """How many nodes a tree of *leaves* has on a level."""
    return -(-leaves // ARITY**level)


def climb(start: int, leaves: list[str], ended: bool) -> list[tuple[int, list[str]]]:
    """(first place, digests) of each level that consecutive leaves, all within one aligned block of 3^9,
    determine alone; *ended* tells that the group's last leaf is among them."""
    levels = [(start, leaves)]
    while len(levels) <= BAND:
        a, digests = levels[-1]
        b = a + len(digests)
        if ended and b == 1:
            break
        lo, hi = -(-a // ARITY), -(-b // ARITY) if ended else b // ARITY
        if hi <= lo:
            break
        levels.append((lo, [join_digest(digests[ARITY * k - a : ARITY * k + ARITY - a]) for k in range(lo, hi)]))
    return levels


def _covered(levels: list, level: int) -> range:
    """Places of a level whose parent is known."""
    if level + 1 == len(levels):
        return range(0)
    a, above = levels[level + 1]
    return range(ARITY * a, ARITY * (a + len(above)))


def peaks(levels: list[tuple[int, list[str]]]):
    """(level, place, digest) of the nodes without a known parent."""
    for level, (a, digests) in enumerate(levels):
        known = _covered(levels, level)
        yield from ((level, q, d) for q, d in enumerate(digests, a) if q not in known)


def _sides(digests: list[str], i: int, k: int, a: int) -> tuple[str, str]:
    """Digests left and right of entry *i* in the run of parent *k*; the entries begin at place *a*."""
    return "".join(digests[ARITY * k - a : i]), "".join(digests[i + 1 : ARITY * k + ARITY - a])


def leaf_paths(levels: list[tuple[int, list[str]]]) -> list[tuple[tuple[int, int], tuple]]:
    """For each leaf: (level, place) of the peak above it, and the siblings (left, right) up to that peak."""
    above: list = []
    for level in range(len(levels) - 1, -1, -1):
        a, digests = levels[level]
        known = _covered(levels, level)
        here = []
        for i, q in enumerate(range(a, a + len(digests))):
            if q in known:
                k = q // ARITY
                peak, path = above[k - levels[level + 1][0]]
                here.append((peak, (_sides(digests, i, k, a), *path)))
            else:
                here.append(((level, q), ()))
        above = here
    return above


def finish(nodes: list[tuple[int, int, str]], leaves: int, low: int) -> tuple[tuple[int, int, str], list[tuple]]:
    """The node that *nodes* (level, place, digest) end in, *BAND* levels above *low* or the root of a tree
    of so many leaves, and each node's siblings up to it. Nodes that are missing are an error."""
    have: dict[int, dict[int, str]] = {}
    for level, q, d in nodes:
        have.setdefault(level, {})[q] = d
    top = low
    while top < low + BAND and width(leaves, top) > 1:
        here, n = have.get(top, {}), width(leaves, top)
        for k in sorted({q // ARITY for q in here}):
            run = range(ARITY * k, min(ARITY * k + ARITY, n))
            if lost := [q for q in run if q not in here]:
                raise ValueError(f"nodes {lost} of level {top} are missing")
            have.setdefault(top + 1, {})[k] = join_digest(here[q] for q in run)
        top += 1
    ((place, digest),) = have[top].items()

    paths: dict[tuple[int, int], tuple] = {(top, place): ()}
    for level in range(top - 1, low - 1, -1):
        here, n = have.get(level, {}), width(leaves, level)
        for q in here:
            k = q // ARITY
            run = range(ARITY * k, min(ARITY * k + ARITY, n))
            sides = "".join(here[x] for x in run if x < q), "".join(here[x] for x in run if x > q)
            paths[level, q] = (sides, *paths[level + 1, k])
    return (top, place, digest), [paths[level, q] for level, q, _ in nodes]


def _path_array(paths: list[tuple]) -> pa.Array:
    ends = [0]
    for p in paths:
        ends.append(ends[-1] + len(p))
    sides = pa.StructArray.from_arrays([pa.array([s[i] for p in paths for s in p], pa.string()) for i in (0, 1)], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)


class Places:
    """Places in their groups of the leaves of a range-sorted RDD of (group, leaf, ...) tuples, from one row a
    partition: its first and last group with their numbers of leaves."""

    def __init__(self, rdd):
        def count(p, rows):
            first = last = None
            n_first = n_last = 0
            for r in rows:
                if r[0] == last:
                    n_last += 1
                else:
                    if last is not None and last == first:
                        n_first = n_last
                    first, last, n_last = r[0] if first is None else first, r[0], 1
            if last is not None:
                yield p, first, n_last if first == last else n_first, last, n_last

        n = rdd.getNumPartitions()
        self.before, self.after = [0] * n, [0] * n
        found = sorted(rdd.mapPartitionsWithIndex(count).collect())
        group, seen = None, 0
        for p, first, n_first, last, n_last in found:
            self.before[p] = seen if first == group else 0
            seen = self.before[p] + n_first if first == last else n_last
            group = last
        group, seen = None, 0
        for p, first, n_first, last, n_last in reversed(found):
            self.after[p] = seen if last == group else 0
            seen = self.after[p] + n_last if first == last else n_first
            group = first

    def blocks(self, p: int, rows):
        """(group, place of the first, rows, ended, leaves of the group or None): consecutive leaves of partition *p* in
        one group and aligned block. The number of leaves comes with a group's last block of the partition."""
        size, group, at, held, begun = ARITY**BAND, None, 0, [], False
        for r in rows:
            if not begun or r[0] != group:
                if held:
                    yield group, at - len(held), held, True, at
                at, group, held = 0 if begun else self.before[p], r[0], []
                begun = True
            elif held and at % size == 0:
                yield group, at - len(held), held, False, None
                held = []
            held.append(r)
            at += 1
        if held:
            yield group, at - len(held), held, not self.after[p], at + self.after[p]


def _ragged(p: int, blocks):
    """(partition, group, leaves, level, place, digest, top) of the peaks of a partition."""
    waiting: list = []
    for group, start, rows, ended, leaves in blocks:
        waiting += peaks(climb(start, [r[1] for r in rows], ended))
        if leaves is not None:
            yield from ((p, group, leaves, level, q, d, width(leaves, level) == 1) for level, q, d in waiting)
            waiting = []


def _finish_band(nodes: DataFrame, low: int) -> DataFrame:
    """All *nodes* of a band with their paths to their node at its upper end (kind 0), and those ends (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        group, leaves, block = table["g"][0], table["leaves"][0].as_py(), table["block"][0]
        given = list(zip(table["level"].to_pylist(), table["place"].to_pylist(), table["digest"].to_pylist(), strict=True))
        (level, place, digest), paths = finish(given, leaves, low)
        n = len(given) + 1
        return pa.table(
            {
                "kind": pa.array([0] * len(given) + [1], pa.int32()), "g": pa.array([group.as_py()] * n, pa.string()), "leaves": pa.array([leaves] * n, pa.int64()),
                "block": pa.array([block.as_py()] * n, pa.int64()), "level": pa.array([x[0] for x in given] + [level], pa.int32()),
                "place": pa.array([x[1] for x in given] + [place], pa.int64()), "digest": pa.array([x[2] for x in given] + [digest], pa.string()),
                "top": pa.array([False] * len(given) + [width(leaves, level) == 1]), "path": _path_array([*paths, ()]),
            }
        )

    high = low + BAND
    block = F.floor(F.col("place") / F.pow(F.lit(float(ARITY)), F.lit(high) - F.col("level"))).cast("long")
    done = nodes.withColumn("block", block).groupBy("g", "block").applyInArrow(
        run, f"kind int, g string, leaves long, block long, level int, place long, digest string, top boolean, path {PATH}"
    )
    return stage_table(done, "merkle-band")


def forest(rows: DataFrame, order: list[str], keep: list[str], over=None) -> DataFrame:
    """*rows* (g, leaf, columns *order* and *keep*; g a string and never null) with subroot and path; see
    :func:`manifest`. *over* makes of (g, subroot) the rows (g, root, path) that every path goes on with."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 1_000_000)
    by = [F.col("g").asc(), *[F.col(c).asc_nulls_first() for c in order], F.col("leaf").asc(), F.col("tie").asc()]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    rdd = ranged.select("g", "leaf", *keep).rdd.map(tuple)
    places = Places(rdd.map(lambda r: r[:1]))

    nodes = rdd.map(lambda r: r[:2]).mapPartitionsWithIndex(lambda p, it: _ragged(p, places.blocks(p, it)))
    known = "part int, g string, leaves long, level int, place long, digest string, top boolean"
    nodes = stage_table(spark.createDataFrame(nodes, known, verifySchema=False), "merkle-nodes")
    largest = nodes.agg(F.max("leaves")).first()[0]
    if largest is None:
        kept = [rows.schema[c] for c in keep]
        return spark.createDataFrame([], f"g string, leaf string, subroot string, root string, path {PATH}").select("g", "leaf", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept], "subroot", "root", "path")

    bands, low, ends = [], 0, nodes.filter("top").select("g", "digest")
    cols = ["g", "leaves", "level", "place", "digest"]
    while width(largest, low) > 1:
        given = nodes.filter(~F.col("top") & F.col("level").between(low, low + BAND - 1)).select(*cols)
        if bands:
            given = given.unionByName(bands[-1].filter("kind = 1 AND NOT top").select(*cols))
        bands.append(_finish_band(given, low))
        ends = ends.unionByName(bands[-1].filter("kind = 1 AND top").select("g", "digest"))
        low += BAND
    ends = ends.withColumnRenamed("digest", "subroot")
    none = F.array().cast(PATH)
    ends = over(ends) if over else ends.select("g", "subroot", F.col("subroot").alias("root"), none.alias("path"))
    ends = stage_table(ends.select("g", "subroot", "root", F.col("path").alias("upper")), "merkle-ends")

    # Down again: each node's path to the root.
    whole, above = [nodes.filter("top").select("g", "level", "place").join(ends, "g").withColumnRenamed("upper", "path")], None
    for band in reversed(bands):
        roots = band.filter("kind = 1").select("g", "block", "level", "place", "top")
        upper = roots.filter("top").select("g", "block").join(ends, "g")
        if above is not None:
            upper = upper.unionByName(roots.filter("NOT top").join(above, ["g", "level", "place"]).select("g", "block", "subroot", "root", F.col("path").alias("upper")))
        below = band.filter("kind = 0").select("g", "block", "level", "place", "path").join(upper, ["g", "block"])
        above = below.select("g", "level", "place", "subroot", "root", F.concat("path", "upper").alias("path"))
        whole.append(above)
    full = whole[0]
    for more in whole[1:]:
        full = full.unionByName(more)
    full = nodes.select("part", "g", "level", "place").join(full, ["g", "level", "place"])

    size, kinds = ARITY**BAND, {c: rows.schema[c].dataType.simpleString() for c in keep}

    def leaves_of(p, it):
        for group, start, some, ended, _ in places.blocks(p, it):
            for i, r in enumerate(some):
                yield (p, group, start // size, 1, start + i, ended, *r[1:])

    listed = "".join(f", `{c}` {k}" for c, k in kinds.items())
    leaves = spark.createDataFrame(rdd.mapPartitionsWithIndex(leaves_of), f"part int, g string, block long, kind int, place long, ended boolean, leaf string{listed}", verifySchema=False)
    block = F.floor(F.col("place") * F.pow(F.lit(float(ARITY)), F.col("level")) / size).cast("long")
    paths = full.select("part", "g", block.alias("block"), F.lit(0).alias("kind"), "place", "level", "subroot", "root", "path")
    both = leaves.unionByName(paths, allowMissingColumns=True).repartition("part", "g", "block").sortWithinPartitions("part", "g", "block", "kind", "place")
    both = both.select("part", "g", "block", "kind", "place", "ended", "leaf", "level", "subroot", "root", "path", *keep)

    def run(batches):
        # A group of rows at a time: first the peaks of a block (kind 0), then its leaves.
        held: list[pa.RecordBatch] = []

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            n_peaks = t["kind"].to_pylist().count(0)
            upper = {
                (level, q): (tuple((s["left"], s["right"]) for s in path), sub, root)
                for level, q, path, sub, root in zip(*(t[c].slice(0, n_peaks).to_pylist() for c in ("level", "place", "path", "subroot", "root")), strict=True)
            }
            some = t.slice(n_peaks)
            digests = some["leaf"].to_pylist()
            found = leaf_paths(climb(some["place"][0].as_py(), digests, some["ended"][-1].as_py()))
            more = [upper[peak] for peak, _ in found]
            chunk = {"g": some["g"], "leaf": some["leaf"]} | {c: some[c] for c in keep}
            chunk |= {"subroot": pa.array([m[1] for m in more], pa.string()), "root": pa.array([m[2] for m in more], pa.string())}
            chunk["path"] = _path_array([path + m[0] for (_, path), m in zip(found, more, strict=True)])
            return pa.table(chunk).combine_chunks().to_batches()

        last = None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            lo = 0
            for i, key in enumerate(keys):
                if key != last:
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    if held:
                        yield from out()
                    lo, last = i, key
            if lo < len(keys):
                held.append(b.slice(lo))
        if held:
            yield from out()

    return both.mapInArrow(run, f"g string, leaf string{listed}, subroot string, root string, path {PATH}")


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row of *docs*: doc_id, leaf (the digest that *leaf* computes), the columns *keep*, subroot (of its group's
    tree), root, and proof: for every level from the leaf to the root the digests left and right of the path's node.

    A group's leaves ascend by id (null first); rows of equal ids by digest. While a level has several nodes, every
    three consecutive ones (the last run: fewer, even one) become the SHA-256 of their hex digests. The groups' roots,
    by group (null first, then by UTF-8 bytes), make the upper tree likewise. With one row its leaf is the root.
    Empty tables give no rows; other columns of *docs* may have any name. One row a partition comes to the driver.
    """
    extra = {f"k{i}": c for i, c in enumerate((keep or {}).values())}
    group = F.when(F.col(group_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    rows = docs.select(group.alias("g"), F.col(id_col).alias("i"), leaf.alias("leaf"), *[c.alias(k) for k, c in extra.items()])
    rows = stage_table(rows, "merkle-leaves")

    def over(ends: DataFrame) -> DataFrame:
        up = forest(stage_table(ends.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("leaf")), "merkle-groups"), ["name"], ["name"])
        return up.select(F.col("name").alias("g"), F.col("leaf").alias("subroot"), "root", "path")

    out = forest(rows, ["i"], ["i", *extra], over)
    names = [F.col(k).alias(c) for k, c in zip(extra, keep or {}, strict=True)]
    return out.select(F.col("i").alias("doc_id"), "leaf", *names, "subroot", "root", F.col("path").alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
