"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.store import WORD, fresh, shuffled, stage_table

GROUPS = 64  # of sources, for the upper part of the splitting tree


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above *most* times its size; what is over is shared again
    by weight among the others until none is above."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    left, open_ = total, list(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        shut = set(over)
        open_ = [i for i in open_ if i not in shut]
    return out


def splitting_tree(quota: list[int], shards: int, seed: int, totals: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(shard, place in *quota*, blocks): every node hands its left half an exact multivariate-hypergeometric draw
    from its blocks, its right half the rest, so a source's blocks add up to its quota. Shards get even numbers of
    blocks, or those of *totals*. Nodes keep only the sources that they have blocks of."""
    out: list[tuple[int, int, int]] = []
    ends = None if totals is None else np.concatenate([[0], np.cumsum(totals)])

    def split(lo: int, hi: int, who: np.ndarray, counts: np.ndarray) -> None:
        some = counts > 0
        who, counts = who[some], counts[some]
        if not len(who):
            return
        if hi - lo == 1:
            out.extend((lo, w, c) for w, c in zip(who.tolist(), counts.tolist(), strict=True))
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        take = int(counts.sum()) * (mid - lo) // (hi - lo) if ends is None else int(ends[mid] - ends[lo])
        left = rng.multivariate_hypergeometric(counts, take, method="marginals")
        split(lo, mid, who, left)
        split(mid, hi, who, counts - left)

    counts = np.asarray(quota, np.int64)
    split(0, shards, np.arange(len(counts)), counts)
    return out


def _numbered(per: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Sources with their number by code point, null last, and the weight that the cycle gives it."""
    ordered = per.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    rows = per.sparkSession.createDataFrame(ordered, T.StructType([*per.schema.fields, T.StructField("no", T.LongType())]), verifySchema=False)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("no") % len(cycle) + 1).cast("int"))
    return stage_table(rows.withColumn("weight", weight), "sources")


def _targets_by_rounds(per: DataFrame, most: float) -> DataFrame:
    """As :func:`targets`, for any number of sources: a round is two aggregates over the table of sources. A source is shut
    once the level, words left for each unit of weight of the open ones, passes *most* times its size for its weight; the
    level only rises, so which are shut follows from it alone."""
    limit = most * F.col("words") / F.col("weight")
    level, shut = -math.inf, -1
    while True:
        open_ = limit >= level
        got = per.agg(
            F.sum("words").alias("all"), F.sum(F.when(~open_, most * F.col("words"))).alias("gone"), F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.count_if(~open_).alias("shut")
        ).first()
        if got["shut"] == shut or not got["weight"]:
            break
        shut, level = got["shut"], (float(got["all"]) - (got["gone"] or 0.0)) / got["weight"]
    return per.withColumn("target", F.when(limit >= level, F.col("weight") * level).otherwise(most * F.col("words")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    shards: int | None = None,
    block_docs: int = 64,
    max_blocks: int = 16_384,
    most: float = 3.0,
    seed: int = 17,
    few_sources: int = 10_000,
    shard_words: int = 40_000_000,
) -> DataFrame:
    """Per row of *docs*: id, source, size (words), source_size, target, and copies: an array of
    (epoch, shard, position), one for each time the mix takes the document.

    A source's documents are dealt by a hash of their id into blocks of about *block_docs*
    (larger ones where that would be more than *max_blocks*, the rows of the windows over blocks). It is taken
    whole floor(target / size) times; what is left of the target is filled with whole blocks in the order
    of a second hash, and then with documents of the next block, by a hash: each whose middle lies within what is
    left, passing over those too long, so a source misses its target by at most half of any document passed over. The
    exact numbers of blocks are split over *shards* by :func:`splitting_tree`; each shard takes disjoint runs of the
    permuted blocks, and ``position`` (a hash) is the order within a shard. Without *shards* there is one for each
    *shard_words* words, from 16 to 100,000.

    Up to *few_sources* sources their totals come to the driver and are broadcast; beyond that numbers and targets are
    computed in tables and joined by shuffles. The tree is split over at most 64 groups of sources on the driver, and
    within a group in a task, by exact draws either way.

    Null texts have size 0; null is a source of its own, the last. Documents of size 0 have copies of no
    words. Rows that repeat id, source and text are one document that counts several times: they get equal copies.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    base = stage_table(base.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("times")), "sizes")
    size = F.col("size") * F.col("times")
    per = stage_table(base.groupBy("source").agg(F.sum(size).alias("words"), F.count(F.lit(1)).alias("docs"), F.max("times").alias("times")), "source-sizes")
    known = per.agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("times").alias("times")).first()
    per = per.drop("times")
    max_blocks = max(1, min(max_blocks, int(9e8 / most) // max(1, known["n"])))  # the draws are exact below 10^9 blocks
    few = known["n"] <= few_sources
    small = F.broadcast if few else lambda df: df
    if shards is None:
        shards = max(16, min(100_000, (known["words"] or 0) // shard_words))
    if few:
        found = sorted(per.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
        want = targets([r["words"] for r in found], [cycle[i % len(cycle)] for i in range(len(found))], most)
        named = spark.createDataFrame([(*r, i, w) for i, (r, w) in enumerate(zip(found, want, strict=True))], "source string, words long, docs long, no long, target double")
    else:
        named = stage_table(_targets_by_rounds(_numbered(per, cycle), most), "targets")
    full = F.coalesce(F.floor(F.try_divide("target", "words")), F.lit(0)).cast("int")
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(max_blocks), F.ceil(F.col("docs") / block_docs)))
    names = named.select("no", F.col("source").alias("__source"), F.col("words").alias("source_size"), "target", full.alias("full"), n_blocks.cast("int").alias("n_blocks"))
    names = names.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    rows = base.join(small(names), base["source"].eqNullSafe(names["__source"])).drop("__source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id"), F.col("n_blocks")).cast("int"))
    turn = lambda *c: F.xxhash64(F.lit(seed), *c)
    blocks = rows.groupBy("no", "block").agg(F.sum(size).alias("words"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    w = Window.partitionBy("no").orderBy(turn(F.lit("fill"), "no", "block"), "block")
    blocks = stage_table(
        blocks.withColumn("ends", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(
            "no", "block", "full",
            F.when(F.col("ends") <= F.col("rest"), 2).when(F.col("ends") - F.col("words") < F.col("rest"), 1).otherwise(0).alias("part"),
            (F.col("rest") - (F.col("ends") - F.col("words"))).alias("room"),
        ),
        "blocks",
    )
    # Units: a block for each whole pass, and one for the part pass where it takes any of it.
    units = blocks.withColumn("passes", F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)).filter("passes > 0")
    quotas = stage_table(units.groupBy("no").agg(F.sum("passes").cast("long").alias("quota")), "quotas")
    units = units.select("no", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("epoch"))
    deal = Window.partitionBy("no").orderBy("epoch", turn(F.lit("deal"), "no", "epoch", "block"), "block")
    dealt = units.withColumn("rank", F.row_number().over(deal) - 1).join(_dealt(quotas, shards, seed, known["n"]), ["no", "rank"])
    dealt = dealt.groupBy("no", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("dealt"))
    dealt = blocks.drop("full").join(dealt, ["no", "block"], "left")
    rows = rows.select("doc_id", "source", "size", "text_hash", "times", "source_size", "target", "full", "no", "block").join(dealt, ["no", "block"])
    # Only the one block of each source that is taken in part needs an order of its documents.
    part = F.col("part") == 1
    by = ["no", "block", "turn", "doc_id", "size", "text_hash"]
    some = rows.filter(part).withColumn("turn", turn(F.lit("doc"), "doc_id")).repartition("no", "block").sortWithinPartitions(*by).drop("turn")

    def fill(batches):
        at, room = None, 0.0
        for b in batches:
            here = []
            for no, block, n, times, left in zip(*(b.column(c).to_pylist() for c in ("no", "block", "size", "times", "room")), strict=True):
                if (no, block) != at:
                    at, room = (no, block), left
                here.append(n * times / 2 <= room)
                room -= n * times if here[-1] else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(here, pa.bool_())], [*b.schema.names, "last"])

    some = some.mapInArrow(fill, T.StructType([*some.schema.fields, T.StructField("last", T.BooleanType())]))
    rows = rows.filter(~part).withColumn("last", F.col("part") == 2).unionByName(some)
    copies = F.filter(F.coalesce("dealt", F.array().cast("array<struct<epoch:int,shard:int>>")), lambda u: (u["epoch"] < F.col("full")) | F.col("last"))
    copies = F.transform(copies, lambda u: F.struct(u["epoch"].alias("epoch"), u["shard"].alias("shard"), turn(F.lit("place"), u["epoch"], F.col("doc_id")).alias("position")))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "text_hash", "times")
    if (known["times"] or 0) > 10_000:  # rows that repeat so often are written out by several tasks
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr("(times - 1) div 10000")))).repartition("doc_id", "text_hash", "part")
        rows = rows.withColumn("times", F.least(F.lit(10_000), F.col("times") - 10_000 * F.col("part"))).drop("part")
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")


def _dealt(quotas: DataFrame, shards: int, seed: int, sources: int) -> DataFrame:
    """(no, rank, shard) of every unit: the ranks of a source's units go to the shards in runs as the tree splits them.

    Sources are put into at most 64 groups. The driver splits the groups' totals, a task the blocks of a group with the
    numbers that the groups' tree gives each shard; the draws of both together are those of one tree over all sources."""
    spark = quotas.sparkSession
    each = -(-max(1, sources) // GROUPS)
    grouped = quotas.withColumn("g", F.floor(F.col("no") / each).cast("int"))
    sums = sorted(tuple(r) for r in grouped.groupBy("g").agg(F.sum("quota")).collect())
    shares = np.zeros((len(sums), shards), np.int64)
    for s, k, n in splitting_tree([n for _, n in sums], shards, seed):
        shares[k, s] = n
    of = spark.sparkContext.broadcast({g: shares[k] for k, (g, _) in enumerate(sums)})

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["no"].to_numpy())
        no, quota, g = table["no"].to_numpy()[order], table["quota"].to_numpy()[order], table["g"][0].as_py()
        found = splitting_tree(quota.tolist(), shards, seed + 1 + g, of.value[g])
        found.sort(key=lambda x: (x[1], x[0]))
        who, n = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)
        ends = np.cumsum(n)
        before = (np.concatenate([[0], np.cumsum(quota)])[:-1])[who]
        return pa.table({"no": no[who], "first": ends - n - before, "last": ends - before - 1, "shard": np.array([x[0] for x in found], np.int32)})

    runs = grouped.groupBy("g").applyInArrow(run, "no long, first long, last long, shard int")
    return runs.select("no", F.explode(F.sequence("first", "last")).alias("rank"), "shard")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, **how) -> DataFrame:
    """The mix itself: each row of *docs*, all columns, as often as :func:`mix` takes it, shard by shard and
    within a shard in the order of the positions; a shard is a partition. Rows that aren't taken are left out; those of
    size 0 come along as often as their block. Rows that repeat id, source and text are each taken so often; other
    columns may have any name."""
    i, s, h, many, one = fresh(docs, "id", "of", "hash", "copies", "copy")
    dealt = mix(docs, id_col, text_col, source_col, shards=shards, **how).filter(F.size("copies") > 0)
    dealt = dealt.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("text_hash").alias(h), F.col("copies").alias(many))
    dealt = stage_table(dealt.dropDuplicates([i, s, h]), "copies")
    if shards is None:
        shards = 1 + (dealt.agg(F.max(F.array_max(F.transform(many, lambda c: c["shard"])))).first()[0] or 0)
    same = docs[id_col].eqNullSafe(dealt[i]) & docs[source_col].eqNullSafe(dealt[s]) & (F.xxhash64(docs[text_col]) == dealt[h])
    rows = docs.join(shuffled(dealt), same).withColumn(one, F.explode(many))
    rows = rows.repartitionById(shards, F.col(f"{one}.shard")).sortWithinPartitions(f"{one}.shard", f"{one}.position", f"{one}.epoch")
    return rows.select(*[docs[c] for c in docs.columns])
