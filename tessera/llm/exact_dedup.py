"""Exact duplicates by skew-safe combining: local, salted, global; full texts are compared throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import fresh, shuffled, stage_table


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (largest id), group_size.

    1. Each task combines its own rows (Spark's partial aggregate on digest, text and salt).
    2. Salted groups meet: a text's rows go to one of *salts* tasks by the task they come from,
       so that a text with a third of all rows sends at most a row per task, in *salts* places.
    3. The salts' winners, at most *salts* per text, meet in one group.
    Digest and text are both keys in every step, so equal digests of unlike texts stay apart.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
        (F.spark_partition_id() % salts).alias("__salt"),
    ).withColumn("__digest", F.unhex(F.sha2(F.col("__text"), 256)))
    salted = rows.groupBy("__digest", "__text", "__salt").agg(F.max("__id").alias("k"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("__digest", "__text").agg(F.max("k").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, most: int = 10_000) -> DataFrame:
    """Per row of *docs*: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. The largest id of a group stays;
    null ids lose to any other. Rows that repeat the winning id are all marked as kept (they are one
    document; :func:`keep_exact` returns it once), and so are the rows of a group of null ids. An empty
    table gives no rows. Other columns are ignored, whatever their names.

    Rows find their winner by digest. Of digests with over *most* rows (and over one in 100,000 of all, so
    at most 100,000 digests, which are broadcast) rows and winners meet in *salts* places each. Digests
    shared by unlike texts, which the combining has told apart, are looked up by digest and text.
    """
    won = stage_table(winners(docs, id_col, text_col, salts).select("__digest", "keep_id", "group_size"), "winners")
    total = won.agg(F.sum("group_size")).head()[0] or 0
    large = F.col("group_size") > max(most, total // 100_000)
    hot = won.filter(large).select("__digest", F.lit(True).alias("__hot")).distinct()
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn(
        "__digest", F.unhex(F.sha2(F.col("__text"), 256))
    )
    spread = won.withColumn("__salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    rows = base.select("__id", "__digest", F.spark_partition_id().alias("__part")).join(F.broadcast(hot), "__digest", "left")
    rows = rows.withColumn("__salt", F.when(F.col("__hot"), F.col("__part") % salts).otherwise(0))
    found = rows.join(spread, ["__digest", "__salt"]).select("__id", "__digest", "keep_id", "group_size")
    clash = won.groupBy("__digest").count().filter("count > 1").select("__digest")
    if clash.head(1):
        by_text = winners(docs.join(clash, F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)) == clash["__digest"], "left_semi"), id_col, text_col, salts)
        found = found.join(clash, "__digest", "left_anti").select("__id", "__digest", "keep_id", "group_size").unionByName(
            base.join(by_text, ["__digest", "__text"]).select("__id", "__digest", "keep_id", "group_size")
        )
    return found.select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that :func:`exact_dedup` keeps, all columns, one row for each id and text.

    Rows are chosen by their text's winner, then by id; of rows that repeat both id and text one stays
    (an arbitrary one, should other columns differ). Null texts count as empty, a null id stays if its text
    has no other id, other columns may have any name, and an empty table gives no rows.
    """
    d, k = fresh(docs, "digest", "keep")
    won = winners(docs, id_col, text_col)
    kept = stage_table(won.select(F.col("keep_id").alias(k), F.col("__digest").alias(d)), "kept")
    rows = docs.withColumn(d, F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)))
    out = rows.join(shuffled(kept), rows[d].eqNullSafe(kept[d]) & rows[id_col].eqNullSafe(kept[k]), "left_semi")
    repeated = docs.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias(k))
    if repeated.head(1):
        twice = out.join(repeated, out[id_col].eqNullSafe(repeated[k]), "left_semi").dropDuplicates([id_col, d])
        out = out.join(repeated, out[id_col].eqNullSafe(repeated[k]), "left_anti").unionByName(twice)
    return out.drop(d)
