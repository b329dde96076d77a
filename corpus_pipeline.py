"""From raw documents to token ids: toxicity, exact dedup, near dedup, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns all rows that stay, with the columns of documents; the
last returns token ids. ``run`` writes each result to the shared folder and hands it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, toxicity
from tessera.llm.exact_dedup import keep_exact
from tessera.llm.mixing import mixed
from tessera.llm.near_dedup import keep_representatives
from tessera.llm.store import stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the field is learned from the labelled documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest id."""
    return keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 similarity of five-word shingles the one of smallest id."""
    return keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, or up to three times), dealt to shards."""
    return mixed(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, lang, source, n_tokens and token ids."""
    kept = [c for c in ("lang", "source") if c in docs.columns]
    return bpe.encode(docs, bpe.build_lexicon(docs), keep=kept).select("doc_id", *kept, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_ids),
]

#: Scores, the mix and token ids have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
