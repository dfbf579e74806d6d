"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next one.

Each stage calls one operator of ``voteframe.llm`` on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voteframe.llm import linededup, mixing, neardup, packing, toxicity
from voteframe.llm.common import key_crc, table
from voteframe.llm.queries import TARGETS, labelled_domains
from voteframe.session import cut_lineage


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, key_crc("doc_id") % 4 != 2)
    scored = toxicity.score(docs, model, keep_columns=True)
    return scored.where(f"__toxic_score < {toxicity.THRESHOLD}").select(docs.columns)


def fewer_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates, short lines included; of each template
    one line stays."""
    return linededup.dedup_lines(docs, min_tokens=1).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs).select(docs.columns)


def mixed_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, which may be not at all or several times."""
    mixed, _ = mixing.mix(docs, labelled_domains(spark, docs, sf_dir), TARGETS)
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    return mixed.where("__copies > 0").withColumn("__copy", copies).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_language),
    ("line_dedup", fewer_lines),
    ("jaccard_join", one_of_each_group),
    ("mixing", mixed_domains),
    ("packing", pack_sequences),
]

#: The classifiers, signatures and tokens of the stages have no SQL form; tests compare with
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, name)
    return docs
