"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are functions of (spark, docs, sf_dir). ``run`` applies them to the documents,
each to all that its predecessor kept, written as a table in the shared folder and read
again. All but the last return the columns of the documents.

Defined cases: a null text is clean and has no secret; the duplicate stage keeps one row of
each group, also where ids are null or repeated; columns beyond those of the documents are passed on; empty
documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from larkspan.llm import decontam, packing, secret_scan, simhash, toxicity
from larkspan.llm.common import stored, with_package
from larkspan.sources import table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC_FROM``; learned from all labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours: that of the smallest id."""
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in the text are replaced, and ``n_chars`` follows the text."""
    clean = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", with_package(drop_toxic)),
    ("simhash_near_dedup", with_package(drop_near_duplicates)),
    ("decontamination", with_package(drop_contaminated)),
    ("secret_scan", with_package(redact_secrets)),
    ("packing", with_package(pack)),
]

# SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
