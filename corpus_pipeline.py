"""A corpus made ready for training: toxic documents, near duplicates, benchmark text and secrets out, then tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import bpe, decontamination, ngram_join, secrets, toxicity
from fieldtally.llm.common import sha256, store, table
from fieldtally.llm.queries import word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or over sentences reaches one half go; the model learns from the given labels."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word Jaccard similarity of 0.8 or equal texts, the least id stays."""
    return ngram_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows of 13 words go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked in the text and ``n_chars`` follows; every document stays."""
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the hash of the text that they decode to."""
    done = bpe.encode_decode(docs, word_bpe())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       sha256(F.col("decoded")).alias("decoded_sha256"))


#: Each function takes (spark, docs, sf_dir); its result, written as Parquet and read again, is the next one's docs.
STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: SQL can express neither the trained toxicity model nor the BPE; both are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents`` of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
