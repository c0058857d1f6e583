"""From raw documents to training rows: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes the session, its predecessor's rows and the folder of the tables, and keeps the columns of
documents; the last gives token ids. Between stages rows are written as Parquet in the shared folder; a stage's table
goes as soon as the next one's is whole, so that no more than two are there at a time.

Defined cases, at every stage: an empty table gives no rows; a null text is kept by all but the first stage, which
can't tell its language; null source, language and length are kept as they are; rows without an id are judged by their
texts, as are rows that share one; of repeated rows one stays; texts are read whole; other columns are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantweave.llm import bpe, decontaminate, language, nearjoin, secrets
from quantweave.llm.common import discard, new_path, table
from quantweave.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the dictionaries are learned from these documents."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    return language.keep_known(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    ship(spark)
    return nearjoin.keep_one(docs.select(*COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    ship(spark)
    return decontaminate.drop_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in the place of each secret."""
    ship(spark)
    return secrets.redact(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a check that they decode to its text."""
    ship(spark)
    vocabulary = bpe.BytePairs.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.tokenise(docs, vocabulary)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: Compression, MinHash and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                discard(spark, before)
            before = path
    return docs
