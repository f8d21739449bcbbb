"""A training-data pipeline of five stages over ``documents``; each stage is written and read again.

Odd input: stages keep all columns of ``documents``, whatever further ones there are and however they are named (a stage
works on columns under names of its own); the last one returns its own columns. Null texts count as empty, and stay null
until they are encoded. Rows with a null id are kept like others: they have no label, come last in their class of copies,
and are mixed by the hash of their text. Repeated rows are one class of copies, so one of them is left. Without labels
the classifier scores every document 0.5 and rejects none. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casemill.llm import bytes_bpe, mixing, quality, secrets, trie
from casemill.plans.lineage import checkpoint_dir

#: No SQL: the classifier, the trie join and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from these documents' labels, doesn't reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return trie.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return mixing.mix(docs, copy_col=None)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of the ids and of what they decode to."""
    return bytes_bpe.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_bytes),
]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result; what lies between them is kept in the shared checkpoint folder until the next one is written."""
    place = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{place}/{n}")
            docs = spark.read.parquet(f"{place}/{n}")
            if n:
                _remove(spark, f"{place}/{n - 1}")
    return docs
