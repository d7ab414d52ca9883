"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage gets what its predecessor kept, as Parquet, and all but the last return the columns of
``documents``, others that they have included. Rows stay, go or change by the rules of the operator that
a stage calls, which also states what it does with nulls, empty and long texts, ties and repeated rows.
The stages keep their order whatever is left: one that gets no rows, or a table without rows beside
them, returns none, or all that it got, with the same columns.

The key of the pseudonyms is the session's setting ``spark.lakeload.pii.key``; where there is none it is
that of the registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import scratch_dir
from lakeload.llm import bpe, decontaminate, pii, quality, simhash
from lakeload.llm.queries import PII_KEY, VOCABULARY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints that link at two bits or fewer."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms of the same format."""
    key = spark.conf.get("spark.lakeload.pii.key", None)
    return pii.pseudonymize_rows(docs, key.encode() if key else PII_KEY)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of each document."""
    vocabulary = bpe.load_vocabulary(VOCABULARY)
    rows = bpe.encode(docs, vocabulary, bpe.build_lexicon(docs, vocabulary))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", pseudonymized),
    ("tokens", tokenized),
]

# Language model, fingerprint classes and tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
