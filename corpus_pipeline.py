"""Documents to training sequences: language, near-duplicates, secrets, mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor, which are written as Parquet and
read again in between. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewright.llm import language, mixing, packing, secrets, simhash
from basewright.llm.common import Workspace


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; fills in languages that are missing."""
    return language.accepted(docs, language.fit(docs, language.learned_from(docs["doc_id"])))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: op7's links, and five-word shingle sets of 0.8 similarity."""
    return simhash.first_of_each(docs, copies=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Replaces secrets in texts by a mark; all documents stay. ledger: a folder kept from run to run, so that known texts are not scanned again."""
    return secrets.redacted(docs, ledger or Workspace(spark, "secret-ledger").path)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the target weights of their sources ask for."""
    return mixing.taken(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack(docs, keep=40_000)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]
#: Model fits, hashes outside SQL and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir, **({"ledger": ledger} if stage is without_secrets else {})), name)
    return STAGES[-1][1](spark, docs, sf_dir)
