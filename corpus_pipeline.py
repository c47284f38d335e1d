"""From raw documents to packed training sequences, in five stages.

Each stage takes the columns of documents under any further names, and rows with nulls in any column. What it does with
null, empty and very long texts, ties, repeated rows and empty tables is stated with it, and more fully with the operator it calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pointlake.llm import exact_dedup, language_id, minhash_dedup, mixing, packing
from pointlake.llm.common import delete, documents, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus has labels for.

    Null and empty texts go, as no language can be told; a null id, language or source is no reason to. Repeated rows
    stay or go together, ties between languages go to the first by name, long texts are read whole, and an empty table stays empty.
    """
    return language_id.keep_known(spark, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set with equal texts: that of the least id, null last; of rows that tie, or are repeated, one.

    Null texts all stay; empty texts equal each other; long ones are compared whole. An empty table stays empty.
    """
    return exact_dedup.deduplicate(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id.

    Rows with a null id, or a text that is null, empty or without words, stay, as do repeated rows of an id that
    stays. Long texts are signed whole. An empty table stays empty.
    """
    return minhash_dedup.keep_one(spark, docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the domains ask for: each floor(rate + u) times, u from its id.

    Null and empty texts have the posteriors of no evidence; repeated rows come alike often; null ids share
    one u. Conflicting labels are settled as toxic, then plain. Without labels, or on an empty table, nothing changes.
    """
    return mixing.mix(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of one sequence each, by rows (bin_id, doc_id, first_token, tokens, bin_tokens).

    Texts that are null or have no words give no piece; longer ones than a sequence give several. Repeated rows are packed
    each, ties in size go by id, a null id stays null, and an empty table gives no rows.
    """
    return packing.pack_documents(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_to_targets", mix_domains),
    ("best_fit_packing", pack_sequences),
]

#: The trained models, signatures and the search for bins have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder
    and read again by the next, after which what it was made from is deleted."""
    docs = documents(spark, sf_dir)
    home = f"{shared_folder(spark)}/pointlake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{home}/{k}-{name}")
            docs = spark.read.parquet(f"{home}/{k}-{name}")
            if k:
                delete(spark, f"{home}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
