"""Corpus preparation: five stages, each of which takes all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import materialise, table
from hearthline.llm.exact_dedup import drop_exact_duplicates
from hearthline.llm.minhash_dedup import drop_near_duplicates
from hearthline.llm.mixing import take_mix
from hearthline.llm.sentencepiece_codec import encode
from hearthline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated score rejects go.

    NULL and empty texts are scored like any other; repeated rows share their fate; rows of
    any id, NULL too, are judged by their text alone; an empty table stays empty.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays.

    NULL texts count as empty, so one document without text stays; a NULL id loses every
    tie; repeated rows are one; an empty table stays empty.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that of the smallest id.

    Texts without words link with nothing and stay; rows of a NULL id stay where no id is
    reachable; of rows that repeat an id one stays; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix at the target weights takes it.

    A NULL source is a source; texts without words are taken once for each full pass of
    their source; repeated rows are taken alike; an empty table stays empty.
    """
    return take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document in the mix.

    NULL text has NULL ids and 0 tokens, the empty text no ids; repeated rows stay; an
    empty table gives an empty result.
    """
    encoded = encode(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    return encoded.select("doc_id", "lang", "source", "ids", F.col("n_tokens").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Scores of fitted trees and piece ids have no SQL form; tests/llm holds all rows of run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
