"""A training corpus from raw documents: known languages, no copies, no near copies, a mix of sources, token ids.

Every stage but the last returns the columns of its input as they are, extra ones included, whatever their names. Each
stage's result is a table in the shared folder. An empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, exact_dedup, jaccard, langid, mixing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters, or near no language, go.

    Null and empty texts go; without a labelled document all go; rows that repeat are judged alike.
    """
    return langid.accepted(docs, langid.learn(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, one row with the smallest id; a null id is larger than any. Of rows that share that id and the text any one stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word n-grams, the one with the smallest id; rows with a null id, or without words, stay."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts without words are not taken; a null source is one source."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text; a null text has none; repeated rows are coded alike."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"))
    whole = F.col("decoded") == F.encode(common.whole(), "utf-8")
    return coded.select("doc_id", "source", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL expresses neither rank-order profiles nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
