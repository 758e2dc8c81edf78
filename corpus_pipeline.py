"""A training corpus from raw documents: toxic texts go, one of each group of near copies stays, repeated passages
are cut, sources are mixed to their weights, and what is left is encoded.

Every stage works on all rows that the one before kept, which were written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import bpe_codec, common, mixing, ngram_join, substring_dedup, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose score is below 0.5, as the field learnt from docs and labels gives it.

    Null and empty texts stay, as do null ids and repeated rows; columns stay as they are. Without labels of both
    kinds nothing is learnt and nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs with the least id of each group of near copies; texts without words are no copies and stay."""
    return ngram_join.one_of_each(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, their texts without words that a repeated window covers; no row goes, null texts stay null."""
    return substring_dedup.cut_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: texts without words, null ones among them, go."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row of the mix; a null or empty text has no ids."""
    import public_tokenizers

    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=False)


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_copies_out), ("substring_dedup", repeats_out), ("mixing", mixed), ("bpe_codec", encoded)]

#: SQL can express neither the field nor the seeded draw.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
