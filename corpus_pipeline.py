"""The corpus pipeline: each stage reads what its predecessor wrote.

Defined results of every stage: null and empty texts are texts without words, null ids are ids of no label and no duplicate;
texts of any length are read whole; repeated rows are rows of their own but for what a stage says; empty tables give empty ones;
columns beyond those of ``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmark.llm import mixing, packing, pii, ranking, setjoin
from weftmark.llm.common import Scratch, close_since, opened, table
from weftmark.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored as empty ones; rows with equal texts stay or go
    together (so do ties); without both labels nothing goes."""
    return ranking.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Texts without words are linked with none; rows that
    share an id stay or go together; rows without an id stay."""
    return setjoin.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every row stays, and ``n_chars`` follows the text. Null texts stay null."""
    return pii.redact_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are put in the order of the mix; every row stays. Null and unlisted sources share one weight; rows with equal
    ids are ordered by a hash of the row."""
    return mixing.in_mix_order(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token pieces in packed sequences, window after window of the mix. A null or empty text is the end token alone."""
    return packing.pack_in_order(docs, vocabulary("word_bpe_49k.json"), mixing.PERIOD * mixing.BLOCK)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Intermediate tables are deleted once they have been read; what remains is what the result reads."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        mark = opened()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
            close_since(mark)
            if k:
                scratch.drop(k - 1)
    return docs


#: SQL has neither the fitted classifier nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None
