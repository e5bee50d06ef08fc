"""The training-data operators as registered queries, with their production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftmark.llm import ann, chat, fertility, licenses, mixing, packing, pii, ranking, secrets, setjoin
from weftmark.llm.common import table

#: Folder of the public vocabulary files, where the package that holds them is not installed.
TOKENIZERS = os.environ.get("WEFTMARK_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    if "WEFTMARK_TOKENIZERS" not in os.environ:
        try:
            import public_tokenizers
        except ModuleNotFoundError:
            pass
        else:
            return public_tokenizers.path(name)
    return f"{TOKENIZERS}/{name}"


def fertility_vocabularies() -> dict[str, str]:
    """The vocabularies that measure fertility: one with byte fallback, one of byte-level merges for many languages."""
    return {"piece": vocabulary("piece_bpe_32k.model"), "multi": vocabulary("byte_bpe_multi_50k.tiktoken")}


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(table(spark, sf_dir, "documents"), fertility_vocabularies(), lang_col="lang")


def op2_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op7_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op8_groupjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fertility, op2_randomness, op3_snapshots, op4_ranking, op5_licenses, op6_anchors, op7_pfair, op8_groupjoin, op9_packing, op10_forest)
}
ORACLE_SQL: dict[str, str] = {"op3_snapshots": chat.ORACLE}
