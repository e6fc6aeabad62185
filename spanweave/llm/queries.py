"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import codec_digest
from .common import read_table
from .fingerprints import fingerprints
from .html import extract
from .knn import ORACLE as KNN_ORACLE
from .knn import top_k
from .neardup import near_duplicates
from .packing import pack
from .passages import near_duplicate_passages
from .secrets import findings
from .substrings import remove_repeats
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(read_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(read_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_toxicity": op2_toxicity,
    "op3_neardup": op3_neardup,
    "op4_packing": op4_packing,
    "op5_substrings": op5_substrings,
    "op6_bpe": op6_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_passages": op8_passages,
    "op9_secrets": op9_secrets,
    "op10_topk": op10_topk,
}
ORACLES: dict[str, str] = {"op10_topk": KNN_ORACLE}
