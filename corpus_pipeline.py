"""From raw documents to packed training sequences, in five stages.

quality classifier (importance resampling) -> near-duplicates (bottom-k sketches) -> repeated passages (suffix arrays)
-> benchmark decontamination (BM25) -> packing (cutting stock).  Each stage takes what its predecessor kept; all but the
last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, minhash, packing, quality, storage, substrings
from corpusmill.llm.queries import table

#: Similarity from which the stage of near duplicates links documents; the query op5 has a contract of its own.
NEAR = (80, 100)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality sampler rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 0.8 or more) the document of the smallest id stays."""
    return minhash.keep_one(docs, NEAR)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that a document of a smaller id also has are cut out; documents of which nothing is left go."""
    return substrings.without_repeats(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_near_copies),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", remove_leaks),
    ("packing", pack),
]

#: SQL can express neither sampling by models nor packing by a linear program.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, earlier = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = storage.save(out, f"stage{k}")
        # what a stage has read isn't needed once its result is written
        if earlier is not None:
            storage.drop(earlier)
        earlier = docs
    return docs
