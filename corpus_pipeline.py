"""A corpus made ready for training in five stages, each of which works on all that the one before kept.

Language ID drops documents without a language; near-duplicate groups keep one document; passages that came earlier
are cut out; sources are mixed to target weights; the mix is packed into sequences of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import stage, table
from strandline.llm.language_id import Model, held_out, keep_identified
from strandline.llm.minhash_dedup import keep_one
from strandline.llm.mixing import WEIGHTS, mixed_documents
from strandline.llm.packing import pack_documents, tokenizer_path
from strandline.llm.substring_dedup import remove_repeats
from strandline.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a set of languages explains better than noise; a null text, or one without a letter, goes."""
    ship(spark)
    return keep_identified(docs, Model.learn(docs.filter(~held_out()).select("text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8. Null and empty texts stay, and rows with a null doc_id that are no copies."""
    ship(spark)
    return keep_one(docs, k=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what an earlier one has too (a null doc_id comes last); one of which nothing is left goes, null texts stay."""
    ship(spark)
    return remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one like others."""
    ship(spark)
    return mixed_documents(docs, WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null text has the end mark only."""
    ship(spark)
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeats),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL cannot express these stages; tests hold them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
