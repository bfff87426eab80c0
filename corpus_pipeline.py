"""From raw documents to packed sequences: quality rules, near and exact deduplication, personal data, packing."""

from __future__ import annotations

import contextvars
import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenum.llm.common import DOCUMENT_COLUMNS, delete, materialize, recorded, table, written_at
from plenum.llm.minhash_dedup import keep_one
from plenum.llm.packing import pack_documents
from plenum.llm.pii import redact
from plenum.llm.quality_rules import quality_filter
from plenum.llm.suffix_dedup import without_repeats


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch that stages have made, by folder of tables and stage: when, and the paths. A run has its own.
_spent: contextvars.ContextVar[dict[tuple[str, str], tuple[float, list[str]]]] = contextvars.ContextVar("spent", default={})


def stage(f: Stage) -> Stage:
    """f, which first deletes the scratch of the stage before it, once docs is that stage's result: a table written since.

    The scratch of other runs, and of a stage called twice, stays: a result
    that is still lazy reads it.
    """
    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spent, names = _spent.get(), [n for n, _ in STAGES]
        before = names.index(f.__name__) - 1
        made, paths = spent.get((sf_dir, names[before]), (0.0, [])) if before >= 0 else (0.0, [])
        if paths and written_at(docs) >= made:
            delete(spark, *paths)
            del spent[sf_dir, names[before]]
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        spent[sf_dir, f.__name__] = (time.time(), paths)
        return out

    return call


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the base rules and the thresholds of their language and source."""
    return quality_filter(docs, DOCUMENT_COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs, DOCUMENT_COLUMNS)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a smaller id also holds."""
    return without_repeats(docs, DOCUMENT_COLUMNS)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    return redact(docs, DOCUMENT_COLUMNS)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packing)]

#: Tokenizing and the interleave refinement have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    token = _spent.set({})
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _spent.reset(token)
