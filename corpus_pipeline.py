"""The corpus pipeline: documents to packed token windows in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; all but the last keep the columns of ``documents``.
Whoever runs the stages writes each result and reads it again before the next.

Null and empty texts pass every stage and are packed as their end token alone;
repeated rows score, lose lines and leak alike, and one row of each doc_id stays
behind the Jaccard stage; other columns are kept, whatever their names, up to
the packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm.common import collected_stages, release, stage
from shardloom.llm.decontamination import decontaminate
from shardloom.llm.jaccard import one_of_each
from shardloom.llm.line_dedup import drop_duplicate_lines
from shardloom.llm.packing import pack
from shardloom.llm.queries import tokenizer_json
from shardloom.llm.toxicity import reject_toxic

#: Tables that the stage before staged for itself; its result is written by now.
_left: list[DataFrame] = []


def _alone(f):
    """Release what the stage before has left, and note what this one leaves."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(*_left)
        _left.clear()
        with collected_stages(_left):
            return f(spark, docs, sf_dir)

    return run_stage


@_alone
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_alone
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, however short, or nearly repeat stay where they come
    first. A document goes only if nothing but white space is left of it."""
    return drop_duplicate_lines(docs)


@_alone
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


@_alone
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_alone
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return pack(docs, tokenizer_json())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier of the first stage has no SQL; the tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES[:-1]:
        docs, last = stage(f(spark, docs, sf_dir), f"pipeline-{name}"), before
        before = docs
        if last is not None:
            release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
