"""The corpus pipeline: toxic documents go, near copies are reduced to one, contaminated documents go, personal data is masked, and what
is left is mixed to target weights. Each stage reads what its predecessor kept, and writes it as Parquet for the next.

All stages but the last return the columns of ``documents``. The last returns them once per copy in training order, with ``copy``,
``words`` and ``position``. Null and empty texts pass every stage and take no words of the mix, so they are not in its result. Repeated rows
are near copies of each other: one stays. An empty table runs through as an empty table. The operators' docstrings say the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from livetables.llm import decontamination, mixing, near_dedup, pii, toxicity
from livetables.llm.base import Steps, ready, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near_dedup.without_near_copies(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return pii.redact(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mix(docs)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("decontamination", _decontamination), ("pii", _pii), ("mixing", _mixing)]
# learned lexicons and bootstrapped patterns have no SQL; the operators are tested against brute force or on held-out rows, the stages for columns, empty tables and ids left
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = steps.keep(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_step_path"):
            steps.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
