"""From raw documents to a training order, in five stages.

A stage drops the steps that stages before it have stored, so disk holds those of one stage at a time. What
it is given as ``docs`` must therefore have been written, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltledger.llm import curriculum, decontaminate, robust_rules, simhash, substring
from voltledger.llm.common import drop_steps, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far outside their language and source go."""
    drop_steps(spark)
    return robust_rules.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose fingerprints of 4-word shingles link within 4 bits."""
    drop_steps(spark)
    return simhash.keep_one(docs, shingle=4, distance=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur elsewhere go; n_chars follows the text."""
    drop_steps(spark)
    return substring.strip_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    drop_steps(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per training copy, in the order of the curriculum: copy and position are added."""
    drop_steps(spark)
    return curriculum.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Robust estimates and fingerprints aren't SQL; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", step=False)
    return STAGES[-1][1](spark, docs, sf_dir)
