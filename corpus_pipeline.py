"""A corpus pipeline of five stages over ``documents``.

Each stage reads what its predecessor kept from Parquet in the shared folder.
Run as the query ``pipeline``.

Defined cases: documents with a null or empty text are never toxic, linked or
contaminated, so they pass the first three stages; the mixing stage takes them as
often as their neighbours, as they have no words. A null source is a source of its
own; null ids, repeated ids and repeated rows stay apart (the Jaccard stage keeps one
of equal texts, and texts that share an id are judged each on its own; the mixing
stage numbers equal rows). Very long texts are read whole by every stage. An empty
table gives no rows. Columns besides those of ``documents`` are carried through,
whatever their names; the last stage adds ``shard``, in place of a column of that
name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontam, jaccard_join, mixing, ring_shards, toxicity
from tidepanel.llm.shared import forget, read_table, release, scratch_scope, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, 0.8 or more."""
    return jaccard_join.keep_one_per_component(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a document is left out, taken
    once or repeated (then as several rows). Rows come by mix shard, shuffled."""
    return mixing.mix(docs, keep_plan_columns=False)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard."""
    return ring_shards.assign(docs, shards=24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The toxicity stage is a learned classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes when its
    result is stored, and that result when the next stage's is."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch_scope(spark, kept):
            kept.append(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        forget(docs)
        docs = kept[0]
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
