"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again by the next.

quality rules, toxicity and SimHash near-dedup remove documents; mixing repeats them to the target weights; packing lays
the ids of what is left into sequences. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from florascan.llm import line_crf, mixing, packing, simhash, toxicity
from florascan.llm.common import new_path, table

#: SQL cannot express the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = line_crf.train_field(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge_lines(docs, model).filter("kept").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, mixing.QUERY_WEIGHTS, mixing.QUERY_REST).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.public_encoder())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
