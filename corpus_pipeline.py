"""A training-data pipeline of the operators in farstride.llm.

run() keeps documents with a language, one of each group of near copies, none with benchmark items, repeats or thins
documents to the domains' target weights, and deals them into shards of near equal bytes.
"""

from pyspark.sql import DataFrame, SparkSession

from farstride.llm import stages
from farstride.llm.common import Scratch

STAGES = [
    ("language ID", stages.language),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("benchmark decontamination", stages.decontaminated),
    ("mixing to target weights", stages.mixed),
    ("sharding", stages.sharded),
]
#: Learned models and similarity groups: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
