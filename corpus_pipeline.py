"""From documents to packed windows: five corpus stages, each written and read again."""

from cairn.llm import stages
from cairn.llm.common import stage

STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_strings", stages.repeated_strings),
    ("decontaminate", stages.clean_of_benchmark),
    ("pack", stages.packed),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each of them and the whole run against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
