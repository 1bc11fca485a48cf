"""A corpus pipeline: five stages, each of which takes and gives a table of documents.

Toxic documents go; of near duplicates the smallest id stays; passages that
came earlier are cut; documents contaminated by the benchmark go; what is left
is packed into sequences.  Each stage's result is written to the shared folder
and read again, so a lost executor costs one stage's tasks at most; the tables
a stage makes for itself are removed when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlog.llm import decontaminate, minhash, packing, suffixes, toxicity
from batchlog.llm.shared import cleared, new_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left go; n_chars follows the text."""
    # A name that no column has.
    info = "removal" + "_" * max(map(len, docs.columns))
    cut = suffixes.remove_passages(docs, into=info)
    left = cut.filter(f"{info}.n_removed = 0 or {info}.n_removed < {info}.n_words")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(f"{info}.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids", "padding")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("suffix_dedup", remove_passages),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: A fitted model, components and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with cleared(spark):  # of a stage its result is left
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
