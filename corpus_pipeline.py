"""A training corpus from `documents`: clean, deduplicate, mix, pack. Each stage works on what the one before it kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.mixing import mixed_documents
from quillspark.llm.packing import pack_documents
from quillspark.llm.paragraphs import without_repeats
from quillspark.llm.shingle_join import one_of_each_group
from quillspark.llm.storage import Stash
from quillspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, size=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near copies", near_copies), ("repeated passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: Training, tokenisation and clustering are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the mixed corpus. Every stage is written and read again."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        done = stash.put(stage(spark, docs, sf_dir))
        stash.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
