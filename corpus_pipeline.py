"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratawork.llm import decontaminate, minhash, mixing, token_files, toxicity
from stratawork.llm.queries import tokenizer_file
from stratawork.llm.text import read, stored
from stratawork.session import new_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field predicts to be toxic go."""
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, and where each document lies in them."""
    folder = new_folder(spark, "pipeline-tokens")
    token_files.write_tokens(docs, folder, tokenizer_file(), end_id=1)
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", source_mix),
    ("token_files", tokens),
]

#: The field and the confirmed links can't be written in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
