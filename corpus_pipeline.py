"""A corpus pipeline of the training-data operators: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echoweave.llm.common import Tables, materialise, read
from echoweave.llm.jaccard_join import jaccard_components
from echoweave.llm.packing import pack
from echoweave.llm.quality import keep_good
from echoweave.llm.suffix_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without id stay."""
    others = jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(materialise(others), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of 50 words or more."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: SQL can express neither the trained classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's table goes once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    with Tables(spark) as tables:
        for _, stage in STAGES[:-1]:
            before, docs = docs, tables.keep(stage(spark, docs, sf_dir))
            tables.free(*[before] if id(before) in tables.paths else [])
        return materialise(STAGES[-1][1](spark, docs, sf_dir))
