"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, linededup, neardedup, packing, quality
from palimpsest.llm.shared import table, unused, written
from palimpsest.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of the documents given."""
    names = unused(docs, "score"), unused(docs, "predicted")
    out = quality.scored(docs, table(spark, sf_dir, "labels"), names=names)
    return out.where(F.col(names[1]) == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lose every word; n_chars follows the text."""
    ship(spark)
    out = linededup.dedupe_lines(docs, **linededup.WHOLE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship(spark)
    return neardedup.drop_near_duplicates(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def into_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, packed into training sequences."""
    ship(spark)
    return packing.pack(docs, packing.tokenizer_file())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_benchmark),
    ("packing", into_windows),
]

#: Training, edit distances and packing are not statable in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage-{at}")
    return docs
