"""documents -> language ID -> near-duplicates -> repeated passages -> mix -> packed sequences.

Each stage takes the documents that its predecessor kept and returns their columns; the last one returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, near_dup, packing, suffix_dedup
from corpusloom.llm.common import free_name
from corpusloom.ship import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language, with that language; those without a letter or with an ambiguous one go.

    A given lang stays. Repeated rows, other columns and their order stay; a null text goes; no rows give none.
    """
    ship(spark)
    name = free_name(docs, "found")
    found = docs.withColumn(name, langid.prediction(spark, langid.learned(docs))).where(~F.col(f"{name}.ambiguous"))
    return found.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows with that id stay, repeated ones too; texts that are null or have no word are near nothing and stay.
    """
    ship(spark)
    own = free_name(docs, "kept_id")
    kept = near_dup.near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 bytes or more that stand anywhere else too; what is left empty, or was empty or null, goes."""
    ship(spark)
    return suffix_dedup.without_repeats(docs).where(F.length("text") > 0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, as rows: a document stands as often as it is taken, the last time perhaps cut. Texts without a word go; a null source is one of its own."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens. A null text is its end mark alone; repeated rows have places of their own."""
    ship(spark)
    return packing.packed_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("pack", pack)]
#: Tokens, models and hash orders aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
