"""The training-data pipeline: filter, deduplicate, decontaminate and pack the documents.

Each stage takes the documents its predecessor kept and returns the ones it keeps with the
same columns; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, exact_dedup, jaccard, packing, toxicity
from corpusloom.llm.common import table
from corpusloom.llm.queries import TOXIC_AT, tokenizer_path, toxic_model
from corpusloom.session import write_through


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; texts without words stay."""
    scored = toxicity.score(docs, toxic_model(spark, sf_dir), keep_text=True)
    return scored.where(F.col("score") < TOXIC_AT).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard of 0.8 or more."""
    return jaccard.one_of_each(docs, percent=80, width=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words or more."""
    found = decontam.find_overlaps(docs, table(spark, sf_dir, "benchmark"), keep_text=True)
    return found.where(~decontam.contaminated()).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return packing.pack(docs, tokenizer_path(), keep_cache=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: A trained model and a tokenizer stand in the way of SQL; the tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
