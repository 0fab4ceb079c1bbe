"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

quality -> line dedup -> near-duplicate removal -> benchmark decontamination -> mixing.
Every stage takes (spark, docs, sf_dir) and decides on all that the stage before it
kept; all but the last return the columns of documents, whatever their names.

Nulls: a row with a null text is judged as an empty text, or passed on where that says
nothing (line dedup, decontamination); a null id is never a near duplicate. Empty tables
give empty tables. Repeated rows are judged alike, and rows that share an id stay or go
together in near-duplicate removal; of documents equally fit the one with the least id
stays. Long texts are worked on whole, in pieces of bounded memory where Python runs.
The last stage adds ``mix_`` columns; an input column of such a name is kept under its
own name, and the added one gets an underscore more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.llm import decontamination, line_templates, mixing, near_duplicates, quality
from burrow.store import Tables

#: Near duplicates of the pipeline: shingles of five words, similarity of 0.8.
SHINGLE, NUM, DEN = 5, 80, 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return line_templates.drop_recurring_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id. Rows that share that id stay together."""
    judged = near_duplicates.near_duplicates(docs, size=SHINGLE, num=NUM, den=DEN)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities, with their topic, weight and probability."""
    mixed = mixing.mix(docs).where("sampled")

    def free(name: str) -> str:
        return free(f"{name}_") if name.lower() in {c.lower() for c in docs.columns} else name

    added = (F.col(c).alias(free(f"mix_{c}")) for c in ("topic", "tokens", "weight", "probability", "repeat"))
    return mixed.select("row.*", *added)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stage scores with a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; the last but one goes when the driver ends."""
    tables = Tables(spark)
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, tables.add(stage(spark, docs, sf_dir))
        if k:
            tables.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
