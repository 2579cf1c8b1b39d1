"""Cleaning of a corpus in five stages; each takes (spark, docs, sf_dir) and works on all that the one before kept.

All but the last return the columns of documents. Toxic documents, all but one of each group of near copies and
documents that hold benchmark passages leave; boilerplate lines leave the texts; what stays is packed.

Defined cases, for every stage: a null text counts as empty (it is kept by all stages, stays null, and is packed as its
closing id); of documents without an id, or of one id, near_dedup keeps or drops all together, the other stages judge
each row; exact ties and repeated rows are judged alike; empty tables of documents, labels or benchmark items give an
empty result or remove nothing; columns of any other name stay as they are, also those named like an operator's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.decontaminate import find_leaks
from waypath.llm.lines import drop_boilerplate
from waypath.llm.packing import pack
from waypath.llm.simhash import keep_one
from waypath.llm.toxicity import fit, score


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """docs with columns of neutral names (no operator's result has one), these names, and those of the id and the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns]
    return docs.toDF(*names), names, names[at.index("doc_id")], names[at.index("text")]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d, names, _, text = _plain(docs)
    return score(d, model, text).where(F.col("predicted") == 0).select(names).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, names, own, text = _plain(docs)
    site = names[[c.lower() for c in docs.columns].index("source")]
    return drop_boilerplate(d, own, text, site).select(names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, names, _, text = _plain(docs)
    found = find_leaks(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text)
    return found.where(F.col("n_hit") == 0).select(names).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A trained model decides in the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
