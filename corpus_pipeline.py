"""The corpus pipeline: stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import fuzzy_lines, mixing, packing, simhash, toxicity
from weftgraph.llm.queries import table, tokenizer_path
from weftgraph.llm.storage import Written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity classifier rejects, learnt from all labels."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with lines like an earlier line taken out."""
    return fuzzy_lines.dedup_lines(docs).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; near-duplicate shingles take five words here."""
    return simhash.one_of_each(docs, width=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of docs and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("source mix", source_mix),
    ("best-fit packing", pack_sequences),
]

#: No SQL: classifier, signatures and tokens are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else Written(out, name.replace(" ", "-")).read()
    return docs
