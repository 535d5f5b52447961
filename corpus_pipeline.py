"""A pipeline over ``documents``: toxic documents go, exact copies go, one document of each near-duplicate group stays, sources are
mixed to target weights, and what is left is packed into training sequences."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import exact_dedup, ngram_join, packing, source_mix, toxicity
from quillstone.llm.scratch import discard, free_shuffles, keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; labels teach the model only."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word-shingle likeness 0.8 or more the smallest id stays; texts without words all stay."""
    return ngram_join.one_of_each(docs, 5, Fraction(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]
#: Toxicity scores, components of links and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        if k:  # nothing reads the stage before any more
            discard(before)
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
