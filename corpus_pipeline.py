"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage works on all rows that the one before has kept. All but the last return the
columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import language, pii
from lakewright.llm.common import free_name, pin, ship_package, table
from lakewright.llm.mixing import mix, take
from lakewright.llm.packing import pack
from lakewright.llm.similar import similar_documents
from lakewright.llm.simhash import keep_one


def stage(function: Callable) -> Callable:
    """A stage that sends the package's code to the workers before it plans anything."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language in `lang`.

    Learns from the rows with a lang. Texts without a letter and those whose entropy is
    unusual for the language go; without any labelled row none can be recognised.
    """
    name = free_name(docs, "_found")
    found = language.recognise(docs, F.lit(True), name)
    kept = found.where(F.col(name)["accepted"]).withColumn("lang", F.col(name)["lang_pred"])
    return kept.select(*docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Links are SimHash fingerprints that differ in two bits at most, met by ball hashing, and
    similarities of 0.8 and more between sets of five-word shingles.
    """
    return keep_one(docs, similar_documents(docs, radius=2))


@stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows."""
    clean = docs.withColumn("text", pii.redacted(F.col("text"), pii.train(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is there twice."""
    return take(docs, mix(docs))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages cannot be written in SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows that the one before has kept."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = pin(function(spark, docs, sf_dir), name)
    return docs
