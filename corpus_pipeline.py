"""A corpus pipeline of five stages, from documents to a training mix.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives the rows that it keeps, with the
columns of documents, the last with size, taken and times as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, language_id, mixing, shingle_dedup, suffix_dedup
from factloom.llm.common import cut, hidden, place_of, table

#: A text goes whose likeliest language holds less of its words than this, or which has no letters.
LEAST_SHARE = 0.3


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found in the text; texts without one go."""
    own = hidden(docs)
    names = {c: place_of(docs, c) for c in ("doc_id", "text", "lang")}
    found = language_id.identify(own, language_id.fit(docs.select(*names)), names["text"])
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn(names["lang"], F.col("lang_pred")).select(*own.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies, of 0.8 or more of their five-word shingles: by
    SimHash fingerprints, and exactly for what they leave unconnected."""
    return shingle_dedup.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes of strings of 100 bytes that an earlier document, or the same one before, holds."""
    return _counted(suffix_dedup.without_repeats(docs), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of benchmark items; documents that are mostly such passages go."""
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often."""
    return mixing.mixed(docs, labels=table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: No SQL: the language model, XXH64 fingerprints and the sampling hashes have no counterpart in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
