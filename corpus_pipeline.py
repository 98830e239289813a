"""From documents to a mix for training: stages that each call one operator, written and read again between them.

All stages take null ids, sources and texts, empty and very long texts, repeated rows, empty tables, and extra columns of
any name, which stay with their rows through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patrika.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from patrika.llm.common import named, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from `labels`, is under 0.5. A null text scores like an empty one, repeated
    rows alike; without labels nothing goes."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one, that with the largest id; every document stays, n_chars
    follows its text. A null text becomes an empty one; repeated rows are one document, cleaned alike."""
    own = {c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(named, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 or more. That with the
    smallest id stays; of repeated rows one does; texts without words, null ones included, all stay."""
    return jaccard_join.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`. All rows of an id go if one holds an item; null and empty texts hold
    none, and items that are null or empty are in none."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: how often the mix takes it (`copies`, 0 for none), and the words that makes (`taken`). Texts
    without words have size 0; a null source is one of its own, the last in order."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot express learned scores, rounding by coins or latent search; a test holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i + 1}")
    return docs
