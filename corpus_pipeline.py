"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, lines, mixing, ngram_join, packing
from plumbline.llm.common import free_name, keep
from plumbline.llm.queries import vocabulary

#: A line on more than this share of a source's documents is boilerplate.
LINE_RATIO = 0.02


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go, and ``lang`` becomes the predicted language.

    The model is trained on the given languages of the same documents, so a prediction corrects a label that disagrees with its text.
    """
    found = free_name("found", docs.columns)
    tagged = docs.withColumn(found, language.tagger(spark, language.train(docs))(F.col("text")))
    told = tagged.filter(F.col(f"{found}.lang_pred") != language.UNKNOWN)
    return told.select(*[F.col(f"{found}.lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; documents stay, though one may be left empty."""
    return _as_documents(lines.drop_boilerplate(docs, "source", ratio=LINE_RATIO), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (75 % of five-word shingles) stays."""
    return ngram_join.first_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: whole documents, repeated or left out as their source's target asks, in order of position."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language model nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
