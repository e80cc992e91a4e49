"""A training corpus from raw documents: score, dedup lines, drop near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next one's docs. All stages but the last return the columns of documents.

Every stage handles nulls in any column, empty and very long texts, ties and repeated rows, empty tables and further
columns as the docstring of its operator says; rows that no stage speaks of stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import line_dedup, mixing, near_dup, packing, quality
from skyfold.llm.common import fresh_name, keep, table

#: Documents whose quality score is below this go: those that the classifier rejects.
ACCEPT = quality.THRESHOLD


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from labels outside the held-out fold."""
    net = quality.train(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.accept(docs, net, ACCEPT)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line. n_chars follows the text; a document of which no line is left goes."""
    clean = line_dedup.dedup_lines(docs, drop_emptied=True)
    changes = {"n_chars": F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.withColumns(changes) if changes else clean


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until each source's words come near its target, in training order.

    A use that takes part of a document counts if it takes at least half of it. Documents without words go.
    """
    position, words = fresh_name(docs, "position"), fresh_name(docs, "words")
    used = mixing.schedule(docs, position_column=position, words_column=words)
    whole = mixing.word_count(F.col("text"))
    return used.filter(F.col(words) * 2 >= whole).drop(position, words)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences; a row for each piece."""
    return packing.digest(packing.pack(docs, packing.tokenizer_path()))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: A trained network and a tokenizer are not SQL; tests hold the operators of the stages against brute force, and the
#: stages against what they promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
