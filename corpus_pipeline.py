"""From raw documents to packed sequences, as five stages of the corpus operators.

Each stage takes the documents that the one before it kept, as a table that was
written and is read again. The first two drop rows, the third rewrites texts, the
fourth repeats rows, the last returns pieces in sequences.

A stage sees the columns of documents (doc_id, text, lang, source, n_chars and
whatever else the table has) and returns the same, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dockwatch.llm import mixing, near, packing, substring, toxicity
from dockwatch.llm.common import table
from dockwatch.session import dropping_shuffles, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model, "_score").filter(F.col("_score") < 0.5).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity 0.8 or more.

    Candidates have SimHash fingerprints within three bits, or share a MinHash band; all are verified.
    """
    with dropping_shuffles(spark):
        return near.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word sequences that stand elsewhere too; other texts as they are."""
    out = substring.remove_repeats(docs, as_is=True)
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("kept_text").alias("text"), "n_chars": chars.alias("n_chars")}
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources have their weights."""
    with dropping_shuffles(spark):
        return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.placed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained network decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
