"""What several corpus operators share: table access, row keys, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Word separators of the contracts: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """A hash of the text. Together with doc_id it names a row; rows equal in both are repeats."""
    return F.xxhash64(text)


def n_words(text: str | Column = "text") -> Column:
    """Number of words between separators; 0 for null, built-in functions only."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    edge = (F.element_at(parts, 1) == "").cast("int") + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - edge).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id`` and ``_key``, never null, which name a row up to repeats."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(
        "_key", text_key())


def first_of_repeats(df: DataFrame) -> DataFrame:
    """One of the rows that repeat ``_id`` and ``_key``. After a join on both it needs no further shuffle."""
    w = Window.partitionBy("_id", "_key").orderBy("_id")
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")
