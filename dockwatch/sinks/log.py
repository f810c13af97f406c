"""A log written batch by batch: one folder per epoch, folded into days that are published.

A batch writes its own folder, and writes the same folder if it is run again. ``fold``
moves what lies in folders into a table of days and rewrites only the days they touch,
so a log of any age is a table of days and at most FOLD_EVERY folders. Base rows keep
their epoch: a fold that died half-way is repeated without a row counted twice, and
readers leave out base rows of epochs that still have a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dockwatch.session import stage
from dockwatch.sinks.tables import children, drop_path, publish_days, read_days

FOLD_EVERY = 20


def write_epoch(rows: DataFrame, root: str, epoch: int) -> None:
    """The rows of one batch; they have a column ``day`` (date) to be folded by."""
    rows.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")


def open_epochs(spark: SparkSession, root: str) -> list[int]:
    """Epochs that lie in folders of their own, oldest first."""
    return sorted(int(name.split("=", 1)[1]) for name in children(spark, root, "epoch=*"))


def _open_rows(spark: SparkSession, root: str, schema: T.StructType, epochs: list[int]) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("epoch", T.IntegerType())])
    if not epochs:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/epoch={e}" for e in epochs])


def _base(spark: SparkSession, root: str, schema: T.StructType, without: list[int]) -> DataFrame:
    # Days lie in folders; the column is in the files under another name.
    stored = T.StructType([*schema.fields, T.StructField("epoch", T.IntegerType()), T.StructField("on", T.DateType())])
    rows = read_days(spark, f"{root}/base", stored).withColumnRenamed("on", "day")
    return rows.filter(~F.col("epoch").isin(without)) if without else rows


def read_log(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All rows (``schema``, epoch and day), folded or not."""
    epochs = open_epochs(spark, root)
    return _base(spark, root, schema, epochs).unionByName(_open_rows(spark, root, schema, epochs))


def fold(spark: SparkSession, root: str, schema: T.StructType, every: int = FOLD_EVERY,
         keep_days: int | None = None, now: str | None = None) -> int:
    """Fold all folders into the days once there are ``every``; returns how many were folded."""
    epochs = open_epochs(spark, root)
    if len(epochs) < every:
        return 0
    fresh = stage(_open_rows(spark, root, schema, epochs), "fold")
    days = [r[0] for r in fresh.select("day").distinct().collect()]
    if days:
        old = _base(spark, root, schema, epochs).filter(F.col("day").isin(days))
        both = old.unionByName(fresh).withColumn("on", F.col("day"))
        publish_days(both, f"{root}/base", keep_days, now, spread="epoch")
    for e in epochs:
        drop_path(spark, f"{root}/epoch={e}")
    return len(epochs)
