"""The columns every question touches, as attributes.

A Column needs a running Spark context, so these are made on access and not
when a module is imported.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dockwatch.schemas import MODEL_EMPTY_MAX, MODEL_FULL_MAX


class _Columns:
    @property
    def bikes(self) -> Column:
        return F.col("bikes")

    @property
    def docks(self) -> Column:
        return F.col("docks_avail")

    @property
    def total(self) -> Column:
        return F.col("docks_total")

    @property
    def ratio(self) -> Column:
        return F.col("ratio")

    @property
    def model_empty(self) -> Column:
        return F.col("bikes") <= MODEL_EMPTY_MAX

    @property
    def model_full(self) -> Column:
        return F.col("docks_avail") <= MODEL_FULL_MAX

    @property
    def risk(self) -> Column:
        return F.greatest("proba_empty", "proba_full")


c = _Columns()
