"""Station state expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dockwatch.schemas import NEAR_LIMIT


def is_offline(bikes: Column, docks: Column) -> Column:
    """Has docks on paper but reports neither bikes nor free docks."""
    return (bikes == 0) & (docks == 0)


def is_valid(bikes: Column, docks: Column, total: Column) -> Column:
    return (total > 0) & ~is_offline(bikes, docks)


def status(bikes: Column, docks: Column, total: Column) -> Column:
    """First matching rung of the status ladder."""
    return (F.when(total.isNull() | (total == 0), "offline")
            .when(is_offline(bikes, docks), "offline")
            .when(bikes == 0, "empty")
            .when(docks == 0, "full")
            .when(bikes <= NEAR_LIMIT, "near_empty")
            .when(docks <= NEAR_LIMIT, "near_full")
            .otherwise("normal"))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, NULL where y is 0."""
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


def steady_round(x: Column, digits: int) -> Column:
    """Round with ties going up whatever order the parts were added in.

    A mean such as 0.29375 comes out a few 1e-17 higher or lower depending on
    how rows were partitioned; the nudge is far above that noise and far below
    the last digit kept.
    """
    return F.round(x + F.lit(1e-9), digits)


def occupancy(bikes: Column, total: Column) -> Column:
    return steady_round(safe_ratio(bikes, total), 4)


def share(cond: Column) -> Column:
    """Share of rows where cond holds (rows where it is NULL count as no)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def tally(cond: Column) -> Column:
    return F.count_if(cond)


def only_empty(bikes: Column, docks: Column) -> Column:
    return (bikes == 0) & (docks > 0)


def only_full(bikes: Column, docks: Column) -> Column:
    return (docks == 0) & (bikes > 0)


def at_risk(bikes: Column, docks: Column) -> Column:
    """Near or at a limit, offline stations aside."""
    return ((bikes <= NEAR_LIMIT) | (docks <= NEAR_LIMIT)) & ~is_offline(bikes, docks)


def active(always_empty: Column) -> Column:
    """Station takes part; an unknown flag counts as taking part."""
    return ~F.coalesce(always_empty, F.lit(False))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def whole(x: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(x).cast("int")


def severity(level: Column) -> Column:
    """Sort key of a level: critical first."""
    return F.when(level == "critical", 0).when(level == "warning", 1).otherwise(2)


def level_rank(level: Column) -> Column:
    """1 notice, 2 warning, 3 critical; NULL for anything else."""
    return F.when(level == "notice", 1).when(level == "warning", 2).when(level == "critical", 3)
