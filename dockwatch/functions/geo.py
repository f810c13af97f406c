"""Planar distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dockwatch.schemas import KM_PER_DEGREE


def distance_km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance; the cosine is taken at the first point."""
    dy = lat - lat2
    dx = (lon - lon2) * F.cos(F.radians(lat))
    return F.lit(KM_PER_DEGREE) * F.sqrt(dy * dy + dx * dx)
