"""Distance joins.

``pairs_within`` puts points into cells at least as wide as the search radius, so
partners sit in the 3 x 3 cells around a point and an equi-join finds them.

``nearest`` searches a quadtree. Both sides are cut into leaves of at most LEAF points,
however crowded a place is, by one aggregation over the cells of all levels. Leaves are
compared by the least and greatest distance of their boxes: once boxes with enough
points lie within some greatest distance, boxes that begin beyond it are out. Only
points of the remaining pairs of leaves meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dockwatch.functions.geo import distance_km
from dockwatch.operators.ordering import top_per_group
from dockwatch.schemas import KM_PER_DEGREE
from dockwatch.session import stage

LEAF = 16            # points of a leaf at most
FAN_BITS = 2         # a level divides the cell edge by 4
LEVELS = 8


def _rows_high(km: float) -> float:
    return km * 1.000001 / KM_PER_DEGREE


def _cell_row(lat: Column, km: float) -> Column:
    return F.floor(lat / F.lit(_rows_high(km)))


def _cell_col(row: Column, lon: Column, km: float) -> Column:
    """Column index; a cell is wide enough for any point one row above or below."""
    high = _rows_high(km)
    edge = F.least(F.lit(89.0), (F.abs(row) + F.lit(2)) * F.lit(high))
    return F.floor(lon * F.cos(F.radians(edge)) / F.lit(high))


def _in_cells(points: DataFrame, km: float) -> DataFrame:
    return (points.withColumn("_row", _cell_row(F.col("lat"), km))
            .withColumn("_col", _cell_col(F.col("_row"), F.col("lon"), km)))


def _around(points: DataFrame, km: float) -> DataFrame:
    """Each point once per cell of the 3 x 3 block around it."""
    home = _cell_row(F.col("lat"), km)
    r = points.withColumn("_row", F.explode(F.sequence(home - 1, home + 1)))
    mid = _cell_col(F.col("_row"), F.col("lon"), km)
    return r.withColumn("_col", F.explode(F.sequence(mid - 1, mid + 1)))


def pairs_within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """All (left_id, right_id, km) at most ``km`` apart; both have id, lat, lon.

    Distance uses the left point's latitude. The output is as large as the
    question asks for, so prefer ``nearest`` where a few partners are enough.
    """
    a = _around(left.select(F.col("id").alias("left_id"), "lat", "lon"), km)
    b = _in_cells(right.select(F.col("id").alias("right_id"), "lat", "lon"), km).select(
        "right_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "_row", "_col")
    d = distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return (a.join(b, ["_row", "_col"]).filter(F.col("left_id") != F.col("right_id"))
            .withColumn("km", d).filter(F.col("km") <= F.lit(km))
            .select("left_id", "right_id", "km"))


def _levels(points: DataFrame, km: float) -> DataFrame:
    """Each point once for every level: the cell ``row``, ``col`` of a raster that gets FAN times finer."""
    fine = F.lit(_edge(km, LEVELS))
    at = points.withColumns({"_y": F.floor(F.col("lat") / fine), "_x": F.floor(F.col("lon") / fine)})
    cells = F.explode(F.array(*[
        F.struct(F.lit(t).alias("level"), _up("_y", LEVELS - t).alias("row"), _up("_x", LEVELS - t).alias("col"))
        for t in range(LEVELS + 1)])).alias("cell")
    return at.select("id", "lat", "lon", cells).select("id", "lat", "lon", "cell.*")


def _edge(km: float, level: int) -> float:
    """Edge of a cell in degrees; level 0 is as wide as the search."""
    return _rows_high(km) / (1 << (FAN_BITS * level))


def _up(index: str | Column, levels: int | Column) -> Column:
    """The cell some levels up that holds a cell."""
    index = F.col(index) if isinstance(index, str) else index
    bits = F.lit(FAN_BITS * levels) if isinstance(levels, int) else levels * F.lit(FAN_BITS)
    return F.call_function("shiftright", index, bits.cast("int"))


CELL = ["level", "row", "col"]


def _boxes(levels: DataFrame) -> DataFrame:
    """Every occupied cell with its number of points and their box; ``is_leaf`` marks a partition of the points.

    A leaf is the largest cell on its points' path with at most LEAF points (or of the last level).
    """
    nodes = levels.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lon").alias("west"), F.max("lon").alias("east"))
    # At most FAN * FAN cells have the same parent.
    siblings = Window.partitionBy("level", _up("row", 1), _up("col", 1))
    parent = F.sum("n").over(siblings)
    small = (F.col("n") <= LEAF) | (F.col("level") == LEVELS)
    return nodes.withColumn("is_leaf", small & ((F.col("level") == 0) | (parent > LEAF)))


def _least_most(q: str, r: str) -> tuple[Column, Column]:
    """Least and greatest distance between points of two boxes; the cosine is taken in the first."""
    def c(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def gap(lo: str, hi: str) -> Column:
        return F.greatest(F.lit(0.0), c(r, lo) - c(q, hi), c(q, lo) - c(r, hi))

    def span(lo: str, hi: str) -> Column:
        return F.greatest(c(r, hi) - c(q, lo), c(q, hi) - c(r, lo))
    far = F.greatest(F.abs(c(q, "south")), F.abs(c(q, "north")))
    close = F.when((c(q, "south") < 0) & (c(q, "north") > 0), 0.0).otherwise(
        F.least(F.abs(c(q, "south")), F.abs(c(q, "north"))))

    def length(x: Column, y: Column, at: Column) -> Column:
        x = x * F.cos(F.radians(at))
        return F.lit(KM_PER_DEGREE) * F.sqrt(x * x + y * y)
    return (length(gap("west", "east"), gap("south", "north"), far),
            length(span("west", "east"), span("south", "north"), close))


def _renamed(boxes: DataFrame, prefix: str, *more: Column) -> DataFrame:
    return boxes.select(*[F.col(x).alias(f"{prefix}{x}") for x in (*CELL, "n", "south", "north", "west", "east")], *more)


def _ancestors(prefix: str, first: int = 0) -> Column:
    """All cells that hold a cell, itself included, as rows."""
    level = F.col(f"{prefix}level")
    return F.explode(F.transform(F.sequence(F.lit(first), level), lambda t: F.struct(
        t.alias("level"), _up(f"{prefix}row", level - t).alias("row"), _up(f"{prefix}col", level - t).alias("col"))))


def _within_reach(asking: DataFrame, boxes: DataFrame, k: int, km: float) -> DataFrame:
    """``asking`` leaves with ``reach``: no further than this lie k + 1 points, or the search ends there.

    Looks at the other side's boxes of the leaf itself and of the cells that hold it.
    """
    around = asking.select("*", _ancestors("q_").alias("a")).select("*", "a.*").drop("a")
    full = _renamed(boxes.filter(F.col("n") > k), "r_").withColumnsRenamed(
        {"r_level": "level", "r_row": "row", "r_col": "col"})
    _, most = _least_most("q_", "r_")
    keys = [x for x in asking.columns]
    return around.join(full, CELL, "left").groupBy(*keys).agg(
        F.least(F.lit(km), F.coalesce(F.min(most), F.lit(km))).alias("reach"))


def _leaf_pairs(left: DataFrame, right: DataFrame, k: int, km: float) -> DataFrame:
    """Pairs of leaves (q_level, q_row, q_col, r_level, r_row, r_col) that can hold one of the k nearest."""
    asking = _within_reach(_renamed(left.filter("is_leaf"), "q_"), right, k, km)
    # A raster whose cells are about as wide as the reach: a few of them cover it.
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(
        F.log2(F.lit(km) / F.greatest("reach", F.lit(1e-9))) / F.lit(FAN_BITS)))).cast("int")
    dy = F.col("reach") * F.lit(1.000001 / KM_PER_DEGREE) + F.lit(1e-9)
    far = F.least(F.lit(89.0), F.greatest(F.abs(F.col("q_south")), F.abs(F.col("q_north"))))
    dx = dy / F.cos(F.radians(far))
    fine = F.lit(_edge(km, LEVELS))

    def covered(lo: Column, hi: Column) -> Column:
        up = F.lit(LEVELS) - F.col("_level")
        return F.sequence(_up(F.floor(lo / fine), up), _up(F.floor(hi / fine), up))
    asking = asking.withColumn("_level", level).withColumns({
        "_rows": covered(F.col("q_south") - dy, F.col("q_north") + dy),
        "_cols": covered(F.col("q_west") - dx, F.col("q_east") + dx)})
    inside = F.flatten(F.transform("_rows", lambda r: F.transform("_cols", lambda c: F.struct(
        F.col("_level").alias("level"), r.alias("row"), c.alias("col"), F.lit(False).alias("whole")))))
    # Leaves wider than the raster hold its cells.
    wider = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.col("_level")), lambda d: F.transform(
        inside, lambda x: F.struct((x["level"] - d).alias("level"), _up(x["row"], d).alias("row"),
                                   _up(x["col"], d).alias("col"), F.lit(True).alias("whole"))))))
    cells = F.when(F.col("_level") > 0, F.concat(inside, wider)).otherwise(inside)
    asking = asking.select(*[x for x in asking.columns if not x.startswith("_")], F.explode(cells).alias("a")).select(
        "*", "a.*").drop("a")
    there = _renamed(right.filter("is_leaf"), "r_").select("*", _ancestors("r_").alias("a")).select("*", "a.*").drop("a")
    least, most = _least_most("q_", "r_")
    met = asking.join(there, CELL).filter(~F.col("whole") | (F.col("level") == F.col("r_level")))
    met = met.withColumns({"least": least, "most": most}).filter(F.col("least") <= F.col("reach") + F.lit(1e-6))
    own = ["q_level", "q_row", "q_col"]
    upto = Window.partitionBy(*own).orderBy("most").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("_seen", F.sum("r_n").over(upto))
    enough = F.min(F.when(F.col("_seen") > k, F.col("most"))).over(Window.partitionBy(*own))
    # A hair of slack keeps ties after rounding.
    met = met.withColumn("_limit", F.coalesce(F.least(enough, "reach"), "reach") + F.lit(1e-6))
    return met.filter(F.col("least") <= F.col("_limit")).select(*own, "r_level", "r_row", "r_col")


def candidate_pairs(left: DataFrame, right: DataFrame, k: int, km: float) -> DataFrame:
    """Pairs (left_id, right_id, km) within ``km`` that leave no better partner out; what ``nearest`` ranks."""
    useful = top_per_group(right.select("id", "lat", "lon"), ["lat", "lon"], [F.col("id")], k + 1, "_same").drop("_same")
    a, b = _levels(left.select("id", "lat", "lon"), km), _levels(useful, km)
    # A few narrow rows for each leaf, read by every step below.
    a_boxes, b_boxes = stage(_boxes(a), "boxes"), stage(_boxes(b), "boxes")
    pairs = _leaf_pairs(a_boxes, b_boxes, k, km)

    def members(levels: DataFrame, boxes: DataFrame, prefix: str) -> DataFrame:
        leaves = boxes.filter("is_leaf").select(*CELL)
        return levels.join(leaves, CELL).withColumnsRenamed({x: f"{prefix}{x}" for x in CELL})
    asked = members(a, a_boxes, "q_").withColumnsRenamed({"id": "left_id", "lat": "_lat", "lon": "_lon"})
    held = members(b, b_boxes, "r_").withColumnRenamed("id", "right_id")
    d = distance_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    return (asked.join(pairs, ["q_level", "q_row", "q_col"]).join(held, ["r_level", "r_row", "r_col"])
            .filter(F.col("left_id") != F.col("right_id")).withColumn("km", d).filter(F.col("km") <= F.lit(km))
            .select("left_id", "right_id", "km"))


def nearest(left: DataFrame, right: DataFrame, k: int, km: float) -> DataFrame:
    """The k nearest right points of every left point within ``km``.

    Equal distances (to 9 decimals) go to the smaller id. Exact for any layout: at most
    k + 1 right points of one identical place can ever be chosen, so the others are left
    out, and leaves are dropped by distances no point of them can beat. The levels reach from ``km`` down to a 65,536th of it.
    """
    return top_per_group(candidate_pairs(left, right, k, km), ["left_id"],
                         [F.round("km", 9), F.col("right_id")], k)
