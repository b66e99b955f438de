"""Areas: polygons cut by grid cells, weights of cells, nearest places, sizes of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.operators.grids import ring_area
from nimbora.operators.reductions import plain_longitude, quarter

#: Kilometres of a degree of latitude, for plane areas of small regions.
KM = 111.195


#: The type of a ring.
RING = "array<struct<x:double,y:double>>"


def _cut(ring: Column, side: Column) -> Column:
    """The part of a ring (array of (x, y), not closed) on one side of a line; ``side`` has axis, bound and above."""
    n, none = F.size(ring), F.array().cast(RING)
    along = lambda p: F.when(side["axis"] == "x", p["x"]).otherwise(p["y"])
    inside = lambda p: F.when(side["above"], along(p) >= side["bound"]).otherwise(along(p) <= side["bound"])

    def step(kept: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        t = (side["bound"] - along(a)) / (along(b) - along(a))
        at = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
        return F.concat(kept, F.when(inside(a) != inside(b), F.array(at)).otherwise(none), F.when(inside(b), F.array(b)).otherwise(none))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), none, step)).otherwise(none)


def with_overlap(rows: DataFrame, ring: str = "ring", box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Adds ``overlap``: the area that a ring shares with a box, by cutting the ring at the box's four sides in turn."""
    start = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    sides = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(side).cast("double").alias("bound"), F.lit(above).alias("above")) for axis, side, above in (("x", box[0], True), ("y", box[1], True), ("x", box[2], False), ("y", box[3], False))])
    # one expression: a filter on a column of columns would be written out many times over
    made = rows.withColumn("_ring", F.aggregate(sides, start, _cut))
    return made.withColumn("overlap", F.when(F.size("_ring") >= 3, ring_area(F.col("_ring"))).otherwise(0.0)).drop("_ring")


def cell_weights(regions: DataFrame, side: float) -> DataFrame:
    """region_id, ix, iy and weight: the area that each region (region_id, ring) shares with each cell of a grid.

    A region meets only the cells of its own bounds, which are named from its ring, so nothing is joined.
    """
    low = lambda c, f: F.floor(f(F.transform("ring", lambda p: p[c])) / side).cast("int")
    named = regions.select("region_id", "ring", F.explode(F.sequence(low("x", F.array_min), low("x", F.array_max))).alias("ix"), low("y", F.array_min).alias("_a"), low("y", F.array_max).alias("_b"))
    cells = named.select("region_id", "ring", "ix", F.explode(F.sequence("_a", "_b")).alias("iy"))
    boxed = cells.withColumns({"x0": F.col("ix") * side, "y0": F.col("iy") * side, "x1": (F.col("ix") + 1) * side, "y1": (F.col("iy") + 1) * side})
    return with_overlap(boxed).where("overlap > 0").select("region_id", "ix", "iy", F.col("overlap").alias("weight"))


def weighted_regions(cells: DataFrame, weights: DataFrame, registry: DataFrame, value: str) -> DataFrame:
    """Every region of ``registry`` (region_id) with the weighted mean of ``value`` over its cells (lat, lon), null where none is known.

    ``weights`` has lat, lon, region_id and weight; cells meet at the same quarter degree, longitudes as -180 to 180.
    """
    key = {"_la": quarter(F.col("lat")), "_lo": quarter(plain_longitude(F.col("lon")))}
    met = cells.withColumns(key).select("_la", "_lo", value).join(weights.withColumns(key).select("_la", "_lo", "region_id", "weight"), ["_la", "_lo"])
    w = F.when(F.col(value).isNotNull(), F.col("weight"))
    means = met.groupBy("region_id").agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("mean"))
    return registry.select("region_id").join(means, "region_id", "left")


def nearest(points: DataFrame, places: DataFrame, within: float = 1.5) -> DataFrame:
    """Each of ``points`` (point_id, x, y) with the nearest of ``places`` (place_id, x, y) no farther than ``within``, else null.

    Both are dealt into squares of that side; a place is set down in the nine around it, so points meet by equality.
    """
    def square(c: str) -> Column:
        return F.floor(F.col(c) / within).cast("long")

    around = F.explode(F.array(*[F.struct((square("x") + dx).alias("sx"), (square("y") + dy).alias("sy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    set_down = places.select("place_id", F.col("x").alias("px"), F.col("y").alias("py"), around.alias("s")).select("place_id", "px", "py", "s.sx", "s.sy")
    keyed = points.select("point_id", "x", "y", square("x").alias("sx"), square("y").alias("sy"))
    apart = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    met = keyed.join(set_down, ["sx", "sy"]).withColumn("apart", apart).where(F.col("apart") <= within)
    found = met.groupBy("point_id").agg(F.min(F.struct("apart", "place_id")).alias("m")).select("point_id", F.col("m.place_id").alias("place_id"), F.col("m.apart").alias("apart"))
    return points.select("point_id").join(found, "point_id", "left")


def descriptors(regions: DataFrame) -> DataFrame:
    """region_id, area_km2, the middle of the ring's corners, and the distance of that from the ring's nearest edge in km.

    Rings are in degrees, laid flat at their middle latitude.
    """
    mean = lambda c: F.aggregate(F.transform("ring", lambda p: p[c].cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size("ring")
    middle = regions.select("region_id", "ring", mean("x").alias("lon"), mean("y").alias("lat"))
    flat = F.transform("ring", lambda p: F.struct(((p["x"] - F.col("lon")) * F.cos(F.radians("lat")) * KM).alias("x"), ((p["y"] - F.col("lat")) * KM).alias("y")))
    laid = middle.withColumn("flat", flat)
    n = F.size("flat")

    def from_edge(i: Column) -> Column:
        a, b = F.get("flat", i), F.get("flat", (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(a["x"] * dx + a["y"] * dy), dx * dx + dy * dy), F.lit(0.0))))
        x, y = a["x"] + t * dx, a["y"] + t * dy
        return F.sqrt(x * x + y * y)

    edges = F.array_min(F.transform(F.sequence(F.lit(0), n - 1), from_edge))
    return laid.select("region_id", ring_area(F.col("flat")).alias("area_km2"), "lat", "lon", edges.alias("boundary_km"))
