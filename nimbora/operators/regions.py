"""Points in polygons by a cover of cells, and the chain by which a row finds its region.

Each polygon is laid over a grid. Cells that no edge touches lie wholly inside or outside it; points there need no test of the polygon.
Points meet cells by equality, and only those in cells on a border are tested against the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.operators.grids import inside
from nimbora.operators.ingest import plain_header
from nimbora.operators.ordered import written


def _touches(a: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment touches a box: their bounds meet, and the box's corners are not all on one side of the line."""
    def side(x: Column, y: Column) -> Column:
        return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])

    corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    apart = F.least(*corners) > 0
    other = F.greatest(*corners) < 0
    near = (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["y"], b["y"]) >= y0) & (F.least(a["y"], b["y"]) <= y1)
    return near & ~apart & ~other


def cover(regions: DataFrame, side: float) -> DataFrame:
    """The cells of a grid that regions (region_id, ring) have a part in: region_id, ring, ix, iy, border.

    Cells without ``border`` lie wholly inside and carry no ring. Only the cells of a region's bounds are named.
    """
    rings = regions.select("region_id", F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"))
    low = lambda c, f: F.floor(f(F.transform("ring", lambda p: p[c])) / side).cast("int")
    named = rings.select("region_id", "ring", F.explode(F.sequence(low("x", F.array_min), low("x", F.array_max))).alias("ix"), low("y", F.array_min).alias("_a"), low("y", F.array_max).alias("_b"))
    cells = named.select("region_id", "ring", "ix", F.explode(F.sequence("_a", "_b")).alias("iy"))
    x0, y0 = F.col("ix") * F.lit(float(side)), F.col("iy") * F.lit(float(side))
    n = F.size("ring")
    border = F.exists(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b"))), lambda e: _touches(e["a"], e["b"], x0, y0, x0 + side, y0 + side))
    told = cells.withColumn("border", border)
    middle = inside(x0 + side / 2, y0 + side / 2, F.col("ring"))
    return told.where(F.col("border") | middle).select("region_id", F.when(F.col("border"), F.col("ring")).alias("ring"), "ix", "iy", "border")


def points_in_regions(points: DataFrame, covered: DataFrame, side: float) -> DataFrame:
    """point_id, region_id of each of ``points`` (point_id, x, y) that lies in a region; the smallest region_id of several.

    ``covered`` comes from ``cover`` with the same ``side``.
    """
    cell = {c: F.floor(F.col(v) / side).cast("int") for c, v in (("ix", "x"), ("iy", "y"))}
    met = points.select("point_id", "x", "y").withColumns(cell).join(covered, ["ix", "iy"])
    held = met.where(~F.col("border") | inside(F.col("x"), F.col("y"), F.col("ring")))
    return held.groupBy("point_id").agg(F.min("region_id").alias("region_id"))


def _to_edge(x: Column, y: Column, ring: Column) -> Column:
    """The distance of a point from a ring's nearest edge."""
    n = F.size(ring)

    def one(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        px, py = a["x"] + t * dx - x, a["y"] + t * dy - y
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), one))


def nearest_region(points: DataFrame, regions: DataFrame, within: float = 1.5) -> DataFrame:
    """point_id, region_id, apart: for points outside all regions, the one whose edge is nearest and no farther than ``within``.

    A region is set down in the squares of that side that its bounds reach, widened by ``within``, so points meet it by equality.
    """
    low = lambda c, f, d: F.floor((f(F.transform("ring", lambda p: p[c].cast("double"))) + d) / within).cast("int")
    set_down = regions.select("region_id", "ring", F.explode(F.sequence(low("x", F.array_min, -within), low("x", F.array_max, within))).alias("sx"), low("y", F.array_min, -within).alias("_a"), low("y", F.array_max, within).alias("_b"))
    set_down = set_down.select("region_id", "ring", "sx", F.explode(F.sequence("_a", "_b")).alias("sy"))
    keyed = points.select("point_id", "x", "y", F.floor(F.col("x") / within).cast("int").alias("sx"), F.floor(F.col("y") / within).cast("int").alias("sy"))
    met = keyed.join(set_down, ["sx", "sy"]).withColumn("apart", _to_edge(F.col("x"), F.col("y"), F.col("ring"))).where(F.col("apart") <= within)
    return met.groupBy("point_id").agg(F.min(F.struct("apart", "region_id")).alias("m")).select("point_id", F.col("m.region_id").alias("region_id"), F.col("m.apart").alias("apart"))


def _only(names: DataFrame, keys: list[str], to: str) -> DataFrame:
    """The names that stand for one region alone."""
    known = names.where(" AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)).groupBy(*keys).agg(F.min("region_id").alias(to), F.count_distinct("region_id").alias("_n"))
    return known.where("_n = 1").drop("_n")


def look_up(rows: DataFrame, registry: DataFrame, states: DataFrame, rings: DataFrame, side: float = 0.25, within: float = 1.5) -> DataFrame:
    """Adds region_id and method to ``rows`` (row_id, name, state, x, y): the first of these that finds a region.

    The name as an id of ``registry`` (region_id, name, state) or ``states`` (region_id, name); the name and, where given, its state; the
    coordinates inside a ring of ``rings`` (region_id, ring); the nearest ring within ``within``; the name as a state's. A
    state's id or name is coarser than coordinates, so it counts only where those find nothing. Names are compared in their
    plain form, and one that stands for several regions finds none. Without any of these region_id and method are null.
    """
    asked = rows.withColumns({"_id": F.trim("name"), "_name": plain_header(F.col("name")), "_state": plain_header(F.col("state"))})
    plain = registry.select("region_id", plain_header(F.col("name")).alias("_name"), plain_header(F.col("state")).alias("_state"))
    ids = registry.select(F.col("region_id").alias("_by_id")).distinct()
    state_ids = states.select(F.col("region_id").alias("_by_state_id")).distinct()
    state_names = _only(states.select("region_id", plain_header(F.col("name")).alias("_name")), ["_name"], "_by_state")
    found = (
        asked.join(ids, F.col("_id") == F.col("_by_id").cast("string"), "left")
        .join(state_ids, F.col("_id") == F.col("_by_state_id").cast("string"), "left")
        .join(_only(plain, ["_name", "_state"], "_by_both"), ["_name", "_state"], "left")
        .join(_only(plain.select("region_id", "_name"), ["_name"], "_by_name"), "_name", "left")
        .join(state_names, "_name", "left")
    )
    told = written(found.withColumns({
        "_fine": F.coalesce("_by_id", F.when(F.coalesce(F.col("_state"), F.lit("")) != "", F.col("_by_both")).otherwise(F.col("_by_name"))),
        "_coarse": F.coalesce("_by_state_id", "_by_state"),
    }))
    points = told.where("_fine IS NULL AND x IS NOT NULL AND y IS NOT NULL").select(F.col("row_id").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    held = written(points_in_regions(points, cover(rings, side), side))
    near = nearest_region(points.join(held.select("point_id"), "point_id", "left_anti"), rings, within)
    met = told.join(held.select(F.col("point_id").alias("row_id"), F.col("region_id").alias("_held")), "row_id", "left").join(near.select(F.col("point_id").alias("row_id"), F.col("region_id").alias("_near")), "row_id", "left")
    ways = [("_by_id", "region_id"), ("_fine", "name"), ("_held", "point_in_polygon"), ("_near", "nearest_polygon"), ("_coarse", "state_name")]
    method = F.lit(None).cast("string")
    for c, name in reversed(ways):
        method = F.when(F.col(c).isNotNull(), name).otherwise(method)
    return met.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("region_id", "method")], F.coalesce(*[F.col(c) for c, _ in ways]).alias("region_id"), method.alias("method"))
