"""Polygons as covers of square cells of several sizes, and points joined to them by cell.

A cell of level l is 360 / 2**l degrees wide. A polygon's box meets at most 4 x 4 cells of its
first level; those that no edge touches are inside or outside whole, the others are split into
16 cells of two levels finer, of which the ones outside are dropped. A point is looked up by equality in its
cell of each level that the covers use. Only points in boundary cells need ray casting.

Levels are even, so a table of polygons of all sizes uses few of them: twelve from 100 km to 1 m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.functions import geo

#: Cells of a box along its longer side at the first level, less one that it may touch at the end.
SIDE = 3
FINEST = 26
#: A cover is broadcast if it cannot have more bytes than this: as many cells as a box can have at the second level, each with the polygon and all that goes with it.
BROADCAST_BYTES = 64 << 20
MOST_CELLS = (SIDE + 1) ** 2 * 16
OUTSIDE, BOUNDARY, INSIDE = 0, 1, 2


def _width(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _mark(level: Column, x: Column, y: Column, ring: Column) -> Column:
    """OUTSIDE, BOUNDARY or INSIDE; cells count a trifle larger, so that rounding never makes a boundary cell whole."""

    def mark(c: Column) -> Column:
        def from_centre(e: Column) -> Column:
            return F.struct((e["a"]["lng"] - c["x"]).alias("ax"), (e["a"]["lat"] - c["y"]).alias("ay"), (e["b"]["lng"] - c["x"]).alias("bx"), (e["b"]["lat"] - c["y"]).alias("by"))

        def touched(e: Column) -> Column:
            near = (F.least(e["ax"], e["bx"]) <= c["reach"]) & (F.greatest(e["ax"], e["bx"]) >= -c["reach"]) & (F.least(e["ay"], e["by"]) <= c["reach"]) & (F.greatest(e["ay"], e["by"]) >= -c["reach"])
            # the line through the edge passes within the cell's extent along its normal
            dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
            return near & (F.abs(dx * e["ay"] - dy * e["ax"]) <= c["reach"] * (F.abs(dx) + F.abs(dy)))

        whole = F.when(geo.within_edges(c["y"], c["x"], ring), INSIDE).otherwise(OUTSIDE)
        return F.when(F.exists(F.transform(ring, from_centre), touched), BOUNDARY).otherwise(whole)

    centre = lambda w: F.struct(((x + 0.5) * w).alias("x"), ((y + 0.5) * w).alias("y"), (w * 0.5000005 + 1e-12).alias("reach"))
    return geo.given(geo.given(_width(level), centre), mark)


def _sized(zones: DataFrame, widest: float | None) -> DataFrame:
    """``zones`` with a polygon, its box, edges and first level."""
    box = geo.box_of(F.col("polygon"))
    span = F.greatest(box["max_lat"] - box["min_lat"], box["max_lng"] - box["min_lng"])
    level = F.when(span > 0, F.floor(F.log2(SIDE * 360.0 / span) / 2) * 2).otherwise(FINEST)
    if widest is not None:
        level = F.greatest(level, F.ceil(F.log2(F.lit(360.0 / widest)) / 2) * 2)
    return zones.where(F.size("polygon") > 0).withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(FINEST), level)).cast("int")).withColumns(box).withColumn("_ring", geo.edges(F.col("polygon")))


def cover(zones: DataFrame, widest: float | None = None) -> DataFrame:
    """``zones`` once for each cell of their ``polygon``, with _level, _x, _y and _inside.

    ``widest`` bounds the cells of the first level, in degrees.
    """
    columns, sized = [c for c in zones.columns if c != "polygon"], _sized(zones, widest)
    place = lambda c: F.floor(F.col(c) / _width(F.col("_level")))
    row = sized.select(*columns, "polygon", "_ring", "_level", F.explode(F.sequence(place("min_lng"), place("max_lng"))).alias("_x"), "min_lat", "max_lat")
    cells = row.select(*columns, "polygon", "_ring", "_level", "_x", F.explode(F.sequence(place("min_lat"), place("max_lat"))).alias("_y"))
    marked = cells.withColumn("_mark", _mark(F.col("_level"), F.col("_x"), F.col("_y"), F.col("_ring"))).where(F.col("_mark") != OUTSIDE)
    own = F.array(F.struct(F.col("_level").alias("l"), F.col("_x").alias("x"), F.col("_y").alias("y")))
    finer = F.array(*[F.struct((F.col("_level") + 2).alias("l"), (F.col("_x") * 4 + i).alias("x"), (F.col("_y") * 4 + j).alias("y")) for i in range(4) for j in range(4)])
    parts = marked.select(*columns, "polygon", "_ring", "_mark", F.explode(F.when(F.col("_mark") == INSIDE, own).otherwise(finer)).alias("_c"))
    again = F.when(F.col("_mark") == INSIDE, INSIDE).otherwise(_mark(F.col("_c.l"), F.col("_c.x"), F.col("_c.y"), F.col("_ring")))
    done = parts.withColumn("_mark", again).where(F.col("_mark") != OUTSIDE)
    return done.select(*columns, "polygon", F.col("_c.l").alias("_level"), F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"), (F.col("_mark") == INSIDE).alias("_inside"))


def join_cover(points: DataFrame, zones: DataFrame, *, widest: float | None = None, most_zones: int | None = None) -> DataFrame:
    """Points with the columns of each zone whose polygon holds them; points without coordinates are in none.

    A small job over the zones tells their levels and how large the cover can be at most, which decides about the broadcast.
    """
    width = F.size("polygon") * 16 + F.octet_length(F.to_json(F.struct(*zones.columns))) + 64
    facts = _sized(zones, widest).agg(F.collect_set("_level").alias("levels"), F.sum(width * MOST_CELLS).alias("bytes"), F.count(F.lit(1)).alias("zones")).first()
    small = widest is None and (facts["bytes"] or 0) <= BROADCAST_BYTES and (most_zones is None or facts["zones"] <= most_zones)
    own = cover(zones, widest)
    levels = sorted({x for level in facts["levels"] for x in (level, level + 2)})  # FINEST + 4 at most
    at = [F.struct(F.lit(l).alias("l"), F.floor(F.col("lng") / (360.0 / 2.0**l)).alias("x"), F.floor(F.col("lat") / (360.0 / 2.0**l)).alias("y")) for l in levels]
    none = F.array().cast("array<struct<l:int,x:bigint,y:bigint>>")
    keyed = points.withColumn("_at", F.explode(F.array(*at) if at else none)).alias("p")
    side = own.select(*[F.col(c).alias(f"_z_{c}") for c in own.columns]).alias("z")
    hit = F.col("_z__inside") | geo.point_in_polygon(F.col("p.lat"), F.col("p.lng"), F.col("_z_polygon"))
    on = (F.col("_at.l") == F.col("_z__level")) & (F.col("_at.x") == F.col("_z__x")) & (F.col("_at.y") == F.col("_z__y")) & hit
    joined = keyed.join(F.broadcast(side) if small else side, on)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"_z_{c}").alias(c) for c in zones.columns])
