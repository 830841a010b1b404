"""Geometry as native expressions: distances, polygons, boxes, projections, GeoJSON.

Polygons are arrays of struct<lng, lat> without a repeated last vertex; coordinates are WGS 84.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlark.config import EARTH_M

METRES_PER_DEGREE = EARTH_M * 3.141592653589793 / 180


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def edges(polygon: Column) -> Column:
    """Polygon edges as structs of both ends."""
    n = F.size(polygon)
    at = lambda i: F.get(polygon, i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i).alias("a"), at((i + 1) % n).alias("b")))


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edges(lat: Column, lng: Column, ring: Column) -> Column:
    """Ray casting to the east over a ring's edges; they are half-open, so a shared vertex counts once."""

    def hit(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        x = a["lng"] + (lat - a["lat"]) / F.when(b["lat"] == a["lat"], F.lit(1.0)).otherwise(b["lat"] - a["lat"]) * (b["lng"] - a["lng"])
        return (spans & (lng < x)).cast("int")

    return F.aggregate(F.transform(ring, hit), F.lit(0), lambda s, h: s + h) % 2 == 1


def point_in_polygon(lat: Column, lng: Column, polygon: Column) -> Column:
    return within_edges(lat, lng, edges(polygon))


def edge_distance(lat: Column, lng: Column, polygon: Column) -> Column:
    """Metres to the nearest polygon edge, in a local plane."""
    scale = F.cos(F.radians(lat)) * METRES_PER_DEGREE

    def far(e: Column) -> Column:
        ax, ay = (e["a"]["lng"] - lng) * scale, (e["a"]["lat"] - lat) * METRES_PER_DEGREE
        bx, by = (e["b"]["lng"] - lng) * scale, (e["b"]["lat"] - lat) * METRES_PER_DEGREE
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length)))
        return F.hypot(ax + t * dx, ay + t * dy)

    return F.array_min(F.transform(edges(polygon), far))


def within_buffer(lat: Column, lng: Column, polygon: Column, metres: float) -> Column:
    return point_in_polygon(lat, lng, polygon) | (edge_distance(lat, lng, polygon) <= metres)


def crosses(px: Column, py: Column, qx: Column, qy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether segment pq properly crosses segment ab."""
    side = lambda ox, oy, dx, dy, x, y: F.signum((dx - ox) * (y - oy) - (dy - oy) * (x - ox))
    return (side(ax, ay, bx, by, px, py) * side(ax, ay, bx, by, qx, qy) < 0) & (side(px, py, qx, qy, ax, ay) * side(px, py, qx, qy, bx, by) < 0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes struct<x1, y1, x2, y2>; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def centroid(polygon: Column) -> Column:
    """Area centroid as struct<lng, lat>; the vertex mean for flat polygons."""
    cross = lambda e: e["a"]["lng"] * e["b"]["lat"] - e["b"]["lng"] * e["a"]["lat"]
    total = lambda f: F.aggregate(F.transform(edges(polygon), f), F.lit(0.0), lambda s, x: s + x)
    area = total(cross) / 2
    mean = lambda c: F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[c]) / F.size(polygon)
    part = lambda c: total(lambda e: (e["a"][c] + e["b"][c]) * cross(e)) / (6 * area)
    flat = F.abs(area) < 1e-18
    return F.struct(F.when(flat, mean("lng")).otherwise(part("lng")).alias("lng"), F.when(flat, mean("lat")).otherwise(part("lat")).alias("lat"))


def gsd(height_m: Column, sensor_mm: Column, focal_mm: Column, image_px: Column) -> Column:
    """Ground sampling distance in metres a pixel."""
    return (height_m * sensor_mm) / (focal_mm * image_px)


def pixel_to_gps(x: Column, y: Column, width: Column, height: Column, gsd_m: Column, yaw_deg: Column, lat: Column, lng: Column) -> Column:
    """A pixel of a nadir image as struct<lng, lat>: offset from the centre, turned by yaw, in a local plane."""
    right, up = (x - width / 2) * gsd_m, (height / 2 - y) * gsd_m
    yaw = F.radians(yaw_deg)
    east = right * F.cos(yaw) + up * F.sin(yaw)
    north = up * F.cos(yaw) - right * F.sin(yaw)
    return F.struct((lng + east / (METRES_PER_DEGREE * F.cos(F.radians(lat)))).alias("lng"), (lat + north / METRES_PER_DEGREE).alias("lat"))


def pixel_ray(x: Column, y: Column, width: Column, height: Column, focal_px: Column, yaw_deg: Column, pitch_deg: Column, roll_deg: Column) -> Column:
    """Direction of a pixel's ray as struct<east, north, down>.

    Level and looking ahead at yaw 0, the camera looks north, with its right side east. Yaw turns it clockwise as seen from
    above, pitch raises its axis (-90 looks straight down), roll then turns it clockwise about its axis.
    """
    yaw, pitch, roll = F.radians(yaw_deg), F.radians(pitch_deg), F.radians(roll_deg)
    # in the image: ahead 1, right and down in focal lengths; roll about the axis, pitch about the right side, yaw about the vertical
    u, v = (x - width / 2) / focal_px, (y - height / 2) / focal_px
    right, below = u * F.cos(roll) - v * F.sin(roll), u * F.sin(roll) + v * F.cos(roll)
    ahead, down = F.cos(pitch) + below * F.sin(pitch), below * F.cos(pitch) - F.sin(pitch)
    return F.struct((ahead * F.sin(yaw) + right * F.cos(yaw)).alias("east"), (ahead * F.cos(yaw) - right * F.sin(yaw)).alias("north"), down.alias("down"))


def pixel_to_ground(x: Column, y: Column, width: Column, height: Column, focal_px: Column, yaw_deg: Column, pitch_deg: Column, roll_deg: Column, alt_m: Column, lat: Column, lng: Column, most_m: float = 10_000.0) -> Column:
    """Where a pixel's ray meets the ground plane below the camera, struct<lng, lat>, in a local plane.

    Null at and above the horizon, beyond ``most_m`` (where a plane is no ground any more) and for a camera on the ground.
    """

    def meet(ray: Column) -> Column:
        times = F.try_divide(alt_m, ray["down"])
        east, north = ray["east"] * times, ray["north"] * times
        seen = (alt_m > 0) & (ray["down"] > 0) & (F.hypot(east, north) <= most_m)
        return F.when(seen, F.struct((lng + east / (METRES_PER_DEGREE * F.cos(F.radians(lat)))).alias("lng"), (lat + north / METRES_PER_DEGREE).alias("lat")))

    return given(pixel_ray(x, y, width, height, focal_px, yaw_deg, pitch_deg, roll_deg), meet)


#: WGS 84's semi-major axis in metres, its flattening, and the scale, false easting and (in the south) false northing of UTM.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _meridian() -> tuple[float, list[float], list[float], list[float]]:
    """Rectifying radius, and the series in the third flattening n, to n**4: forward, inverse, and from conformal to geographic latitude."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    back = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, forward, inverse, back


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def utm_zone(lng: Column) -> Column:
    """Zone 1 to 60 of a longitude, each six degrees wide."""
    return (F.pmod(F.floor((lng + 180) / 6), F.lit(60)) + 1).cast("int")


def to_utm(lat: Column, lng: Column, zone: Column | None = None) -> Column:
    """Transverse Mercator of a UTM zone (the longitude's own by default), struct<zone, north, x, y>: metres east and north.

    Below a tenth of a millimetre within a zone; null beyond 84 degrees of latitude, where UTM ends.
    """
    radius, forward, _, _ = _meridian()
    ecc = (WGS84_F * (2 - WGS84_F)) ** 0.5
    zone = utm_zone(lng) if zone is None else zone

    def project(g: Column) -> Column:
        t = F.sinh(F.atanh(F.sin(g["phi"])) - ecc * F.atanh(ecc * F.sin(g["phi"])))
        return given(F.struct(F.atan2(t, F.cos(g["away"])).alias("xi"), F.atanh(F.sin(g["away"]) / F.sqrt(1 + t * t)).alias("eta"), g["zone"].alias("zone"), (g["phi"] >= 0).alias("north")), place)

    def place(p: Column) -> Column:
        x = p["eta"] + _sum([a * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"]) for k, a in enumerate(forward, 1)])
        y = p["xi"] + _sum([a * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"]) for k, a in enumerate(forward, 1)])
        south = F.when(p["north"], 0.0).otherwise(UTM_SOUTH)
        return F.struct(p["zone"].alias("zone"), p["north"].alias("north"), (UTM_EAST + UTM_SCALE * radius * x).alias("x"), (south + UTM_SCALE * radius * y).alias("y"))

    away = F.radians(lng - (zone * 6 - 183))
    return F.when(F.abs(lat) <= 84, given(F.struct(F.radians(lat).alias("phi"), away.alias("away"), zone.alias("zone")), project))


def from_utm(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """The way back: struct<lng, lat>."""
    radius, _, inverse, back = _meridian()

    def spread(p: Column) -> Column:
        xi = p["y"] - _sum([b * F.sin(2 * k * p["y"]) * F.cosh(2 * k * p["x"]) for k, b in enumerate(inverse, 1)])
        eta = p["x"] - _sum([b * F.cos(2 * k * p["y"]) * F.sinh(2 * k * p["x"]) for k, b in enumerate(inverse, 1)])
        return given(F.struct(xi.alias("xi"), eta.alias("eta")), lambda q: given(F.struct(F.asin(F.sin(q["xi"]) / F.cosh(q["eta"])).alias("chi"), F.atan2(F.sinh(q["eta"]), F.cos(q["xi"])).alias("away")), geographic))

    def geographic(q: Column) -> Column:
        lat = q["chi"] + _sum([d * F.sin(2 * k * q["chi"]) for k, d in enumerate(back, 1)])
        return F.struct((F.degrees(q["away"]) + zone * 6 - 183).alias("lng"), F.degrees(lat).alias("lat"))

    plane = UTM_SCALE * radius
    return given(F.struct(((x - UTM_EAST) / plane).alias("x"), ((y - F.when(north, 0.0).otherwise(UTM_SOUTH)) / plane).alias("y")), spread)


def web_mercator(lat: Column, lng: Column) -> Column:
    """WGS 84 to spherical Mercator metres, struct<x, y>."""
    r = 6378137.0
    return F.struct((F.radians(lng) * r).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483)) * r).alias("y"))


def cell(lat: Column, lng: Column, metres: float, most_lat: float) -> tuple[Column, Column]:
    """Grid cell of at least ``metres`` both ways for all |lat| up to ``most_lat``."""
    dlat = metres / METRES_PER_DEGREE * 1.0001
    dlng = dlat / max(1e-6, math.cos(math.radians(min(most_lat, 89.9))))
    return F.floor(lat / dlat), F.floor(lng / dlng)


def box_of(polygon: Column) -> dict[str, Column]:
    part = lambda c: F.transform(polygon, lambda p: p[c])
    return {"min_lat": F.array_min(part("lat")), "max_lat": F.array_max(part("lat")), "min_lng": F.array_min(part("lng")), "max_lng": F.array_max(part("lng"))}


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def point_geojson(lat: Column, lng: Column, properties: Column) -> Column:
    """A GeoJSON Feature as text."""
    return _feature("Point", F.array(lng, lat), properties)


def line_geojson(line: Column, properties: Column) -> Column:
    """A LineString Feature of an array<struct<lng, lat>>; null for fewer than two places."""
    return F.when(F.size(line) >= 2, _feature("LineString", F.transform(line, lambda p: F.array(p["lng"], p["lat"])), properties))


def polygon_geojson(polygon: Column, properties: Column) -> Column:
    """A Polygon Feature of one ring, counter-clockwise as the format asks and with its first place repeated at the end; null for fewer than three places."""
    doubled = F.aggregate(edges(polygon), F.lit(0.0), lambda s, e: s + e["a"]["lng"] * e["b"]["lat"] - e["b"]["lng"] * e["a"]["lat"])
    ring = given(F.when(doubled < 0, F.reverse(polygon)).otherwise(polygon), lambda r: F.concat(r, F.slice(r, 1, 1)))
    return F.when(F.size(polygon) >= 3, _feature("Polygon", F.array(F.transform(ring, lambda p: F.array(p["lng"], p["lat"]))), properties))


def _places(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda c: F.struct(F.get(c, F.lit(0)).alias("lng"), F.get(c, F.lit(1)).alias("lat")))


def from_line_geojson(text: Column) -> Column:
    """array<struct<lng, lat>> of a LineString feature; null for others."""
    parsed = F.from_json(text, "geometry struct<type:string,coordinates:array<array<double>>>")["geometry"]
    return F.when(parsed["type"] == "LineString", _places(parsed["coordinates"]))


def from_polygon_geojson(text: Column) -> Column:
    """The outer ring of a Polygon feature, without the repeated place; null for others."""
    parsed = F.from_json(text, "geometry struct<type:string,coordinates:array<array<array<double>>>>")["geometry"]
    open_ = lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    return F.when(parsed["type"] == "Polygon", given(_places(F.get(parsed["coordinates"], F.lit(0))), open_))


def from_point_geojson(text: Column) -> Column:
    """struct<lng, lat> of a Point feature."""
    parsed = F.from_json(text, "type string, geometry struct<type:string,coordinates:array<double>>")
    return F.struct(F.get(parsed["geometry"]["coordinates"], F.lit(0)).alias("lng"), F.get(parsed["geometry"]["coordinates"], F.lit(1)).alias("lat"))
