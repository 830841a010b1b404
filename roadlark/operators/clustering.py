"""Connected components, and DBSCAN by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.config import CLUSTER_M, CLUSTER_MIN, EARTH_M
from roadlark.functions.geo import METRES_PER_DEGREE, haversine
from roadlark.session import checkpointed

#: Parts of a cell's side in which core points are boxed, where two cells' outermost points do not decide.
PARTS = 4


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of all nodes with an edge (a, b).

    Labels spread along edges and then jump to their label's label, so long chains take a
    logarithmic number of steps; each step is checkpointed, and they go on until one changes nothing.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("node"), F.col("l").alias("component")))
    changed = not labels.isEmpty()
    while changed:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        spread = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = spread.join(spread.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
        new = checkpointed(jump.select("node", "old", F.coalesce("further", "component").alias("component")))
        changed = not new.where("component <> old").isEmpty()
        labels = new.select("node", "component")
    return labels


class Grid:
    """Cells no two points of which are over ``metres`` apart: rows of latitude, each cut by its own width."""

    def __init__(self, metres: float):
        self.metres, self.height = metres, metres / math.sqrt(2) / METRES_PER_DEGREE * 0.9999

    def width(self, row: Column) -> Column:
        nearest = F.when(row >= 0, row).otherwise(-1 - row) * self.height  # the row's least |latitude|
        return F.lit(self.height) / F.greatest(F.cos(F.radians(nearest)), F.lit(1e-6))

    def place(self, lat: Column, lng: Column) -> list[Column]:
        row = F.floor(lat / self.height)
        return [row.alias("row"), F.floor(lng / self.width(row)).alias("col")]

    def around(self, row: Column, col: Column) -> Column:
        """Cells (row, col) that may hold a point within ``metres`` of one of this cell."""
        furthest = F.least(F.lit(89.999), (F.abs(row) + 3) * self.height)
        reach = F.lit(self.metres / METRES_PER_DEGREE * 1.001) / F.cos(F.radians(furthest))
        low, high = col * self.width(row) - reach, (col + 1) * self.width(row) + reach
        cells = lambda r: F.transform(F.sequence(F.floor(low / self.width(r)), F.floor(high / self.width(r))), lambda c: F.struct(r.alias("row"), c.alias("col")))
        return F.flatten(F.transform(F.sequence(row - 2, row + 2), cells))


def _box_distances(a: str, b: str) -> tuple[Column, Column]:
    """(least, most) metres between points of two boxes with columns {a}south, {a}north, {a}west, {a}east."""
    c = lambda name: F.col(name)
    gap = lambda lo, hi: F.greatest(F.lit(0.0), c(a + lo) - c(b + hi), c(b + lo) - c(a + hi))
    span = lambda lo, hi: F.greatest(c(a + hi) - c(b + lo), c(b + hi) - c(a + lo))
    sides = [c(x + y) for x in (a, b) for y in ("south", "north")]
    flattest = F.when((F.least(*sides) < 0) & (F.greatest(*sides) > 0), 0.0).otherwise(F.least(*map(F.abs, sides)))
    steepest = F.greatest(*map(F.abs, sides))

    def metres(dlat: Column, dlng: Column, lat: Column) -> Column:
        h = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.pow(F.cos(F.radians(lat)) * F.sin(F.radians(dlng) / 2), 2)
        return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    return metres(gap("south", "north"), gap("west", "east"), steepest), metres(span("south", "north"), span("west", "east"), flattest)


def _box(prefix: str) -> list[Column]:
    return [F.min("lat").alias(prefix + "south"), F.max("lat").alias(prefix + "north"), F.min("lng").alias(prefix + "west"), F.max("lng").alias(prefix + "east")]


def _cell_edges(core: DataFrame, near: DataFrame, grid: Grid) -> DataFrame:
    """(a, b) of cells, named by their smallest core id, with core points at most ``metres`` apart.

    The outermost points of both cells decide most pairs; boxes around parts of the cells most
    others; only the points of parts that may be either side of the limit are compared.
    """
    ends = [F.struct(f(c, by).alias("lat"), f(d, by).alias("lng")) for by, c, d in (("lat", "lat", "lng"), ("lng", "lat", "lng")) for f in (F.min_by, F.max_by)]
    cells = checkpointed(core.groupBy("cell", "node").agg(F.array(*ends).alias("ends"), *_box("")))
    side = lambda c: cells.select(F.col("cell").alias(f"cell_{c}"), F.col("node").alias(c), F.col("ends").alias(f"ends_{c}"), *[F.col(x).alias(f"{c}_{x}") for x in ("south", "north", "west", "east")])
    pairs = near.where("cell_a < cell_b").join(side("a"), "cell_a").join(side("b"), "cell_b")
    least, _ = _box_distances("a_", "b_")
    met = F.exists("ends_a", lambda p: F.exists("ends_b", lambda q: haversine(p["lat"], p["lng"], q["lat"], q["lng"]) <= grid.metres))
    pairs = checkpointed(pairs.where(least <= grid.metres).select("a", "b", met.alias("met")))
    part = lambda x, of: F.floor(x * PARTS) - of * PARTS
    parted = core.select("id", "node", "lat", "lng", part(F.col("lat") / grid.height, F.col("row")).alias("p"), part(F.col("lng") / grid.width(F.col("row")), F.col("col")).alias("q"))
    boxes = parted.groupBy("node", "p", "q").agg(*_box(""))
    named = lambda frame, c: frame.select(*[F.col(x).alias(f"{c}_{x}" if x != "node" else c) for x in frame.columns])
    boxed = pairs.where("not met").select("a", "b").join(named(boxes, "a"), "a").join(named(boxes, "b"), "b")
    least, most = _box_distances("a_", "b_")
    boxed = checkpointed(boxed.select("a", "b", "a_p", "a_q", "b_p", "b_q", least.alias("least"), (most <= grid.metres).alias("sure")).where(F.col("least") <= grid.metres))
    sure = boxed.where("sure").select("a", "b").distinct()
    open_ = boxed.join(sure, ["a", "b"], "left_anti").join(named(parted, "a"), ["a", "a_p", "a_q"]).join(named(parted, "b"), ["b", "b_p", "b_q"])
    close = open_.where(haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) <= grid.metres).select("a", "b").distinct()
    return pairs.where("met").select("a", "b").unionByName(sure).unionByName(close)


def dbscan(events: DataFrame, *, metres: float = CLUSTER_M, least: int = CLUSTER_MIN, kind: str = "vtype", key: str = "event_id") -> DataFrame:
    """key, kind, role (core, border) and cluster_id (smallest core id) of clustered events.

    Neighbours are of one type and at most ``metres`` apart, a point being its own; cores have
    at least ``least``. A border point that reaches several clusters goes to the smallest id.

    Points of one grid cell are neighbours, so a cell of ``least`` points is all core and its core
    points are one cluster; only points of thinner cells are compared with those around them,
    and components run over cells. No table of all neighbour pairs is made.
    """
    grid = Grid(metres)
    points = events.select(F.col(key).alias("id"), F.col(kind).alias("kind"), "lat", "lng").where("id is not null and kind is not null and lat is not null and lng is not null")
    points = points.select("*", *grid.place(F.col("lat"), F.col("lng")))
    cells = checkpointed(points.groupBy("kind", "row", "col").agg(F.count("*").alias("n"), F.min("id").alias("cell")))
    sized = checkpointed(points.join(cells, ["kind", "row", "col"]).select("id", "cell", "n", "kind", "row", "col", "lat", "lng"))
    asked = cells.select(F.col("cell").alias("cell_a"), "kind", F.explode(grid.around(F.col("row"), F.col("col"))).alias("x")).select("cell_a", "kind", "x.row", "x.col")
    near = checkpointed(asked.join(cells, ["kind", "row", "col"]).select("cell_a", F.col("cell").alias("cell_b")))
    thin = sized.where(F.col("n") < least)
    apart = haversine(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b")) <= metres

    def met(some: DataFrame, others: DataFrame, *more: str) -> DataFrame:
        """Points of ``some`` with each of ``others`` within reach."""
        asking = near.join(some.select("id", "kind", "lat", "lng", F.col("cell").alias("cell_a")), "cell_a")
        return asking.join(others.select(F.col("cell").alias("cell_b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), *more), "cell_b").where(apart)

    thin_core = met(thin, sized).groupBy("id").agg(F.count("*").alias("around")).where(F.col("around") >= least).select("id")
    thin = checkpointed(thin.join(thin_core.withColumn("core", F.lit(True)), "id", "left").select(*sized.columns, F.coalesce("core", F.lit(False)).alias("core")))
    core = sized.where(F.col("n") >= least).unionByName(thin.where("core").drop("core")).drop("n")
    core = checkpointed(core.join(core.groupBy("cell").agg(F.min("id").alias("node")), "cell"))
    labels = connected(_cell_edges(core, near, grid))
    named = checkpointed(core.join(labels, "node", "left").select("id", "kind", "cell", "lat", "lng", F.coalesce("component", "node").alias("cluster_id")))
    border = met(thin.where("not core"), named.drop("id", "kind"), "cluster_id").groupBy("id", "kind").agg(F.min("cluster_id").alias("cluster_id"))
    found = named.select("id", "kind", "cluster_id").withColumn("role", F.lit("core")).unionByName(border.withColumn("role", F.lit("border")))
    return found.select(F.col("id").alias(key), F.col("kind").alias(kind), "cluster_id", "role")


def run_clustering(events: DataFrame, path: str, **options) -> DataFrame:
    """Clusters the history and stores the result; what a weekly job or a planner calls."""
    dbscan(events, **options).write.mode("overwrite").parquet(path)
    return events.sparkSession.read.parquet(path)
