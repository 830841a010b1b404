"""Domain inputs derived from the synthetic tables, once as DataFrames and once as SQL for DuckDB.

The formulas are written once; ``{d}`` marks a double literal and ``{div}`` integer division,
which the two engines spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.config import ANOMALIES, RULES, STATUSES

SPARK, DUCK = {"d": "D", "div": "div", "long": "bigint"}, {"d": "e0", "div": "//", "long": "bigint"}
DAY0 = 1767225600  # 2026-01-01 00:00:00 UTC

VIOLATION = {
    "event_id": "event_id",
    "session_id": "event_id % 2",
    "vtype_no": "(event_id {div} 2) % 10",
    "zone_id": "((event_id {div} 2) * 7919) % 23",
    "t": "(event_id {div} 2) * 60 + (event_id % 2) * ((event_id {div} 2) % 10)",
    "lat": "case when (event_id {div} 2) % 11 = 0 then 16.0{d} + ((event_id {div} 2) % 500) * 0.001{d} else 17.38{d} + (((event_id {div} 2) * 7919) % 23) * 0.01{d} + (((event_id {div} 2) * 104729) % 97) * 0.00002{d} end + (event_id % 2) * ((event_id {div} 2) % 4) * 0.00004{d}",
    "lng": "case when (event_id {div} 2) % 11 = 0 then 77.0{d} + ((event_id {div} 2) {div} 500) * 0.001{d} else 78.48{d} + (((event_id {div} 2) * 7919) % 23) * 0.01{d} + (((event_id {div} 2) * 15485863) % 89) * 0.00002{d} end",
    "confidence": "(50 + (event_id * 37) % 50) / 100{d}",
    "track_id": "user_id",
    "status_no": "event_id % 5",
}
RUN = "k between 6 and 5 + (case script when 0 then 31 when 1 then 6 when 4 then 11 when 5 then 4 when 6 then 11 when 9 then 21 else -99 end) + variant - 2"
POINT = {
    "track_id": "track_id",
    "k": "k",
    "script": "script",
    "variant": "variant",
    "t": "track_id * 1000 + k",
    "lat": "17.40{d} + script * 0.01{d} + case when k <= 3 then 0.01{d} else (k % 20) * 0.00001{d} end",
    "lng": "78.40{d} + (k % 13) * 0.00001{d}",
    "speed": f"case when script in (0, 6) and {RUN} then 1{{d}} when script = 9 and {RUN} then 4{{d}} when script = 4 and {RUN} then 80{{d}} else 40{{d}} end",
    "heading": f"case when script = 1 and ({RUN} or variant = 4 and k > 5) then 180{{d}} when script = 2 then (140 + 10 * variant) * least(greatest(k - 5, 0), 10) / 10{{d}} else 0{{d}} end",
    "lane_offset": f"case when script = 5 and {RUN} then 1{{d}} else -1{{d}} end",
    "helmet_conf": "case when script = 7 and k = 10 then (76 + 2 * variant) / 100{d} else 0{d} end",
    "passengers": "case when script = 8 then variant else 1 end",
    '"offset"': "cast(k - (10 + 7 * variant) as double)",
    "vehicle_class": "case when script = 8 then 'motorcycle' when script = 3 and variant = 1 then 'ambulance' else 'car' end",
}
ANOMALY = {
    "det_id": "l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10",
    "part": "l_partkey",
    "kind_no": "l_partkey % 4",
    "session_id": "l_linenumber % 3",
    "zone_id": "l_suppkey % 23",
    "t": "l_orderkey * 60 + l_linenumber",
    "lat": "17.5{d} + (l_partkey % 50) * 0.001{d} + (l_linenumber % 3) * 0.00001{d}",
    "lng": "78.5{d} + (l_partkey {div} 50 % 40) * 0.001{d}",
    "raw": "l_discount * 10",
    "area": "l_quantity / 100",
}
#: type, speed limit, permitted direction, grace period, lane type of zone 0 to 9, one for each script
ZONES = (
    ("no_parking", None, None, 30, None), ("lane", None, 0.0, None, None), ("u_turn", None, None, None, None), ("stop_line", None, None, None, None), ("speed", 60, None, None, None),
    ("lane_boundary", None, None, None, "solid"), ("zebra", None, None, None, None), ("checkpoint", None, None, None, None), ("checkpoint", None, None, None, None), ("highway", None, None, None, None),
)


def _names(values: tuple[str, ...], index: str) -> str:
    return "case " + index + " " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def _select(table: dict[str, str], words: dict[str, str], quote: str) -> list[str]:
    return [f"{e.format(**words)} as {n.strip(chr(34)) if not n.startswith(chr(34)) else quote + n.strip(chr(34)) + quote}" for n, e in table.items()]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = events(spark, sf_dir).selectExpr(*_select(VIOLATION, SPARK, "`"))
    return v.selectExpr("*", _names(RULES, "vtype_no") + " as vtype", _names(STATUSES, "status_no") + " as status", f"cast(timestamp_seconds({DAY0} + t) as timestamp) as ts").drop("vtype_no", "status_no")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    base = events(spark, sf_dir).select(F.col("user_id").alias("track_id"), k.cast("bigint").alias("k"))
    base = base.selectExpr("track_id", "k", "track_id % 10 as script", "(track_id div 10) % 5 as variant")
    return base.selectExpr(*_select(POINT, SPARK, "`"))


def zones(spark: SparkSession) -> DataFrame:
    def box(i: int) -> list[tuple[float, float]]:
        low, high, west, east = 17.40 + 0.01 * i - 0.00005, 17.40 + 0.01 * i + 0.0005, 78.39995, 78.4005
        return [(west, low), (east, low), (east, high), (west, high)]

    rows = [(i, kind, limit, direction, grace, lane, box(i), True) for i, (kind, limit, direction, grace, lane) in enumerate(ZONES)]
    return spark.createDataFrame(rows, "zone_id long, zone_type string, speed_limit int, permitted_dir double, grace_period int, lane_type string, polygon array<struct<lng:double,lat:double>>, is_active boolean")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_select(ANOMALY, SPARK, "`")).selectExpr("*", _names(ANOMALIES, "kind_no") + " as anomaly_type").drop("kind_no")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the one signal: red in the first half of every minute, up to the last track point."""
    last = track_points(spark, sf_dir).agg(F.max("t").alias("last"))
    return last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(30).cast("long"))).alias("t")).select(F.lit(3).cast("long").alias("zone_id"), "t", F.when(F.col("t") % 60 == 0, "RED").otherwise("GREEN").alias("state"))


def _cte(name: str, table: dict[str, str], source: str, *more: str) -> str:
    inner = "select " + ", ".join(_select(table, DUCK, '"')) + f" from {source}"
    return f"{name} as (select *{''.join(', ' + m for m in more)} from ({inner}))"


V = _cte("v", VIOLATION, "events", _names(RULES, "vtype_no") + " as vtype", _names(STATUSES, "status_no") + " as status", "TIMESTAMP '2026-01-01' + to_seconds(t) as ts")
_numbered = "(select *, track_id % 10 as script, (track_id // 10) % 5 as variant from (select user_id as track_id, row_number() over (partition by user_id order by ts, event_id) as k from events))"
P = _cte("p", POINT, _numbered)
#: Points with each zone whose rectangle holds them.
PZ = P + ", pz as (select p.*, z as zone_id from p, range(10) r(z) where lat > 17.40e0 + 0.01e0 * z - 0.00005e0 and lat < 17.40e0 + 0.01e0 * z + 0.0005e0 and lng > 78.39995e0 and lng < 78.4005e0)"
A = _cte("a", ANOMALY, "lineitem", _names(ANOMALIES, "kind_no") + " as anomaly_type")
METRES = "(2 * 6371008.8e0 * asin(sqrt(least(1e0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lng - {a}.lng) / 2), 2)))))"


def metres(a: str, b: str) -> str:
    return METRES.format(a=a, b=b)
