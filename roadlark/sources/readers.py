"""Readers: label files, ground truth, zones, telemetry, replays. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlark.schemas import INPUTS, STORED

NO_FLY = "array<struct<lng:double,lat:double>>"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(STORED[name]).parquet(f"{root}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A stored table from a relational database; filters on it are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_sim_frames(spark: SparkSession, path: str, every: int = 5) -> DataFrame:
    """Image files of a simulation dump, every n-th frame; the frame number is in the file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("frame_no", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("int")).where(F.col("frame_no") % every == 0)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label text files: class, centre and size of a box a line, relative to the image; malformed lines go."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    parts = lines.select("file", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 5)
    num = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    named = parts.select(F.regexp_extract("file", r"(\d+)\.txt$", 1).cast("int").alias("frame_no"), F.expr("try_cast(p[0] as int)").alias("class_id"), *[num(i).alias(n) for i, n in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))])
    return named.where("class_id is not null and cx is not null and cy is not null and w is not null and h is not null")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INPUTS["ground_truth"]).json(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones of GeoJSON feature collections; the outer ring without its repeated last vertex."""
    shape = "type string, features array<struct<type:string,properties:struct<id:string,name:string,zone_type:string,speed_limit:int,permitted_dir:double,grace_period:int>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    features = spark.read.schema(shape).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    ring = F.get(F.col("f.geometry.coordinates"), F.lit(0))
    points = F.transform(F.slice(ring, 1, F.greatest(F.lit(0), F.size(ring) - 1)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat")))
    return features.where("f.geometry.type = 'Polygon'").select("f.properties.*", points.alias("polygon")).withColumn("is_active", F.lit(True))


def read_no_fly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"id string, polygon {NO_FLY}").json(path)


def read_stream(spark: SparkSession, path: str, kind: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of one of the inputs (telemetry, signals, heartbeats, track points, responders ...)."""
    reader = spark.readStream.schema(INPUTS[kind])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def signal_state(api: DataFrame, seen: DataFrame) -> DataFrame:
    """The signal feed, with what the camera saw where the feed is silent."""
    keys = ["junction_id", "ts"]
    return api.withColumnRenamed("state", "_api").join(seen.withColumnRenamed("state", "_seen"), keys, "full").select(*keys, F.coalesce("_api", "_seen").alias("state"))


def normalise(source: DataFrame, columns: list[str], origin: str) -> DataFrame:
    """The common columns of simulated and live input, null where a source lacks one."""
    have = [F.col(c) if c in source.columns else F.lit(None).alias(c) for c in columns]
    return source.select(*have, F.lit(origin).alias("origin"))


def union_sources(simulated: DataFrame, live: DataFrame) -> DataFrame:
    return simulated.unionByName(live, allowMissingColumns=True)


def playback(events: DataFrame, session_id: object) -> DataFrame:
    """A past session's events in order; reading only."""
    return events.where(F.col("session_id") == session_id).orderBy("t", "event_id")
