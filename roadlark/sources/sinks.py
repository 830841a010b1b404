"""Writers: idempotent appends, upserts, exports, push payloads, audit, retries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadlark.functions.geo import point_geojson
from roadlark.operators.anomalies import upsert

PUSH_EVENTS = {
    "violation_alert": ("event_id", "vtype", "lat", "lng", "confidence"),
    "anomaly_alert": ("anomaly_id", "anomaly_type", "severity"),
    "vehicle_update": ("track_id", "lat", "lng", "speed", "heading"),
    "session_status": ("session_id", "status"),
    "recommendation_ready": ("cluster_id", "rec_type"),
    "telemetry": ("session_id", "lat", "lng", "alt"),
}


def deterministic_id(*columns: str) -> Column:
    """An id that a rerun repeats, so that writes are idempotent."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table lacks; a replayed batch adds nothing."""
    batch = batch.dropDuplicates([key])
    if _exists(batch.sparkSession, path):
        batch = batch.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
    batch.write.mode("append").parquet(path)


def partitioned_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """year/month/day folders, which date filters prune."""
    events.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}).repartition("year", "month", "day").write.mode("append").partitionBy("year", "month", "day").parquet(path)


#: Hash buckets of an upserted table: a version rewrites those that its rows fall into.
BUCKETS = 64


def _text(spark: SparkSession, path: str, write: str | None = None) -> str | None:
    """A small file's text, None if there is none; ``write`` replaces it in one step, by renaming."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if write is None:
        if not files.exists(place):
            return None
        stream = files.open(place)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    draft = jvm.org.apache.hadoop.fs.Path(path + ".draft")
    stream = files.create(draft, True)
    try:
        stream.write(write.encode())
    finally:
        stream.close()
    if not files.rename(draft, place):
        raise OSError(f"{path} exists already")
    return write


def table_version(spark: SparkSession, path: str, version: int) -> dict[str, int] | None:
    """The generation of each bucket of a version, None if it was never finished."""
    found = _text(spark, f"{path}/versions/{version}.json")
    return None if found is None else json.loads(found)


def read_table(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A whole version of an upserted table, whatever is being written beside it."""
    parts = table_version(spark, path, version)
    if parts is None:
        raise ValueError(f"{path} has no version {version}")
    schema = StructType.fromJson(json.loads(_text(spark, f"{path}/schema.json")))
    places = [f"{path}/data/generation={g}/bucket={b}" for b, g in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upsert_table(fresh: DataFrame, path: str, version: int, keys: tuple[str, ...] = ("anomaly_id",)) -> DataFrame:
    """Merges into a new version of the table; only buckets of the keys in ``fresh`` are read and written again.

    A version is a small file that names each bucket's generation; it appears last and in one step, so readers
    see whole versions, files of untouched buckets stay as they are, and a version that exists already is not added twice.
    What a failed attempt wrote is overwritten by the next one.
    """
    spark = fresh.sparkSession
    if table_version(spark, path, version) is not None:
        return read_table(spark, path, version)
    before = (table_version(spark, path, version - 1) or {}) if version > 1 else {}
    columns = [*keys, "severity", "n_dets", "first_seen", "last_seen"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    new = fresh.select(*columns, bucket.alias("bucket"))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # BUCKETS at most
    old = {str(b): before[str(b)] for b in touched if str(b) in before}
    if old:
        kept = spark.read.schema(new.drop("bucket").schema).parquet(*[f"{path}/data/generation={g}/bucket={b}" for b, g in old.items()])
        merged = upsert(kept, new, keys).drop("action").withColumn("bucket", bucket)
    else:
        merged = new
    merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/generation={version}")
    if _text(spark, f"{path}/schema.json") is None:
        _text(spark, f"{path}/schema.json", new.drop("bucket").schema.json())
    _text(spark, f"{path}/versions/{version}.json", json.dumps(before | {str(b): version for b in touched}))
    return read_table(spark, path, version)


def write_tracks(points: DataFrame, path: str) -> None:
    line = F.transform(F.sort_array(F.collect_list(F.struct("t", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat")))
    points.groupBy("track_id").agg(line.alias("trajectory"), F.min("t").alias("start_time"), F.max("t").alias("end_time")).write.mode("append").parquet(path)


def export(report: DataFrame, path: str, fmt: str) -> None:
    """A report as CSV or as GeoJSON features, one a line. PDF and spreadsheets need libraries that are not part of this package."""
    if fmt == "csv":
        report.write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "geojson":
        rest = [c for c in report.columns if c not in ("lat", "lng")]
        report.select(point_geojson(F.col("lat"), F.col("lng"), F.struct(*rest)).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no export to {fmt}")


def payloads(kind: str, rows: DataFrame) -> DataFrame:
    """JSON payloads of one push event."""
    return rows.select(F.lit(kind).alias("event"), F.to_json(F.struct(*PUSH_EVENTS[kind])).alias("payload"))


def audit(actions: DataFrame, path: str) -> None:
    actions.select("user_id", "role", "action", "resource_id", "ts", "ip_address", "result").write.mode("append").parquet(path)


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("generated_at"), "id")


def backoff(most: float = 30.0) -> list[float]:
    """1, 2, 4, ... seconds up to the limit, which closes the list."""
    out, wait = [], 1.0
    while wait < most:
        out.append(wait)
        wait *= 2
    return [*out, most]


def write_with_retry(write: Callable[[], None], waits: list[float] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Calls ``write`` until it succeeds; the number of failures before. The last failure is raised and the checkpoint replays the batch."""
    waits = backoff() if waits is None else waits
    for failures, wait in enumerate(waits):
        try:
            write()
            return failures
        except Exception:
            sleep(wait)
    write()
    return len(waits)
