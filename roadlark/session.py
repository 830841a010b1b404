"""Sessions, and this package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "roadlark", **conf: str) -> SparkSession:
    """A UTC session; on a cluster master, memory and shuffle partitions come from spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    root = Path(__file__).parent
    place = Path(tempfile.mkdtemp(prefix="roadlark-ship-")) / "roadlark-package.zip"
    with zipfile.ZipFile(place, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(place))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="roadlark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(frame):
    """``frame`` written to the shared checkpoint folder, with its lineage cut."""
    sc = frame.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()
