"""What the corpus operators share: words, scratch tables in the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlark.session import ship

#: The six ASCII blanks that part words; every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null, empty or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(*columns: str) -> Column:
    """64-bit identity of a row's values. Repeated rows share it, and so share every decision."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="roadlark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_recording: list[list[Scratch]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[Scratch]]:
    """The scratches that are made inside, for a caller who knows when their tables have been read."""
    made: list[Scratch] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording.remove(made)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they wait for
    the driver to need memory, and the steps of a long job add up on the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written in the shared folder: they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/roadlark-{name}-{uuid.uuid4().hex}"
        for made in _recording:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str, *, row_group: int | None = None) -> DataFrame:
        """``row_group``: bytes of a row group, where Parquet's usual 128 MB are too many to be read."""
        frame.write.mode("overwrite").options(**{"parquet.block.size": row_group} if row_group else {}).parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def save_bucketed(self, frame: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Like ``save``, in hash buckets of a column that ``frame`` is already dealt by: joins on it then
        read the table where it lies. ``drop_table`` ends it."""
        frame.write.bucketBy(buckets, column).option("path", self.path(name)).saveAsTable(self.table(name))
        return self.spark.table(self.table(name))

    def table(self, name: str) -> str:
        return f"{self.root.rpartition('/')[2]}_{name}".replace("-", "_")

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}")
        self.drop(name)

    def drop(self, name: str = "") -> None:
        """Deletes a table, or all of this scratch; only what no returned DataFrame still reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        place.getFileSystem(conf).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables in the shared folder; for a caller whose results are written."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "roadlark-*")) or []:
        files.delete(found.getPath(), True)


@contextlib.contextmanager
def arrow_limits(spark: SparkSession, rows: int = 512, size: str = "8m") -> Iterator[None]:
    """Bounds what an Arrow batch holds, so that long texts don't add up in a Python worker, and
    ships the package. The session's own limits come back at the end, so what runs Python must
    be written inside the block."""
    ship(spark)
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trim() -> None:
    """Gives freed memory of this Python worker back, which else keeps it for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def n_tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows: enough for the input, at least what the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """These names, with as many ``_`` at the end as keep them apart from the columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed_columns(docs: DataFrame, *named: str, renamed: tuple[str, ...]) -> DataFrame:
    """The columns ``named``, as ``renamed``, and all columns of ``docs`` in one struct ``row``.

    Names used inside an operator then never meet those of the caller; ``unpacked`` undoes it.
    """
    return docs.select(*[F.col(f"`{n}`").alias(r) for n, r in zip(named, renamed, strict=True)], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(packed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``; ``changed`` ones from elsewhere."""
    return packed.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])
