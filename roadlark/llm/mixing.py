"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, twice over. A document's
virtual finish time is the source's cumulative size up to its end divided by the source's
target, so all sources progress through their targets at one pace. The mix is the head of
that global order whose sizes fit into the budget.

Defined cases: a null text has size 0 and is taken 0 words; a null source is the last
source; repeated rows are separate documents that follow each other; an empty table gives an
empty mix; a source without words has target 0 and no finish time, and nothing of it is taken.
Reruns agree: the shuffle is a hash.
"""

from __future__ import annotations

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.llm.common import Scratch, free_names, n_words, row_key

#: Sources are few and named by people; beyond this the list would not be a mixing table.
MAX_SOURCES = 100_000
CYCLE = (3.0, 1.0, 2.0)
UNIT = 1 << 30
#: Buckets of a source whose sums are added up in one window.
BLOCK = 1024


def water_fill(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; the excess is reshared."""
    target = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s], budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", cycle: tuple[float, ...] = CYCLE, budget_share: float = 1.5, epochs: int = 2, seed: int = 11, bucket_rows: int = 1024) -> DataFrame:
    """One row per document: doc_id, row_key, size, source, source_size, target, taken, n_taken, virtual_finish (of its first turn)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    slim = scratch.save(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), row_key(doc_id, source, text).alias("row_key")).withColumn("turn", F.xxhash64(F.col("row_key"), F.lit(seed))),
        "slim",
    )
    table = _sources(spark, slim, cycle, budget_share, epochs)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket_rows)).cast("long")
    share = F.shiftright(F.col("turn"), 34) + F.lit(UNIT // 2)  # 0 to UNIT-1, rising with the turn
    queued = slim.join(F.broadcast(table), slim["source"].eqNullSafe(table["name"])).withColumn("bucket", F.floor(share * buckets / UNIT).cast("long"))
    # sums before each bucket in two levels: within blocks of BLOCK buckets, and over the blocks of a source
    held = queued.groupBy("place", "bucket").agg(F.sum("size").alias("held")).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = held.groupBy("place", "block").agg(F.sum("held").alias("held"))
    blocks = blocks.select("place", "block", (F.sum("held").over(Window.partitionBy("place").orderBy("block")) - F.col("held")).alias("earlier"))
    inner = F.sum("held").over(Window.partitionBy("place", "block").orderBy("bucket")) - F.col("held")
    before = held.withColumn("inner", inner).join(blocks, ["place", "block"]).select("place", "bucket", (F.col("inner") + F.col("earlier")).alias("before"))
    order = Window.partitionBy("place", "bucket").orderBy("turn", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    within = queued.withColumn("cum", F.sum("size").over(order)).join(before, ["place", "bucket"])
    queue = scratch.save(within.select("doc_id", "row_key", "source", "size", "source_size", "target", (F.col("before") + F.col("cum")).alias("cum")), "queue")
    finish = [F.try_divide(F.col("cum") + turn * F.col("source_size"), F.col("target")).alias(f"finish{turn}") for turn in range(epochs)]
    timed = queue.select("*", *finish)
    cut = _cut(timed, epochs, budget_share)
    in_mix = sum((F.coalesce(F.col(f"finish{e}") <= F.lit(cut), F.lit(False)).cast("int") for e in range(epochs)), F.lit(0))
    in_mix = F.when(F.col("size") > 0, in_mix).otherwise(F.coalesce((F.col("finish0") <= F.lit(cut)).cast("int"), F.lit(0)))
    return timed.withColumn("n_taken", in_mix).select("doc_id", "row_key", "source", "size", "source_size", "target", (F.col("n_taken") * F.col("size")).cast("long").alias("taken"), "n_taken", F.col("finish0").alias("virtual_finish"))


def _sources(spark: SparkSession, slim: DataFrame, cycle: tuple[float, ...], budget_share: float, epochs: int) -> DataFrame:
    rows = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # str compares by code point
    sizes = [r["size"] for r in rows]
    targets = water_fill(sizes, [cycle[i % len(cycle)] for i in range(len(rows))], budget_share * sum(sizes), float(epochs))
    columns = [[r["source"] for r in rows], range(len(rows)), sizes, [r["n"] for r in rows], targets]
    schema = pa.schema([("name", pa.string()), ("place", pa.int32()), ("source_size", pa.int64()), ("source_rows", pa.int64()), ("target", pa.float64())])
    # from Arrow: a list would go through Python workers, whose daemon then stays in every executor
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema))


def _cut(timed: DataFrame, epochs: int, budget_share: float, parts: int = 2048, most: float = 4.0) -> float:
    """The last virtual finish time that still fits into the budget.

    The order is range-split into ``parts`` ranges whose sums decide in which of them the budget
    ends; that range is split again, until no range is left to split or one time remains.
    """
    budget = budget_share * (timed.agg(F.sum("size")).first()[0] or 0)
    turns = timed.select(F.explode(F.array(*[F.struct(F.col(f"finish{e}").alias("at"), "size") for e in range(epochs)])).alias("x")).select("x.*").where((F.col("size") > 0) & F.col("at").isNotNull())
    low, high, taken, cut = 0.0, most, 0, 0.0
    for _ in range(8):
        width = (high - low) / parts
        part = F.least(F.lit(parts - 1), F.floor((F.col("at") - F.lit(low)) / F.lit(width)))
        inside = (F.col("at") > low) & (F.col("at") <= high)
        sums = turns.where(inside).groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.min("at").alias("first"), F.max("at").alias("last")).orderBy("part").collect()
        split = None
        for r in sums:
            if taken + r["size"] > budget:
                split = r
                break
            taken, cut = taken + r["size"], r["last"]
        if split is None or split["first"] == split["last"]:
            break
        low, high = cut if cut > low else low, split["last"]
        if split["first"] > low:
            low = max(low, split["first"] - (split["last"] - split["first"]) * 1e-6 - 1e-15)
    return cut


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it; columns as in ``docs``."""
    names = {k: options.get(k, k) for k in ("doc_id", "source", "text")}
    key, taken, rows, turn = free_names(docs, "key", "taken", "rows", "turn")
    plan = mix(docs, **options).where("n_taken > 0").groupBy(F.col("row_key").alias(key))
    # repeated rows share a key; what the mix takes of them is dealt to them evenly, rounded up
    plan = plan.agg(F.sum("n_taken").alias(taken), F.count("*").alias(rows))
    keyed = docs.withColumn(key, row_key(names["doc_id"], names["source"], names["text"]))
    each = F.greatest(F.lit(1), F.ceil(F.col(taken) / F.col(rows)).cast("int"))
    return keyed.join(plan, key).withColumn(turn, F.explode(F.sequence(F.lit(1), each))).select(*docs.columns)
