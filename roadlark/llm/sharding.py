"""Sharding by vector bin packing.

A group is all documents of one text; its vector holds bytes, tokens and rows, each as a
share of one shard's fair part. Groups are placed in falling order of size, each in the shard
where the dot product of its vector with the shard's residual capacity is highest.

Heavy groups (over ``1 / heavy`` of a shard's part in some dimension, so at most
``3 * shards * heavy`` of them) are placed first, on their own. What they leave of each
shard's capacity is handed out to hash buckets of the remaining groups, which are packed
independently of each other. A group above a whole shard's part is cut into ``pieces`` hash
pieces, which are placed like groups, whatever its rows' doc_ids.

Defined cases: a null text is a group of its own, of size 1 and no tokens; equal rows stay
together unless their group is cut; an empty table gives an empty table; null doc_ids come first in a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.llm.common import Scratch, n_tasks, n_words, arrow_limits


def _place(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each vector, in order; ``room`` (shards x dimensions) is used up."""
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        s = int(np.argmax(room @ v))
        out[i] = s
        room[s] -= v
    return out


def shard(docs: DataFrame, *, shards: int = 8, text: str = "text", doc_id: str = "doc_id", heavy: int = 64, pieces: int = 64, bucket_groups: int = 4096, weights: tuple[float, float, float] = (1.0, 0.25, 0.1)) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, tokens, shard, slot (its place in the shard, by hash block and doc_id).

    ``weights`` are those of bytes, tokens and rows in the dot product.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shard")
    body = F.col(text)
    slim = scratch.save(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
            n_words(body).alias("tokens"),
            F.coalesce(F.md5(body.cast("binary")), F.lit("null")).alias("group"),
            # tells rows of one doc_id and text apart; written at once, so that it stays
            F.monotonically_increasing_id().alias("copy"),
        ).withColumn("piece", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(pieces)).cast("int")),
        "slim",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    by_piece = slim.groupBy("group", "piece").agg(*sums)
    totals = slim.agg(*sums).first()
    part = np.array([max(1.0, (totals[k] or 0) / shards) for k in ("bytes", "tokens", "rows")])
    scale = np.sqrt(np.array(weights)) / part  # a dot product of scaled vectors is the weighted one
    groups = by_piece.groupBy("group").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    over = lambda times: (F.col("bytes") > times * part[0]) | (F.col("tokens") > times * part[1]) | (F.col("rows") > times * part[2])
    groups = scratch.save(groups.withColumn("heavy", over(1 / heavy)).withColumn("cut", over(1.0)), "groups")

    # at most 3 * shards * heavy groups, of which at most 3 * shards are cut
    cut = groups.where("cut").select("group")
    units = groups.where("heavy and not cut").select("group", F.lit(-1).alias("piece"), "bytes", "tokens", "rows")
    units = units.unionByName(by_piece.join(F.broadcast(cut), "group", "left_semi")).toPandas()
    units = units.assign(key=units.group + units.piece.astype(str)).sort_values(["bytes", "rows", "key"], ascending=[False, False, True])
    room = np.tile(part * scale, (shards, 1))
    units["shard"] = _place(units[["bytes", "tokens", "rows"]].to_numpy(float) * scale, room) if len(units) else pd.Series([], dtype="int32")
    placed = spark.createDataFrame(list(units[["group", "piece", "shard"]].itertuples(index=False, name=None)), "group string, piece int, shard int")

    light = groups.where("not heavy")
    n_light, *light_sums = light.agg(F.count("*"), *[F.sum(k) for k in ("bytes", "tokens", "rows")]).first()
    buckets = max(1, n_light // bucket_groups)
    light_sums = np.array([float(x or 0) for x in light_sums])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = None, None
        for frame in batches:
            for bucket, own in frame.groupby("bucket", sort=False):
                if bucket != now:
                    # the bucket's part of what the heavy groups left, by its own sums in each dimension
                    sums = own[["sum_bytes", "sum_tokens", "sum_rows"]].iloc[0].to_numpy(float)
                    now, left = bucket, room * (sums / np.maximum(light_sums, 1))
                shard_of = _place(own[["bytes", "tokens", "rows"]].to_numpy(float) * scale, left)
                yield pd.DataFrame({"group": own["group"], "shard": shard_of})

    bucketed = light.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    bucket_sums = bucketed.groupBy("bucket").agg(*[F.sum(k).alias(f"sum_{k}") for k in ("bytes", "tokens", "rows")])
    packed = (
        bucketed.join(bucket_sums, "bucket")
        .repartition(n_tasks(spark, buckets, 4), "bucket")
        .sortWithinPartitions("bucket", F.desc("bytes"), F.desc("rows"), "group")
        .select("bucket", "group", "bytes", "tokens", "rows", "sum_bytes", "sum_tokens", "sum_rows")
        .mapInPandas(pack, "group string, shard int")
    )
    with arrow_limits(spark, rows=4096):
        packed = scratch.save(packed, "packed")
    whole, cuts = (placed.where(c).withColumnRenamed("shard", n) for c, n in (("piece < 0", "whole"), ("piece >= 0", "split")))
    at = (
        slim.join(F.broadcast(whole.drop("piece")), "group", "left")
        .join(F.broadcast(cuts), ["group", "piece"], "left")
        .withColumn("fixed", F.coalesce("whole", "split"))
    )
    heavy_rows = at.where("fixed is not null").select("doc_id", "size", "text_crc32", "tokens", "copy", F.col("fixed").alias("shard"))
    light_rows = at.where("fixed is null").join(packed, "group").select("doc_id", "size", "text_crc32", "tokens", "copy", "shard")
    return _slots(scratch.save(heavy_rows.unionByName(light_rows), "at"), max(1, (totals["rows"] or 0) // 2048))


def _slots(rows: DataFrame, blocks: int) -> DataFrame:
    """Gapless places in each shard: the rows of earlier hash blocks, then the rank in the own block."""
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(blocks)))
    before = (
        blocked.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "copy"))
    return blocked.withColumn("rank", rank).join(before, ["shard", "block"]).withColumn("slot", F.col("before") + F.col("rank") - 1).drop("block", "rank", "before", "copy")
