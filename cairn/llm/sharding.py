"""Sharding by global byte-size prefix sums.

Rows are ordered by (id, text checksum); each range partition gives one total, the driver turns those totals
(one number per partition) into offsets, and every row's global prefix sum decides its shard: the sums are cut at
equal targets total*k/n, so shards are contiguous in that order and differ by at most about one row's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common


def _running(batches):
    """Local prefix sums within one range partition; keeps two numbers between batches."""
    done_bytes = done_rows = 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        ends = np.cumsum(size) + done_bytes
        idx = np.arange(done_rows, done_rows + len(size), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("__id", "size", "text_crc32", "pid")), pa.array(ends - size), pa.array(idx)],
            names=["__id", "size", "text_crc32", "pid", "before", "idx"],
        )
        if len(size):
            done_bytes, done_rows = int(ends[-1]), done_rows + len(size)


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Contiguous shards of near-equal bytes: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    size is the text's UTF-8 bytes plus `overhead`. Null text: no bytes, checksum 0. Null ids come first. Repeated rows
    each get a slot of their own. Empty table: no rows. Other columns of docs are not read, so their names can't clash.
    A hot id is split between tasks: row numbers end the sort key.
    """
    common.ship(docs.sparkSession)
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    raw = common.utf8(F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + overhead).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row"),
    )
    order = [F.col("__id").asc_nulls_first(), F.col("text_crc32"), F.col("__row")]
    ranged = sized.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order)
    kind = ranged.schema["__id"].dataType.simpleString()
    local = ranged.withColumn("pid", F.spark_partition_id()).mapInArrow(
        _running, f"__id {kind}, size long, text_crc32 long, pid int, before long, idx long"
    )
    local = common.cut(local, "shards")
    totals = local.groupBy("pid").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    at_byte = at_row = 0
    offsets = []
    for r in sorted(totals, key=lambda r: r["pid"]):
        offsets.append((r["pid"], at_byte, at_row))
        at_byte, at_row = at_byte + r["b"], at_row + r["n"]
    offs = spark.createDataFrame(offsets, "pid int, byte0 long, row0 long")
    dec = "decimal(38,0)"
    placed = local.join(F.broadcast(offs), "pid").select(
        "__id", "size", "text_crc32",
        F.expr(f"cast(least({n_shards - 1}, (cast(before + byte0 as {dec}) * {n_shards}) div cast({max(at_byte, 1)} as {dec})) as int)").alias("shard"),
        (F.col("idx") + F.col("row0")).alias("row"),
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as one folder per shard, rows in slot order; ids must be unique here."""
    placed = shard_by_bytes(docs, n_shards, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = docs.join(placed, docs[id_col].eqNullSafe(placed["__id"])).drop("__id")
    out = joined.repartitionByRange(max(n_shards, common.parts(docs.sparkSession)), "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    out.drop("__slot").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)
