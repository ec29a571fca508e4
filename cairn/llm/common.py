"""Shared helpers of the training-data operators: tables, durable cuts, hot keys, hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once a session; they need not have it installed."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:  # texts can be long: batches are bounded by bytes too
        spark.conf.set(BATCH, str(8 << 20))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    made = tempfile.mkdtemp(prefix="cairn-ship-")
    atexit.register(shutil.rmtree, made, True)
    with zipfile.ZipFile(f"{made}/cairn.zip", "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{made}/cairn.zip")
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer, for heavy work on the rows of a small table."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cairn-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cairn/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path  # for drop()
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_cairn_path", None)
    if not path:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | Column) -> Column:
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def hot_keys(df: DataFrame, key: str, share: float = 0.001, least: int = 20_000) -> list:
    """Keys that hold over `share` of all rows (so fewer than 1/share of them) and over `least` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    total = df.count()
    rows = counts.filter(F.col("n") > total * share).select(key, "n").collect()
    return [r[key] for r in rows if r[key] is not None]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left", salts: int = 64) -> DataFrame:
    """left join right on key, right unique by key; rows of hot keys are spread over `salts` tasks.

    hot comes from hot_keys(), so its length is bounded by 1/share; right is repeated for those keys alone.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    lft = left.withColumn("__s", F.when(is_hot, (F.rand(7) * salts).cast("int")).otherwise(0))
    rgt = right.withColumn("__s", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return lft.join(rgt, [key, "__s"], how).drop("__s")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _arrow_uri(uri: str) -> str:
    """The uri with the scheme that pyarrow knows for it: s3a and s3n are s3 there, abfss is abfs."""
    scheme, sep, rest = uri.partition("://")
    return {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + sep + rest if sep else uri


def fs_open(uri: str, mode: str):
    """A stream on any filesystem that pyarrow knows; mode r or w."""
    from pyarrow import fs

    f, path = fs.FileSystem.from_uri(_arrow_uri(uri))
    if mode == "r":
        return f.open_input_file(path)
    f.create_dir(os.path.dirname(path), recursive=True)
    return f.open_output_stream(path)


def fs_move(a: str, b: str) -> None:
    from pyarrow import fs

    f, pa_ = fs.FileSystem.from_uri(_arrow_uri(a))
    _, pb = fs.FileSystem.from_uri(_arrow_uri(b))
    f.move(pa_, pb)


def frugal(run):
    """run for mapInArrow, which gives freed memory back to the system at its end: the worker stays for other tasks."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def by_key(batches, keys: tuple[str, ...], most: int | None = None):
    """Runs of rows with equal keys from sorted batches: (first row's keys, list of record batches).

    A run of over `most` rows comes in several parts, each of most rows and one batch at the utmost.
    """
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        at = np.append(np.flatnonzero(new), b.num_rows)
        for s, e in zip(at, at[1:]):
            key = tuple(c[s] for c in cols)
            if held and (key != now or (most and sum(x.num_rows for x in held) >= most)):
                yield now, held
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield now, held
