"""Sources and sinks: files, git, JDBC, keyed tables, vector tables and exports."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions import columns as C

DENY_DIRS = ["node_modules", ".git", "target", "dist", "build", "__pycache__", ".venv", "vendor"]
DENY_EXTS = ["png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "jar", "class", "so", "dll", "exe", "lock", "bin"]
MAX_FILE = 1 << 20


class SpaceMismatch(ValueError):
    """Vectors of another embedding space."""


def read_files(spark: SparkSession, root: str, limit: int = MAX_FILE) -> DataFrame:
    """path, hash, text of the files below root that pass the secret, deny and size filters (sizes before contents are read)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= limit)
    f = f.filter(~C.secret_file(F.col("path")) & ~C.denied(F.col("path"), DENY_DIRS, DENY_EXTS))
    return f.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), F.decode("content", "UTF-8").alias("text"))


class GitSource(DataSource):
    """path, text of the files of a git repository at a ref: options path and ref."""

    @classmethod
    def name(cls) -> str:
        return "cairn_git"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options["path"], self.options.get("ref", "HEAD"))


class _GitReader(DataSourceReader):
    def __init__(self, path: str, ref: str) -> None:
        if ref.startswith("-"):
            raise ValueError("a ref must not start with -")
        self.path, self.ref = path, ref

    def partitions(self):
        out = subprocess.run(["git", "-C", self.path, "ls-tree", "-r", "-z", "--name-only", self.ref], capture_output=True, check=True).stdout
        names = [n for n in out.decode().split("\0") if n]
        return [InputPartition(names[i : i + 200]) for i in range(0, len(names), 200)] or [InputPartition([])]

    def read(self, partition):
        for name in partition.value:
            got = subprocess.run(["git", "-C", self.path, "show", f"{self.ref}:{name}"], capture_output=True, check=True).stdout
            yield name, got.decode("utf-8", "replace")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table read in ranges of its key."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts, **options)
    return r.load()


def latest_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key: the read side of an append-only upsert sink."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def write_vectors(vectors: DataFrame, path: str, space: dict) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([space]).coalesce(1).write.mode("overwrite").json(f"{path}/space")


def read_vectors(spark: SparkSession, path: str, space: dict) -> DataFrame:
    """The vectors, if they were written in that embedding space; else SpaceMismatch (a reindex is needed)."""
    have = spark.read.json(f"{path}/space").first().asDict()
    if any(str(have.get(k)) != str(v) for k, v in space.items()):
        raise SpaceMismatch(f"vectors are in {have}, wanted {space}")
    return spark.read.parquet(f"{path}/vectors")


def gc_orphans(vectors: DataFrame, live: DataFrame) -> DataFrame:
    return vectors.join(live.select("id"), "id", "left_semi")


def export(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """rows, digest: order-free digest of a table's keys, combined before the shuffle."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("digest"))


def dedup_versions(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
