import zlib

from pyspark.sql import functions as F

from cairn.llm import sharding


def test_contiguous_balanced_and_gapless(spark, docs_of):
    texts = [("x" * (i * 37 % 400)) for i in range(500)] + [None, ""]
    got = sharding.shard_by_bytes(docs_of(texts), 7).orderBy("doc_id").collect()
    assert [r.size for r in got] == [len((t or "").encode()) + 16 for t in texts]
    assert [r.text_crc32 for r in got] == [zlib.crc32((t or "").encode()) for t in texts]
    shards = [r.shard for r in got]
    assert shards == sorted(shards) and set(shards) == set(range(7))
    sums = [sum(r.size for r in got if r.shard == s) for s in range(7)]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    for s in range(7):
        assert [r.slot for r in got if r.shard == s] == list(range(shards.count(s)))


def test_brute_force_cuts(spark, docs_of):
    texts = ["ab" * (i % 9) for i in range(60)]
    got = sharding.shard_by_bytes(docs_of(texts), 5).orderBy("doc_id").collect()
    total, before = sum(r.size for r in got), 0
    for r in got:
        assert r.shard == min(4, before * 5 // total)
        before += r.size


def test_odd_rows(spark, docs_of, odd):
    df = docs_of(odd + odd, ids=[3] * 8 + [None] * 8).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1)).withColumn("pid", F.lit(2))
    got = sharding.shard_by_bytes(df, 40).collect()
    assert len(got) == 16
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(docs_of([]), 3).count() == 0


def test_write(spark, docs_of, tmp_path):
    sharding.write_shards(docs_of(["abc"] * 20), f"{tmp_path}/s", 4)
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 4
