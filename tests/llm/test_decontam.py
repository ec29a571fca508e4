import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontam as D


def naive(p, t, least):
    mp, mt, out = [x < 0 for x in p], [x < 0 for x in t], 0
    while True:
        best, most = [], least
        for a in range(len(p)):
            for b in range(len(t)):
                k = 0
                while a + k < len(p) and b + k < len(t) and not mp[a + k] and not mt[b + k] and p[a + k] == t[b + k]:
                    k += 1
                if k > most:
                    best, most = [(a, b, k)], k
                elif k == most and k >= least:
                    best.append((a, b, k))
        if not best:
            return out
        for a, b, k in best:
            if not any(mp[a : a + k]) and not any(mt[b : b + k]):
                out += k
                for x in range(k):
                    mp[a + x] = mt[b + x] = True


def test_tiles_cover_what_naive_tiling_covers():
    random.seed(4)
    for _ in range(200):
        p = np.array([random.randrange(4) for _ in range(random.randrange(3, 40))])
        t = np.array([random.randrange(-1, 4) for _ in range(random.randrange(3, 60))])
        got = D.tiles(p, t, 3)
        assert sum(n for _, _, n in got) == naive(p, t, 3)
        assert all((p[a : a + n] == t[b : b + n]).all() for a, b, n in got)


@pytest.fixture()
def bench(spark):
    return spark.createDataFrame([(7, "one two three four five six seven eight"), (8, None), (9, "too short"), (10, "")], "item_id long, text string")


def test_exact_reordered_and_clean(spark, docs_of, bench):
    texts = ["so One, two three FOUR five six seven eight!", "five six seven eight and then one two three four", "one two three four only", "nothing here", None, ""]
    got = D.matches(docs_of(texts), bench).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in got} == {(0, 7, 1.0), (1, 7, 1.0)}
    r = next(r for r in got if r.doc_id == 0)
    assert texts[0][r.spans[0].char_start : r.spans[0].char_end] == "One, two three FOUR five six seven eight"
    assert next(r for r in got if r.doc_id == 1).n_tiles == 2
    kept = D.clean(docs_of(texts).withColumn("coverage", F.lit("x")), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and "coverage" in kept.columns


def test_odd(spark, docs_of, odd, bench):
    assert D.matches(docs_of(odd, ids=[None] * 8), bench).count() == 0
    assert D.matches(docs_of([]), bench).count() == 0
    assert D.matches(docs_of(odd), bench.limit(0)).count() == 0
    assert D.clean(docs_of(odd), bench).count() == len(odd)


def test_blocks(spark, docs_of, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(20)], "item_id long, text string")
    docs = docs_of([" ".join(f"w{i}x{k}" for k in range(10)) for i in range(20)])
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted((r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()) == [(i, i) for i in range(20)]


def test_one_length_at_a_time_gives_the_same_tiles(monkeypatch):
    random.seed(9)
    for _ in range(200):
        v = random.choice([2, 3, 8])
        p = np.array([random.randrange(v) for _ in range(random.randrange(1, 40))])
        t = np.array([random.randrange(-1, v) for _ in range(random.randrange(1, 80))])
        monkeypatch.setattr(D, "PAIRS", 1 << 20)
        want = D.tiles(p, t, 3)
        monkeypatch.setattr(D, "PAIRS", 0)
        assert D.tiles(p, t, 3) == want


def test_repeats_are_bounded():
    import tracemalloc

    m = D.build([(1, "word " * 2000)], 4)
    tracemalloc.start()
    assert len(D.scan_text("word " * 20_000, m, 0.6)) == 1
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_short_repeated_and_unsegmented_items(spark, docs_of):
    bench = spark.createDataFrame([("a", "two words"), ("a", "two words"), ("b", "一个十七个字的测试句子在这里啊对吧"), ("c", "...")], "item_id string, text string").withColumn("coverage", F.lit("clash"))
    docs = docs_of(["here are two words", "two other words", "前面一个十七个字的测试句子在这里啊对吧后面", "..."]).withColumn("item_id", F.lit(1)).withColumn("spans", F.lit(2))
    got = sorted((r.doc_id, r.item_id) for r in D.matches(docs, bench).collect())
    assert got == [(0, "a"), (0, "a"), (2, "b")]


def test_pairs_equal_brute_force(spark, docs_of):
    random.seed(2)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(random.choices(vocab, k=random.randrange(4, 14)))) for i in range(12)]
    texts = [" ".join(random.choices(vocab, k=20)) if k % 3 else " x ".join([items[k % 12][1], items[(k + 5) % 12][1]]) for k in range(40)]
    got = {(r.doc_id, r.item_id) for r in D.matches(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    number = {w: i for i, w in enumerate([*vocab, "x"])}
    to = lambda s: [number[w] for w in s.split()]
    want = {(d, i) for d, x in enumerate(texts) for i, y in items if naive(to(y), to(x), 4) >= 0.6 * len(to(y)) - 1e-9}
    assert got == want and want
