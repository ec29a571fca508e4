import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cairn.llm import simhash as S
from cairn.llm.components import components, forest, tree


def slow_fp(text, words=4):
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))] if ws else []
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum((2 * n[b] > len(sh)) << b for b in range(64))


def groups(ids, close):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and close(a, b):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts_of(n=120, seed=1):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            out.append([random.choice(vocab) for _ in range(random.randrange(30, 120))])
        else:
            t = list(random.choice(out))
            for _ in range(random.randrange(0, 3)):
                t[random.randrange(len(t))] = random.choice(vocab)
            out.append(t)
    return [" ".join(t) for t in out]


def test_near_groups_against_brute_force(spark, docs_of, odd):
    texts = texts_of() + [t for t in odd if t is None or len(t) < 1000] + ["A b\x0bc D", "a\tB c d"]
    got = {r.doc_id: r for r in S.near_groups(docs_of(texts)).collect()}
    fps = {i: slow_fp(t) for i, t in enumerate(texts)}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    want = groups(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert {i: r.component_id for i, r in got.items()} == want


def test_near_groups_odd(spark, docs_of, odd):
    got = S.near_groups(docs_of(odd, ids=[None, 1, 2, 2, None, None, 6, 7]).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))).collect()
    assert len(got) == 8
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert S.near_groups(docs_of([])).count() == 0


def test_index_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    fps = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)])
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    bucket = np.repeat([0, 1], [100, len(fps) - 100])
    got = {(int(a), int(b)) for i, j in S.search(S.build(fps, bucket), 4) for a, b in zip(i, j)}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bucket[a] == bucket[b] and bin(int(fps[a] ^ fps[b])).count("1") <= 4}
    assert got == want


def test_hot_bucket_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BUCKET", 10)
    rng = np.random.default_rng(4)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 12, 60)})
    got = {(r.u, r.v) for r in S.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4}


def test_masks_cover():
    rng = np.random.default_rng(6)
    masks = S.block_masks(4)
    for _ in range(500):
        x = 0
        for b in rng.choice(64, 4, replace=False):
            x |= 1 << int(b)
        assert any(x & m == 0 for m in masks)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (3, 1)], "u long, v long")
    assert {r.node: r.root for r in components(e).collect()} == {2: 1, 3: 1, 8: 7, 9: 7}
    chain = spark.range(200).selectExpr("id u", "id + 1 v")
    assert components(chain).filter("root = 0").count() == 200
    assert components(e.limit(0)).count() == 0
    n, r = forest(np.array([4, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(n.tolist(), r.tolist())) == {2: 1, 4: 1, 9: 8}


def jaccard(a, b, words=5):
    f = lambda t: {" ".join(t.lower().split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))}
    x, y = f(a), f(b)
    return len(x & y) / len(x | y)


def test_dedup_against_brute_force(spark, docs_of, tmp_path):
    texts = texts_of(150, 7)
    want = groups(list(range(150)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    keep = {i for i, r in want.items() if i == r}
    docs = docs_of(texts).withColumn("__extra", F.lit(1))
    assert {r.doc_id for r in S.dedup(docs).collect()} == keep  # no file source
    docs.write.parquet(f"{tmp_path}/d")
    got = S.dedup(spark.read.parquet(f"{tmp_path}/d"))
    assert {r.doc_id for r in got.collect()} == keep and got.columns == docs.columns


def test_dedup_finds_every_kind_of_edit(spark, docs_of):
    """Appended, prepended, cut and reworded copies of texts of 10 to 300 words at any similarity from 0.8 on: recall is 1."""
    random.seed(11)
    word = lambda: f"w{int(random.paretovariate(0.6)) % 50_000}"
    texts = []
    for k in range(320):
        n = (10, 15, 30, 60, 200, 300)[k % 6]
        own, more = [word() for _ in range(n)], [word() for _ in range(max(1, n // random.choice([6, 9, 15])))]
        at = random.randrange(n)
        texts += [" ".join(own), " ".join([own + more, more + own, own[len(more) :], own[:at] + [word()] + own[at + 1 :]][k // 6 % 4])]
    want = groups(list(range(640)), lambda a, b: a // 2 == b // 2 and jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(want.values())) < 440
    assert {r.doc_id for r in S.dedup(docs_of(texts)).collect()} == set(want.values())


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300, 600, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for cut, more in ((0, 0), (1, 3), (n // 4, n // 5), (n // 2, 2 * n)):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            assert S.apart(S.parity(a), S.parity(b)) <= len(np.setxor1d(a, b))
    assert S.apart(S.parity(a), S.parity(np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)))) > S.most_apart(5000, 5000, 0.8)


def test_dedup_hot_shingles(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "HOT_BUCKET", 10)
    monkeypatch.setattr(S, "HELD", 50)
    texts = [t + " the same last line of every text here" for t in texts_of(80, 5)]
    want = groups(list(range(80)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert {r.doc_id for r in S.dedup(docs_of(texts)).collect()} == set(want.values())


def test_dedup_odd(spark, docs_of, odd):
    got = S.dedup(docs_of(odd, ids=[5, 6, 7, None, 4, 4, 8, 9])).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x)) == [4, 5, 8, 9, None]
    assert S.dedup(docs_of([])).count() == 0


def test_dedup_takes_links_from_the_fingerprint_index_first(spark, docs_of, monkeypatch):
    texts = [*texts_of(90, 9), "a b", "same " * 30, "same " * 40, None, " "]
    ids, tried, ok, searched = {}, [], [], []
    verified, links = S.verified, S.links

    def spy(rows, pairs, *a):
        ids.update({r["__row"]: r.doc_id for r in rows.select("__row", "doc_id").collect()})
        out = verified(rows, pairs, *a)
        for to, df in ((tried, pairs), (ok, out)):
            to.append({tuple(sorted((ids[r.u], ids[r.v]))) for r in df.collect()})
        return out

    monkeypatch.setattr(S, "verified", spy)
    monkeypatch.setattr(S, "links", lambda *a, **k: searched.append(1) or links(*a, **k))
    kept = {r.doc_id for r in S.dedup(docs_of(texts)).collect()}
    fps = [slow_fp(t, 5) for t in texts]
    within = lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4
    full = [i for i in range(len(texts)) if (texts[i] or "").split() and texts[i] not in texts[:i]]
    assert searched and tried[0] and all(within(a, b) for a, b in tried[0])
    linked = groups(full, lambda a, b: within(a, b) and jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(linked.values())) < len(full) and groups(full, lambda a, b: (a, b) in ok[0]) == linked
    for pairs, before in ((tried[1], ok[0]), (tried[2], ok[0] | ok[1])):  # the rest lies between the groups found so far
        so_far = groups(full, lambda a, b: (a, b) in before)  # noqa: B023
        assert all(so_far[a] != so_far[b] for a, b in pairs)
    want = groups(full, lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert ok[1] | ok[2] and kept == {i for i, r in want.items() if i == r} | {len(texts) - 2}


def test_index_pairs_connect_what_fingerprints_connect(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BUCKET", 10)
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 1 << 11, 70)] + [3, 3, 3, -1, None]
    got = {(r.u, r.v) for r in S.alike(spark.createDataFrame(list(enumerate(fps)), "node long, fp long"), 2).collect()}
    near = lambda a, b: None not in (fps[a], fps[b]) and bin((fps[a] ^ fps[b]) % 2**64).count("1") <= 2
    ids = range(len(fps))
    assert all(a < b and near(a, b) for a, b in got)
    assert groups(ids, lambda a, b: (a, b) in got) == groups(ids, near)


def test_tree_is_a_least_spanning_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 30, (2, 60))
        par, want = list(range(30)), []
        for e, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            if par[x] != par[y]:
                want.append(e)
                par = [par[y] if p == par[x] else p for p in par]
        assert tree(a, b).tolist() == want
    assert len(tree(a[:0], b[:0])) == 0
