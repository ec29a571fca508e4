import random

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import toxicity as T


def corpus(n=400):
    random.seed(3)
    base = [f"w{i}ly" for i in range(300)]
    rows = []
    for i in range(n):
        words = [random.choice(base) for _ in range(60)]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(4):
                words[random.randrange(60)] = random.choice(["grobl" + s for s in ("en", "er", "is", "um", "ax", "oz")])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score_tables(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert held and sum(r.predicted == y for r, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    model = T.fit_on_tables(docs, labels)
    assert any(model["lex"][str(n)] for n in T.STARTS)  # word starts are induced too
    kept = {r.doc_id for r in T.keep_clean(docs, model, 0.3).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}


def test_odd(spark, docs_of, odd):
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(odd, ids=[None, 1, 2, 3, 4, 4, 6, 7]).withColumn("score", F.lit("clash"))
    got = T.score_tables(docs, labels).collect()
    assert len(got) == 8 and all(r.score == 0 and r.predicted == 0 for r in got)  # no two classes: no model
    lex = {"w": frozenset({"bad"}), "4": frozenset(), "5": frozenset(), "6": frozenset()}
    lin = T.fit_linear(np.random.default_rng(1).random((50, T.N_FEATURES)), np.linspace(0, 1, 50))
    assert T.score(docs, {"lex": lex, "linear": lin}).count() == 8
    assert T.score(docs_of([]), {"lex": lex, "linear": lin}).count() == 0
    assert T.keep_clean(docs, None, 0.3).count() == 8


def test_label_model_finds_the_good_voter():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    flip = lambda p: np.where(rng.random(4000) < p, ~y, y)
    votes = np.stack([np.where(flip(p), 1, -1) for p in (0.05, 0.2, 0.45)], axis=1)
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    lm = T.fit_label_model(pats, counts.astype(float), votes[:300], y[:300].astype(int))
    acc = [lm["theta"][v, 1, 2] for v in range(3)]
    assert acc[0] > acc[1] > acc[2]
    assert ((T.posterior(votes, lm) > 0.5) == y).mean() > 0.9


def test_duplicate_voters_count_once():
    y = np.random.default_rng(5).random(2000) < 0.3
    v = np.where(y, 1, -1)
    pats, counts = np.unique(np.stack([v, v, v], axis=1), axis=0, return_counts=True)
    lm = T.fit_label_model(pats, counts.astype(float), np.stack([v, v, v], axis=1)[:200], y[:200].astype(int))
    assert lm["correlation"][0, 1] == 1.0
