import numpy as np
from pyspark.sql import functions as F

from cairn.llm import langid as L

WORDS = {"en": "the quick brown fox jumps over lazy dogs while nothing happens with this", "de": "der schnelle braune fuchs springt über faule hunde während nichts geschieht und", "fr": "le renard brun rapide saute par dessus les chiens paresseux où été"}


def corpus(spark, n=150):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out(spark):
    docs = corpus(spark)
    got = L.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.lang == r.lang_pred for r in held)
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_against_brute_force(spark):
    docs = corpus(spark, 30)
    m = L.train(docs.select("text", "lang"))
    for i, lang in enumerate(m["langs"]):
        c = np.zeros(1 << m["bits"])
        for r in docs.filter(F.col("lang") == lang).collect():
            g = L.grams(L.codes(r.text), m["orders"], m["bits"])
            c += np.bincount(g, minlength=len(c))
        assert np.allclose(m["logp"][i], np.log((c + 0.5) / (c.sum() + 0.5 * len(c))))


def test_long_texts_lose_nothing(monkeypatch):
    text = "abc déf ghi " * 50
    whole = np.sort(np.concatenate(list(L._window_grams(text, (2, 3), 12))))
    monkeypatch.setattr(L, "CHUNK", 37)
    assert (np.sort(np.concatenate(list(L._window_grams(text, (2, 3), 12)))) == whole).all()


def test_odd(spark, docs_of, odd):
    df = docs_of(odd + ["123 !!"], ids=[None] * 9, lang=None).withColumn("score", F.lit("clash"))
    got = L.identify(df).collect()
    assert len(got) == 9 and {r.lang_pred for r in got} == {"und"}
    m = L.train(corpus(spark, 30).select("text", "lang"))
    by = [r.lang_pred for r in L.predict(df, m).collect()]
    assert by.count("und") == 4 and len(by) == 9  # null, empty, blank, no letter
    assert L.predict(docs_of([]), m).count() == 0
