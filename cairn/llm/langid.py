"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are added up in Spark over every eligible text; the log-probability matrix (classes x buckets) is broadcast,
its size checked first; scoring gathers and adds its columns per batch of texts in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

UNDETERMINED = "und"
BUCKET_BITS = 15
ORDERS = (2, 3, 4)
MAX_MODEL_BYTES = 256 << 20
CHUNK = 1 << 20  # code points hashed at once: bounds memory for very long texts


def _fold_table() -> np.ndarray:
    """Code point -> itself for letters, space for all else (over the basic plane)."""
    t = np.full(0x10000, 32, dtype=np.uint32)
    for i in range(0x10000):
        if chr(i).isalpha():
            t[i] = i
    return t


_FOLD: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """The text in lower case as code points, with a space at both ends and for every run of other signs."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(raw < 0x10000, _FOLD[0][np.minimum(raw, 0xFFFF)], raw)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return np.concatenate([[32], c[keep], [32]]).astype(np.uint32)


def grams(c: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of every n-gram of every order, in one array."""
    out = []
    c64 = c.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in orders:
            if len(c64) < n:
                continue
            h = np.full(len(c64) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ c64[k : len(c64) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(20)) & np.uint64((1 << bits) - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def _window_grams(text: str, orders: tuple[int, ...], bits: int):
    c = codes(text)
    if len(c) <= CHUNK:
        yield grams(c, orders, bits)
        return
    for n in orders:
        for at in range(0, len(c), CHUNK):
            yield grams(c[at : at + CHUNK + n - 1], (n,), bits)


def _counter(orders: tuple[int, ...], bits: int):
    def run(batches):
        tables: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                t = tables.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for g in _window_grams(text, orders, bits):
                    t += np.bincount(g, minlength=1 << bits)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            names = ["lang", "bucket", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(t[at], docs[lang]))], names=names)

    return run


def train(labelled: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS, alpha: float = 0.5) -> dict:
    """Fit on every row of (text, lang); null lang, null text and texts without a letter are left out.

    Returns {"langs": sorted names, "logp": float64 [classes, buckets], "prior": float64 [classes], ...}.
    Only class x bucket counts come to the driver; a matrix over MAX_MODEL_BYTES is refused.
    """
    rows = labelled.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    counts = rows.select("text", "lang").mapInArrow(_counter(orders, bits), "lang string, bucket long, n long")
    total = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs_n = (1 << bits) * 8
    got = total.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("c")  # at most 2^bits + 1 entries a class
    )
    most = MAX_MODEL_BYTES // langs_n
    rows_ = got.limit(most + 1).collect()
    if len(rows_) > most:
        raise ValueError(f"over {most} classes: the model would pass {MAX_MODEL_BYTES} bytes")
    rows_.sort(key=lambda r: r["lang"])
    langs = [r["lang"] for r in rows_]
    logp = np.zeros((len(langs), 1 << bits))
    prior = np.zeros(len(langs))
    for i, r in enumerate(rows_):
        c = np.zeros(1 << bits)
        for e in r["c"]:
            if e["bucket"] < 0:
                prior[i] = e["n"]
            else:
                c[e["bucket"]] = e["n"]
        logp[i] = np.log((c + alpha) / (c.sum() + alpha * (1 << bits)))
    if len(langs):
        prior = np.log(prior / prior.sum())
    return {"langs": langs, "logp": logp, "prior": prior, "orders": orders, "bits": bits}


def score_text(text: str | None, model: dict, by_bucket: np.ndarray) -> tuple[str, float]:
    """The best language and its posterior; by_bucket is logp transposed, float32."""
    if not text or not model["langs"] or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    total = model["prior"].copy()
    for g in _window_grams(text, model["orders"], model["bits"]):
        if not len(g):
            continue
        counts = np.bincount(g, minlength=by_bucket.shape[0]) if len(g) > by_bucket.shape[0] else None
        if counts is None:  # sparse: only this text's own buckets
            total += by_bucket[g].sum(axis=0, dtype=np.float64)
        else:
            total += counts @ by_bucket
    k = int(np.argmax(total))
    return model["langs"][k], float(1.0 / np.exp(total - total[k]).sum())


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for every row. `und` with score 0 if the text is null, empty or has no letter.

    Ties go to the alphabetically first language. Repeated rows are scored each; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(
        {"langs": model["langs"], "prior": model["prior"], "orders": model["orders"], "bits": model["bits"], "by_bucket": np.ascontiguousarray(model["logp"].T.astype(np.float32))}
    )

    def run(batches):
        m = shared.value
        for b in batches:
            got = [score_text(t, m, m["by_bucket"]) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["__id", "lang_pred", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, f"__id {kind}, lang_pred string, score double")
    return scored.withColumnRenamed("__id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from rows outside the held-out fold (crc32 of the id as text, mod folds), then predict every row."""
    common.ship(docs.sparkSession)
    fit_rows = docs.filter(common.crc_mod(id_col, folds) != held).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = predict(docs, train(fit_rows), id_col, text_col)
    return out.select(id_col, (common.crc_mod(id_col, folds) == held).alias("held_out"), "lang_pred", "score")
