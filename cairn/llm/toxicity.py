"""Toxicity by weak supervision.

Voters (lexicons and word-start patterns, some built in, some induced from a bounded labelled sample) vote toxic, clean or
abstain on every text. A generative label model is fitted by EM to the counts of all vote patterns of the whole corpus: it
estimates each voter's accuracies and, from what the votes still share given the class, the voters' correlations, which
discount redundant votes. Its posteriors label the sample on which the linear classifier is fitted that scores every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

SAMPLE = 20_000  # labelled rows used for induction and fitting, at most
LEXICON = 4_000  # induced entries of each kind, at most
MIN_TOXIC_SHARE = 0.002  # of the toxic sample texts that must hold an entry; three texts at least
STARTS = (4, 5, 6)
SEEDS = frozenset(
    "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting vermin filth filthy bastard bitch dumb dumbass "
    "imbecile cretin retard retarded slut whore asshole fucking fuck shit shithead scumbag dickhead wanker twat dimwit halfwit nitwit clown "
    "dummkopf arschloch trottel abschaum drecksau wichser schlampe hurensohn vollidiot depp connard connasse salope ordure abruti crétin "
    "débile enculé merde putain idiota imbécil estúpido estúpida gilipollas cabrón puta pendejo basura asqueroso".split()
)
_WORD = re.compile(r"[^\W\d_]+")
VOTERS = ("seed_words", "seed_density", "induced_words", "start4", "start5", "start6", "induced_density")
N_FEATURES = 14


# -- lexicon induction
def _units(text: str | None) -> set[str]:
    """Distinct words and word starts of a text as kind:entry."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return {f"w:{w}" for w in words} | {f"{n}:{w[:n]}" for n in STARTS for w in words if len(w) > n}


def _count_units(batches):
    """e, p, q: partial numbers of toxic and clean texts that hold an entry; given out before they fill the memory."""
    seen: dict[str, list[int]] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["e", "p", "q"])
        seen.clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            for e in _units(text):
                seen.setdefault(e, [0, 0])[0 if toxic else 1] += 1
        if len(seen) > 200_000:
            yield flush()
    if seen:
        yield flush()


def induce(sample: DataFrame) -> dict[str, frozenset]:
    """Entries that mark toxic texts of sample(text, toxic): smoothed log-odds and their certainty over thresholds.

    At most LEXICON entries of each kind come back, the best first, so what is broadcast has a fixed bound.
    """
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    counted = sample.select("text", "toxic").mapInArrow(common.frugal(_count_units), "e string, p long, q long").groupBy("e").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = counted.filter(F.col("p") >= max(3.0, MIN_TOXIC_SHARE * n1))
    odds = F.log((F.col("p") + 0.1) / (n1 + 0.2)) - F.log((F.col("q") + 0.5) / (n0 + 1.0))
    z = odds / F.sqrt(1 / (F.col("p") + 0.1) + 1 / (F.col("q") + 0.5))
    scored = common.cut(both.withColumn("odds", odds).withColumn("z", z).filter("odds > 3.0 and z > 2.0"), "lexicon")
    out: dict[str, frozenset] = {}
    for kind in ("w", *map(str, STARTS)):
        rows = scored.filter(F.col("e").startswith(f"{kind}:")).orderBy(F.desc("z"), "e").limit(LEXICON).collect()
        out[kind] = frozenset(r["e"].split(":", 1)[1] for r in rows)
    return out


# -- votes and features of one text
class Memo(dict):
    """Word -> bit mask of the lexicons that hold it; cleared when it grows past a bound."""

    def __init__(self, lex: dict[str, frozenset]) -> None:
        super().__init__()
        self.lex = lex
        self.has = [bool(lex.get(k)) for k in ("w", *map(str, STARTS))]

    def __missing__(self, w: str) -> int:
        lex = self.lex
        m = (w in SEEDS) | (w in lex.get("w", ())) << 1
        for k, n in enumerate(STARTS):
            if len(w) > n and w[:n] in lex.get(str(n), ()):
                m |= 4 << k
        if len(self) > 200_000:
            self.clear()
        self[w] = m
        return m


def measure(text: str | None, memo: Memo) -> tuple[tuple[int, ...], np.ndarray]:
    """Votes (1 toxic, -1 clean, 0 none) and features of a whole text; a text without words has no hit."""
    words = _WORD.findall(text.lower()) if text else []
    hits = [m for m in map(memo.__getitem__, words) if m]
    n = len(words)
    counts = [sum(m >> k & 1 for m in hits) for k in range(5)]
    rate = [100.0 * c / n if n else 0.0 for c in counts]
    has = memo.has  # a lexicon without entries abstains
    votes = (
        1 if counts[0] >= 2 else 0,
        1 if rate[0] >= 0.5 else (-1 if counts[0] == 1 and n > 1000 else 0),
        (1 if counts[1] >= 2 else (0 if counts[1] else -1)) if has[0] else 0,
        *((1 if c >= 2 else (0 if c else -1)) if h else 0 for c, h in zip(counts[2:5], has[1:])),
        ((1 if rate[1] >= 0.3 and counts[1] >= 2 else 0) if counts[1] else -1) if has[0] else 0,
    )
    x = np.array([*np.log1p(counts), *np.log1p(rate), float(bool(counts[1])), float(any(counts[2:])), float(counts[1] >= 2), np.log1p(n)])
    return votes, x


# -- label model
ANCHOR = 50.0  # weight, in texts per class, of the labelled sample in each voter's accuracies


def _shares(votes: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
    """P(vote) per voter under weights w, with base as pseudo-counts [voters, 3]."""
    got = np.array([np.bincount(votes[:, v] + 1, weights=w, minlength=3) for v in range(votes.shape[1])]) + base
    return got / got.sum(axis=1, keepdims=True)


def _logit(patterns: np.ndarray, theta: np.ndarray, corr: np.ndarray, pi: float) -> np.ndarray:
    """Log-odds of toxic. A voter that abstains says nothing; one that votes is discounted by the voters it votes with."""
    out = np.full(len(patterns), np.log(pi / (1 - pi)))
    voting = (patterns != 0).astype(float)
    weight = 1 / (1 + voting @ corr)
    for v in range(patterns.shape[1]):
        x = patterns[:, v]
        out += np.where(x != 0, weight[:, v] * np.log(theta[v, 1, x + 1] / theta[v, 0, x + 1]), 0.0)
    return np.clip(out, -50, 50)


def _correlations(patterns: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """What two voters share given the class, over the texts on which both vote."""
    m = patterns.shape[1]
    corr = np.zeros((m, m))
    for u in range(m):
        for v in range(u):
            both = (patterns[:, u] != 0) & (patterns[:, v] != 0)
            x, y = patterns[both, u].astype(float), patterns[both, v].astype(float)
            cov = vx = vy = 0.0
            for w in weights:
                k = w[both]
                if k.sum() > 0:
                    dx, dy = x - k @ x / k.sum(), y - k @ y / k.sum()
                    cov, vx, vy = cov + k @ (dx * dy), vx + k @ (dx * dx), vy + k @ (dy * dy)
            same = (x == y).all() and both.any()  # two voters that never differ are one
            corr[u, v] = corr[v, u] = 1.0 if same else max(0.0, cov / np.sqrt(vx * vy)) if vx > 0 and vy > 0 else 0.0
    return corr


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, truth: np.ndarray, rounds: int = 60) -> dict:
    """EM over vote patterns (rows of -1, 0, 1) of the corpus with their counts.

    known, truth: votes and labels of the labelled sample; they start the fit and stay in it as pseudo-counts.
    theta[v, class, vote + 1]: P(vote | class). correlation[v, w]: what the votes share given the class; a voter counts
    1 / (1 + sum of its correlations with the others that vote).
    """
    m = patterns.shape[1]
    pi = float(np.clip(truth.mean(), 1e-3, 0.5))
    base = np.stack([ANCHOR * _shares(known, (truth == c).astype(float), np.full((m, 3), 1 / 3)) for c in (0, 1)], axis=1)
    theta = base / base.sum(axis=2, keepdims=True)
    corr = np.zeros((m, m))
    for r in range(rounds):
        post = 1 / (1 + np.exp(-_logit(patterns, theta, corr, pi)))
        by_class = [counts * (1 - post), counts * post]
        for c in (0, 1):
            theta[:, c] = _shares(patterns, by_class[c], base[:, c])
        if r % 10 == 9:
            corr = _correlations(patterns, by_class)
    return {"theta": theta, "correlation": corr, "pi": pi}


def posterior(patterns: np.ndarray, lm: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-_logit(patterns, lm["theta"], lm["correlation"], lm["pi"])))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> dict:
    """Logistic regression on soft labels by Newton's method; features are standardised first."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(reg), z.T @ (p - y) + reg * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "sd": sd, "w": w}


def linear_score(x: np.ndarray, lin: dict) -> np.ndarray:
    z = np.hstack([(x - lin["mean"]) / lin["sd"], np.ones((len(x), 1))])
    return 1 / (1 + np.exp(-np.clip(z @ lin["w"], -30, 30)))


# -- Spark
def train(docs: DataFrame, labelled: DataFrame) -> dict | None:
    """Model from docs(text) and labelled(text, toxic), a sample that the caller has bounded.

    None if the labels don't hold both classes.
    """
    common.ship(docs.sparkSession)
    spark = docs.sparkSession
    lab = labelled.filter("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    lab = common.cut(lab.repartition(common.parts(spark)), "toxic-sample")
    lex = induce(lab)
    if not lex:
        return None
    shared = spark.sparkContext.broadcast(lex)

    def votes(batches):
        seen: dict[tuple, int] = {}
        memo = Memo(shared.value)
        for b in batches:
            for t in b.column("text").to_pylist():
                v = measure(t, memo)[0]
                seen[v] = seen.get(v, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["v", "n"])

    counted = docs.select("text").mapInArrow(common.frugal(votes), "v array<int>, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()  # at most 3^7 rows

    def features(batches):
        memo = Memo(shared.value)
        for b in batches:
            got = [measure(t, memo) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(v) for v, _ in got], pa.list_(pa.int32())), pa.array([list(x) for _, x in got], pa.list_(pa.float64())), b.column("toxic")], names=["v", "x", "toxic"]
            )

    rows = lab.mapInArrow(common.frugal(features), "v array<int>, x array<double>, toxic int").collect()  # at most SAMPLE rows
    y = np.array([r["toxic"] for r in rows])
    known = np.array([r["v"] for r in rows])
    lm = fit_label_model(np.array([r["v"] for r in counted]), np.array([float(r["n"]) for r in counted]), known, y)
    x = np.array([r["x"] for r in rows])
    soft = posterior(known, lm)
    return {"lex": lex, "label_model": lm, "linear": fit_linear(x, soft)}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) for every row. Null and empty texts are scored as texts without a hit; without a model, 0."""
    common.ship(docs.sparkSession)
    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast({"lex": model["lex"], "linear": model["linear"]})

    def run(batches):
        memo = Memo(shared.value["lex"])
        for b in batches:
            texts = b.column("__text").to_pylist()
            x = np.array([measure(t, memo)[1] for t in texts]).reshape(len(texts), N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(linear_score(x, shared.value["linear"]))], names=["__id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(common.frugal(run), f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def keep_clean(docs: DataFrame, model: dict | None, threshold: float, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at or over the threshold; all columns stay."""
    common.ship(docs.sparkSession)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast({"lex": model["lex"], "linear": model["linear"]})

    def run(batches):
        memo = Memo(shared.value["lex"])
        for b in batches:
            texts = b.column(text_col).to_pylist()
            x = np.array([measure(t, memo)[1] for t in texts]).reshape(len(texts), N_FEATURES)
            yield b.filter(pa.array(linear_score(x, shared.value["linear"]) < threshold))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def fit_on_tables(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> dict | None:
    """Train on labels outside the held-out fold (crc32 of the id as text, mod folds); votes come from all docs.

    Labels that differ for one id count as toxic; of several texts of one id the least in order is taken. None without labels.
    """
    lab = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(common.crc_mod("doc_id", folds) != held)
    # the SAMPLE ids lowest in hash: only ids are ranked, texts are not gathered in one place
    ids = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").filter("text is not null")
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a repeated id counts once
    return train(docs, rows.select("text", "toxic"))


def score_tables(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    out = score(docs, fit_on_tables(docs, labels, folds, held))
    return out.select("doc_id", (common.crc_mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
