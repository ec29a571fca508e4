"""Fusion, rerank, caps and budgets over candidates (lane, lane_rank, target_type, target_id, content, raw_score)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C

KNOWN_LANES = ("vector", "lexical", "graph", "associative_graph", "community_summary", "temporal", "facts", "belief")


def route(lanes: dict[str, DataFrame], modes: list[str]) -> tuple[DataFrame, list[str]]:
    """All candidates of the wanted lanes, and the wanted modes that have no lane; semantic means vector too."""
    want = set(modes) | ({"vector"} if "semantic" in modes else set())
    use = [df for name, df in lanes.items() if not modes or name in want]
    missing = sorted(m for m in modes if m not in lanes and not (m == "semantic" and "vector" in lanes))
    if not use:
        raise ValueError(f"no lane for {modes}")
    return reduce(DataFrame.unionByName, use), missing


def _weight(weights: dict[str, float] | None, default: float) -> F.Column:
    w = F.lit(default)
    for lane, x in (weights or {}).items():
        if lane not in KNOWN_LANES:
            raise ValueError(f"unknown lane {lane}")
        if not np.isfinite(x) or x < 0:
            raise ValueError("weights must be finite and not negative")
        w = F.when(F.col("lane") == lane, x).otherwise(w)
    return w


def rrf(cands: DataFrame, k: int = 60, weights: dict[str, float] | None = None, default: float = 1.0, limit: int | None = None) -> DataFrame:
    """target_type, target_id, score, sources, source_score: sum of weight / (k + rank); order score desc, id asc."""
    if k <= 0:
        raise ValueError("k must be positive")
    c = cands.withColumn("part", _weight(weights, default) / (k + F.col("lane_rank")))
    best = F.struct("part", F.struct(-F.col("lane_rank"), "lane"), "raw_score")
    fused = c.groupBy("target_type", "target_id").agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("lane_rank", "lane"))), lambda x: x["lane"]), "+").alias("sources"),  # at most one entry a lane
        F.max(best)["raw_score"].alias("source_score"), F.min_by("content", "lane_rank").alias("content"),
    )
    out = fused.orderBy(F.desc("score"), "target_id")
    return out.limit(limit) if limit else out


def weighted_sum(cands: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0) -> DataFrame:
    """target_type, target_id, score, winner: weighted scores added up; winner is the lane of the largest part."""
    c = cands.withColumn("part", F.col("raw_score") * _weight(weights, default))
    return c.groupBy("target_type", "target_id").agg(F.round(F.sum("part"), 9).alias("score"), F.max(F.struct("part", -F.col("lane_rank"), "lane"))["lane"].alias("winner"))


def compose(fused: DataFrame, limit: int, budget: int | None = None) -> DataFrame:
    """fused with rank and omitted: those past min(limit, budget) are omitted with budget_exceeded, not lost."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "target_id"))  # fused lists are bounded by the lanes' limits
    k = min(limit, budget or limit)
    return fused.withColumn("rank", rank.cast("long")).withColumn("omitted", F.when(F.col("rank") > k, "budget_exceeded"))


def normalize(df: DataFrame, score: str = "score") -> DataFrame:
    top = df.agg(F.max(score).alias("__top"))
    return df.join(F.broadcast(top)).withColumn(score, F.when(F.col("__top") > 0, F.col(score) / F.col("__top")).otherwise(0.0)).drop("__top")


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1, keep_null: str | None = None) -> DataFrame:
    """The n first rows of every key; rows whose keep_null column is null stay all."""
    part = [*keys, *([F.when(F.col(keep_null).isNull(), F.monotonically_increasing_id())] if keep_null else [])]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


BUDGETS = {"code": (60, 25, 10, 5), "mixed": (35, 35, 20, 10), "doc": (15, 40, 35, 10)}


def lane_caps(shape: F.Column, limit: int) -> F.Column:
    """struct(entity, chunk, memory, other): max(1, limit * percent / 100) for a query shape."""
    at = {s: [max(1, limit * p // 100) for p in ps] for s, ps in BUDGETS.items()}
    pick = lambda i: F.when(shape == "code", at["code"][i]).when(shape == "mixed", at["mixed"][i]).otherwise(at["doc"][i])
    return F.struct(*(pick(i).alias(n) for i, n in enumerate(("entity", "chunk", "memory", "other"))))


def pack(df: DataFrame, text: str, order: list, chars: int = 2000, budget: int = 50_000) -> DataFrame:
    """The longest prefix in order whose excerpts fit in budget bytes, with the running size; for result lists."""
    cut = C.excerpt(F.col(text), chars)
    run = F.sum(F.octet_length(cut)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", run).filter(F.col("used") <= budget)


def inject_exact(fused: DataFrame, entities: DataFrame, query: str) -> DataFrame:
    """fused(target_id, name, score) with missing entities of matching name: at the top score if equal, else 0.8 of it."""
    q = query.strip().lower()
    name = F.lower("name")
    two = len(q.split()) <= 2
    match = (F.length("name") >= 3) & F.lit(len(q) >= 3) & ((name == q) | name.contains(q) | (F.lit(q).contains(name) if two else F.lit(False)))
    anchor = fused.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.05)).alias("anchor"))
    extra = entities.filter(match).select(F.col("id").alias("target_id"), "name").join(fused.select("target_id"), "target_id", "left_anti").join(F.broadcast(anchor))
    extra = extra.select("target_id", "name", F.when(name == q, F.col("anchor")).otherwise(F.col("anchor") * 0.8).alias("score"))
    return fused.select("target_id", "name", "score").unionByName(extra).withColumn("is_exact", F.coalesce(match, F.lit(False))).orderBy(F.desc("is_exact"), F.desc("score"), "target_id")


def mmr(cands: DataFrame, lam: float = 0.5, limit: int | None = None) -> DataFrame:
    """Greedy maximal marginal relevance per query: query, target_id, mmr_rank.

    cands: query, target_id, score, embedding (may be null: no penalty). Sequential by definition, so one task a query;
    a query's candidates are a bounded result list. Ties go to the better score, then the smaller id.
    """
    kind = cands.schema["target_id"].dataType.simpleString()
    qkind = cands.schema["query"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "target_id"], ascending=[False, True]).reset_index(drop=True)
        n = len(pdf)
        top = pdf["score"].max()
        rel = pdf["score"].to_numpy(dtype=float) / top if top > 0 else np.zeros(n)
        unit = []
        for e in pdf["embedding"]:
            v = None if e is None else np.asarray(e, dtype=float)
            unit.append(v / np.linalg.norm(v) if v is not None and len(v) and np.linalg.norm(v) > 0 else None)
        near, left, order = np.zeros(n), list(range(n)), []
        while left and (limit is None or len(order) < limit):
            value = [rel[i] if lam >= 1 else lam * rel[i] - (1 - lam) * near[i] for i in left]
            pick = left.pop(int(np.argmax(value)))
            order.append(pick)
            for i in left:
                if unit[i] is not None and unit[pick] is not None and len(unit[i]) == len(unit[pick]):
                    near[i] = max(near[i], float(unit[i] @ unit[pick]))
        return pd.DataFrame({"query": pdf["query"].iloc[order], "target_id": pdf["target_id"].iloc[order], "mmr_rank": range(1, len(order) + 1)})

    return cands.groupBy("query").applyInPandas(run, f"query {qkind}, target_id {kind}, mmr_rank long")
