"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become word ids. Shared seeds (token n-grams of the minimum match length, found by rolling
hash against the sorted hashes of all items) choose the items a document must be held against. For each such pair the
running Karp-Rabin tiling marks the longest non-overlapping matches again and again; the share of the item's tokens under
tiles is its coverage, whatever the order in which the passages stand in the document.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm import common

MIN_MATCH = 4
COVERAGE = 0.6
BLOCK_BYTES = 32 << 20
PAIRS = 1 << 20  # pairs of equal windows held at once
# a sign of a script written without spaces is a word of its own
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lower(text: str) -> str:
    """Lower case of the same length, so that places hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def window_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Rolling polynomial hash of every window of n ids (wrapping 64-bit arithmetic)."""
    if len(x) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(x), _BASE, dtype=np.uint64))
        down = np.cumprod(np.full(len(x), _INV, dtype=np.uint64))
        v = common.mix64(x.astype(np.uint64))
        s = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(v * up, dtype=np.uint64)])
        return (s[n:] - s[:-n]) * down[: len(x) - n + 1]


def tiles(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of p over t by running Karp-Rabin: (start in p, start in t, length), no overlaps in either.

    Ids below zero match nothing. Longest first; of equal lengths the earliest in p, then in t.
    """
    out: list[tuple[int, int, int]] = []
    free_p, free_t = p >= 0, t >= 0
    s = max(least, min(len(p), 32))
    while True:
        found = _scan(p, t, free_p, free_t, s)
        if found is None:  # too many equal windows to hold: one length at a time, with the same result
            return sorted(_by_length(p, t, free_p, free_t, least, out))
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        heap = [(-n, a, b) for a, b, n in found]
        heapq.heapify(heap)
        while heap:
            n, a, b = heapq.heappop(heap)
            n = -n
            ok = free_p[a : a + n] & free_t[b : b + n]
            if ok.all():
                out.append((a, b, n))
                free_p[a : a + n] = False
                free_t[b : b + n] = False
            else:  # what is left of an occluded match competes in pieces
                edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if y - x >= s:
                        heapq.heappush(heap, (x - y, a + x, b + x))
        if s == least:
            return sorted(out)
        s = max(least, s // 2)


def _free(x: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every window of s tokens that are all free."""
    h = window_hashes(x, s)
    c = np.concatenate([[0], np.cumsum(free)])
    at = np.flatnonzero(c[s:] - c[:-s] == s) if len(h) else np.zeros(0, dtype=np.int64)
    return at, h[at]


def _by_length(p: np.ndarray, t: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, least: int, out: list) -> list[tuple[int, int, int]]:
    """The tiling longest first, by the one length that is the longest now: memory follows the tokens, whatever repeats."""
    top = min(len(p), len(t))
    while True:
        lo, hi = least - 1, top
        while lo < hi:  # a match of n tokens holds one of n - 1
            mid = (lo + hi + 1) // 2
            if np.isin(_free(p, free_p, mid)[1], _free(t, free_t, mid)[1]).any():
                lo = mid
            else:
                hi = mid - 1
        if lo < least:
            return out
        ip, hp = _free(p, free_p, lo)
        it, ht = _free(t, free_t, lo)
        places: dict[int, list[int]] = {}
        for b, h in zip(it[::-1].tolist(), ht[::-1].tolist()):
            places.setdefault(h, []).append(b)  # the earliest last
        took = False
        for a, h in zip(ip.tolist(), hp.tolist()):
            todo = places.get(h)
            while todo and free_p[a : a + lo].all():
                b = todo.pop()  # a window of t that is no longer free never will be
                if free_t[b : b + lo].all() and np.array_equal(p[a : a + lo], t[b : b + lo]):
                    out.append((a, b, lo))
                    free_p[a : a + lo] = False
                    free_t[b : b + lo] = False
                    took = True
        top = lo if took else lo - 1


def _scan(p: np.ndarray, t: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, s: int) -> list[tuple[int, int, int]] | None:
    """Maximal free matches of at least s tokens, by the hashes of all free windows; None if their pairs are over PAIRS."""
    (ip, hp), (it, ht) = _free(p, free_p, s), _free(t, free_t, s)
    by = np.argsort(hp, kind="stable")
    order, keys = ip[by], hp[by]
    lo, hi = np.searchsorted(keys, ht, "left"), np.searchsorted(keys, ht, "right")
    n = hi - lo
    if not n.sum():
        return []
    if n.sum() > PAIRS:
        return None
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = order[np.repeat(lo, n) + at], np.repeat(it, n)
    o = np.lexsort((a, a - b))  # runs along diagonals are maximal matches
    a, b = a[o], b[o]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (np.diff(a - b) != 0) | (np.diff(a) != 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a))) + s - 1
    return [(int(x), int(y), int(k)) for x, y, k in zip(a[first], b[first], size) if np.array_equal(p[x : x + k], t[y : y + k])]


# -- model
def build(items: list[tuple], least: int = MIN_MATCH) -> dict:
    """Index of (item_id, text) rows: word ids, item token arrays, sorted seed hashes with their items."""
    vocab: dict[str, int] = {}
    ids, toks = [], []
    for item, text in items:
        words = [vocab.setdefault(w, len(vocab)) for w in _WORD.findall(lower(text or ""))]
        if words:
            ids.append(item)
            toks.append(np.array(words, dtype=np.int64))
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # seed length -> sorted seeds and their items; a short item is one seed
    size = np.array([min(least, len(t)) for t in toks], dtype=np.int64)
    for n in sorted(set(size.tolist())):
        own = np.flatnonzero(size == n)
        hs = [np.unique(window_hashes(toks[k], n)) for k in own]
        seed, owner = np.concatenate(hs), np.repeat(own, [len(h) for h in hs])
        o = np.argsort(seed, kind="stable")
        by[n] = seed[o], owner[o]
    return {"vocab": vocab, "ids": ids, "tokens": toks, "seeds": by, "length": np.array([len(t) for t in toks], dtype=np.int64)}


def scan_text(text: str | None, m: dict, coverage: float) -> list[tuple]:
    """(item_id, coverage, tiles) of items whose coverage reaches the threshold; tiles: (item token, document token, length)."""
    if not text or not m["seeds"]:
        return []
    get = m["vocab"].get
    t = np.array([get(w, -1) for w in _WORD.findall(lower(text))], dtype=np.int64)
    known = t >= 0
    if not known.any():
        return []
    out = []
    for least, (seed, owner) in m["seeds"].items():
        at, h = _free(t, known, least)
        lo, hi = np.searchsorted(seed, h, "left"), np.searchsorted(seed, h, "right")
        some = hi > lo
        if some.any():
            out += _held_against(t, at[some], lo[some], hi[some], owner, least, m, coverage)
    return out


def _shared(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray):
    """Blocks (item, place) of all seeds that a text shares with items, about PAIRS at a time."""
    total = np.cumsum(hi - lo)
    s = 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PAIRS, "right")))
        n = hi[s:e] - lo[s:e]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield owner[np.repeat(lo[s:e], n) + k], np.repeat(at[s:e], n)
        s = e


def _held_against(t: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, least: int, m: dict, coverage: float) -> list[tuple]:
    """Items of one seed length that the text covers. A tile of n tokens holds n / least seeds or more: items with fewer can't be."""
    seeds = np.zeros(len(m["ids"]), dtype=np.int64)
    for item, _ in _shared(at, lo, hi, owner):
        seeds += np.bincount(item, minlength=len(seeds))
    may = (seeds > 0) & (seeds * least >= coverage * m["length"] - 1e-9)
    if not may.any():
        return []
    got = [(i[may[i]], p[may[i]]) for i, p in _shared(at, lo, hi, owner)]
    item, pos = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    o = np.lexsort((pos, item))
    item, pos = item[o], pos[o]
    edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(item) != 0])), len(item))
    out = []
    for a, b in zip(edges, edges[1:]):
        p = m["tokens"][item[a]]
        where = np.unique((pos[a:b, None] + np.arange(least)).ravel())
        if len(np.unique(t[where])) < coverage * len(np.unique(p)) - 1e-9 and len(where) < coverage * len(p):
            continue  # not enough shared tokens for the threshold
        gap = np.flatnonzero(np.diff(where) != 1) + 1
        small = np.insert(t[where], gap, -1)  # only seeded stretches, kept apart
        back = np.insert(where, gap, -1)
        tiled = tiles(p, small, least)
        cov = sum(x[2] for x in tiled) / len(p)
        if cov >= coverage:
            out.append((m["ids"][item[a]], cov, [(x, int(back[y]), z) for x, y, z in tiled]))
    return out


def _models(benchmark: DataFrame, id_col: str, text_col: str, least: int):
    """Broadcast indexes of the benchmark, each of at most BLOCK_BYTES of text: any size is searched, block by block."""
    spark = benchmark.sparkSession
    b = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        part = b.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], least))  # bounded by the block size


MATCHES = "coverage double, n_tiles int, longest_tile int, spans array<struct<item_at:int,char_start:int,char_end:int,tokens:int>>"


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) with coverage at or over the threshold: id, item_id, coverage, tiles and their places.

    Null and blank texts match nothing; an item of fewer than `least` tokens is held when all of it stands in a row, and one without a
    token never. Repeated rows and repeated items are reported each. Ties between tiles go to the earliest place. Places are code point offsets in the whole text.
    """
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = f"__id {kind}, item_id {benchmark.schema[item_col].dataType.simpleString()}, {MATCHES}"
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for shared in _models(benchmark, item_col, item_text, least):

        def run(batches, shared=shared):
            for b in batches:
                rows = []
                for i, text in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist()):
                    found = scan_text(text, shared.value, coverage)
                    if found:
                        at = [x.span() for x in _WORD.finditer(lower(text))]
                        for item, cov, ts in found:
                            spans = [{"item_at": x, "char_start": at[y][0], "char_end": at[y + n - 1][1], "tokens": n} for x, y, n in ts]
                            rows.append((i, item, cov, len(ts), max(x[2] for x in ts), spans))
                if rows:
                    cols = list(zip(*rows))
                    span = pa.list_(pa.struct([(c, pa.int32()) for c in ("item_at", "char_start", "char_end", "tokens")]))
                    kinds = [b.column("__id").type, item_kind, pa.float64(), pa.int32(), pa.int32(), span]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["__id", "item_id", "coverage", "n_tiles", "longest_tile", "spans"])

        part = src.mapInArrow(common.frugal(run), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("__id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns are kept, no join, so null and repeated ids are safe."""
    common.ship(docs.sparkSession)
    for shared in _models(benchmark, "item_id", "text", least):

        def run(batches, shared=shared):
            for b in batches:
                keep = [not scan_text(t, shared.value, coverage) for t in b.column(text_col).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(common.frugal(run), docs.schema)
    return docs
