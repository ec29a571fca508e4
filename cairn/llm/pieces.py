"""SentencePiece BPE encoding with seeded merge-dropout, and exact decoding.

The model file's pieces and scores are read with the sentencepiece library; merging is done here. A text is split before
every run of spaces (no piece of such a model holds a space after another sign; the model is checked for it), so each chunk
is merged by itself. In a chunk the agenda holds candidate merges; the best score, then the leftmost, comes first; a
candidate is skipped for good if its keyed hash (seed, row key, chunk number, place, left and right piece) falls under the
dropout rate: every occurrence of a word draws anew, and any worker gets the same result. With rate 0 the segmentation is
the library's own.

What a worker remembers of a chunk is a tree: an entry is the chunk merged with a known set of skips, and the candidates it
met on the way. An occurrence walks from entry to entry at its first skipped candidate, so no entry decides a skip.

All chunks of a batch that were not met before are merged together, one agenda step for every chunk at a time, in numpy.
"""

from __future__ import annotations

import heapq
import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

SPACE = "▁"
CACHE = 250_000  # chunks a worker remembers, and half of the entries
MEMO = 16  # longer chunks are not remembered under dropout
BLOCK = 200_000  # occurrences whose skips are drawn at once
LONG = 64  # longer chunks are merged one by one on a heap
SLICE = 1_024  # texts encoded at once, of a batch that is bounded in bytes
FEW = 1_200  # chunks under which each is merged on a heap: an array step costs as much for one row as for many
_CHUNK = re.compile(r" *[^ ]+| +")


class Pieces:
    """Pieces, scores and byte fallback of a SentencePiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [-1] * 256
        self.byte_of: dict[int, int] = {}
        self.id: dict[str, int] = {}
        scores = np.full(n, -np.inf)
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b], self.byte_of[i] = i, b
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p] = i
                scores[i] = sp.get_score(i)
                if SPACE in p.strip(SPACE) or p.rstrip(SPACE) != p and p.strip(SPACE):
                    raise ValueError(f"piece {p!r} holds a space after another sign: texts can't be split at spaces")
        if min(self.byte) < 0:
            raise ValueError("the model has no byte fallback: not every text could be decoded")
        # merge table: (left, right) -> merged piece, for every cut of every piece into two known ones
        best = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    best[(a << 32) | b] = i
        keys = np.array(sorted(best), dtype=np.int64)
        self.merge = best
        self.score = scores
        self.rank = np.full(n, np.iinfo(np.int32).max, dtype=np.int64)  # 0 is the best score
        self.rank[np.argsort(-scores, kind="stable")] = np.arange(n)
        self.sign = np.full(0x110000, -1, dtype=np.int64)  # code point -> piece; -2 - b: the one byte b; -1: several bytes
        self.sign[:128] = -2 - np.arange(128)
        for p, i in self.id.items():
            if len(p) == 1 and p != SPACE:
                self.sign[ord(p)] = i
        self.sign[32] = self.id.get(SPACE, -1)
        self.bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.byte_pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.byte_count = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self._hash_table(keys, np.array([best[int(k)] for k in keys], dtype=np.int64))

    def _hash_table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open table of two probes a bucket row, so that a lookup is a few array reads."""
        bits = int(np.ceil(np.log2(len(keys) * 2 + 2)))
        while True:
            h = (common.mix64(keys) >> np.uint64(64 - bits)).astype(np.int64)
            depth = np.bincount(h, minlength=1 << bits).max()
            if depth <= 6:
                break
            bits += 1
        o = np.argsort(h, kind="stable")
        h, keys, values = h[o], keys[o], values[o]
        slot = np.arange(len(h)) - np.searchsorted(h, h, "left")
        self.bits, self.depth = bits, int(depth)
        self.t_key, self.t_val = np.full((depth, 1 << bits), -1, dtype=np.int64), np.full((depth, 1 << bits), -1, dtype=np.int64)
        self.t_key[slot, h], self.t_val[slot, h] = keys, values

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged piece of each pair, -1 if there is none (or an end is -1)."""
        key = (left << 32) | right
        h = (common.mix64(key) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(key.shape, -1, dtype=np.int64)
        for d in range(self.depth):
            hit = self.t_key[d][h] == key
            if hit.any():
                out[hit] = self.t_val[d][h[hit]]
        out[(left < 0) | (right < 0)] = -1
        return out

    def start(self, chunk: str) -> list[int]:
        """Pieces of a chunk before merging: signs, or bytes as -2 - byte. A literal U+2581 goes to bytes, a space is U+2581."""
        out = []
        for c in chunk:
            i = None if c == SPACE else self.id.get(SPACE if c == " " else c)
            if i is None:
                out.extend(-2 - b for b in c.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out


def _candidate(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix64(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ((left << 32) | right).astype(np.uint64))


def _dropped(key: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, limit: np.uint64) -> np.ndarray:
    return common.mix64(key ^ _candidate(at, left, right), 5) < limit


_M64 = (1 << 64) - 1


def _mix(x: int, seed: int) -> int:
    """common.mix64 of one number."""
    z = (x + 0x9E3779B97F4A7C15 * (2 * seed + 1)) & _M64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
    return z ^ (z >> 31)


def agenda(sym: list[int], m: Pieces, key: int, limit: int, skip: int = 0, log: list | None = None) -> list[int]:
    """One chunk merged on a heap; the reference form of merge_all(). With a log, the candidates met go there and bits of skip decide."""
    n = len(sym)
    sym = list(sym)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j >= n or sym[i] < 0 or sym[j] < 0:
            return
        new = m.merge.get((sym[i] << 32) | sym[j])
        if new is None:
            return
        heapq.heappush(heap, (int(m.rank[new]), i, sym[i], sym[j], new))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        if not alive[i] or sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
            continue
        if log is not None:
            log.append((i, a, b))
            if skip >> (len(log) - 1) & 1:
                continue
        elif limit and _mix(key ^ _mix((i * 0x9E3779B97F4A7C15 & _M64) ^ (a << 32 | b), 0), 5) < limit:
            continue
        j = nxt[i]
        sym[i], alive[j] = new, False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return [s for s, ok in zip(sym, alive) if ok]


def merge_all(chunks: list[str], keys: np.ndarray, m: Pieces, limit: int, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Every chunk merged, all of them one agenda step at a time: piece ids end to end, and their number for each chunk.

    With a log, keys are bits of skips by candidate number, and (chunk number, hash) of the candidates met go to the log.
    """
    size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sign = m.sign[code]
    first = np.cumsum(size) - size
    odd = np.zeros(len(chunks), dtype=bool)  # with bytes, or too long for a block
    if len(sign):
        odd = np.logical_or.reduceat(sign == -1, np.minimum(first, len(sign) - 1))
    odd |= (size > LONG) | (len(chunks) < FEW)
    got: list[np.ndarray | list[int]] = []
    where: list[np.ndarray] = []
    counts = np.zeros(len(chunks), dtype=np.int64)
    byte = np.array(m.byte, dtype=np.int64)
    for i in np.flatnonzero(odd):
        if log is None:
            ids = np.array(agenda(m.start(chunks[i]), m, int(keys[i]), limit), dtype=np.int64)
        else:
            met: list[tuple] = []
            ids = np.array(agenda(m.start(chunks[i]), m, 0, 0, int(keys[i]), met), dtype=np.int64)
            if met:
                log.append((np.full(len(met), i), _candidate(*np.array(met, dtype=np.int64).T)))
        ids[ids < 0] = byte[-2 - ids[ids < 0]]
        got.append(ids)
        where.append(np.array([i]))
        counts[i] = len(ids)
    plain = np.flatnonzero(~odd)
    plain = plain[np.argsort(size[plain], kind="stable")]
    at = 0
    while at < len(plain):
        width = max(2, int(size[plain[at]]))
        width = width if width < 12 else -(-width // 4) * 4
        to = min(at + 40_000, int(np.searchsorted(size[plain], width, "right")))
        rows = plain[at:to]
        col = np.arange(width)
        inside = col[None, :] < size[rows, None]
        flat = np.where(inside, sign[np.minimum(first[rows, None] + col, len(sign) - 1)], -1)
        if log is None:
            _merge_block(flat, keys[rows], m, np.uint64(limit))
        else:
            log += [(rows[r], c) for r, c in _trace_block(flat, keys[rows], m)]
        counts[rows] = (flat != -1).sum(axis=1)
        ids = flat[flat != -1]
        ids[ids < 0] = byte[-2 - ids[ids < 0]]
        got.append(ids)
        where.append(rows)
        at = to
    if not got:
        return np.zeros(0, dtype=np.int32), counts
    order = np.concatenate(where)  # chunk of each run in got
    ids = np.concatenate(got).astype(np.int32)
    run = np.cumsum(counts[order]) - counts[order]
    start = np.empty(len(chunks), dtype=np.int64)
    start[order] = run
    return spread(ids, start, counts), counts


def spread(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[start : start + count] for each entry, end to end."""
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return pool[np.repeat(start, count) + at]


_NONE = np.iinfo(np.int64).max // 2


def _merge_block(sym: np.ndarray, keys: np.ndarray, m: Pieces, limit: np.uint64) -> None:
    """Merge rows of sym in place. Pieces keep their first place; -1 marks no piece; bytes (-2 and below) never merge."""
    width = sym.shape[1]
    rows = np.arange(len(sym))
    place = np.broadcast_to(np.arange(width), sym.shape).copy()
    left, right = np.where(sym < 0, -1, sym)[:, :-1], np.where(sym < 0, -1, sym)[:, 1:]
    cand = _score(left, right, place[:, :-1], keys[:, None], m, limit)
    work_sym, work_place = sym.copy(), place
    ids = rows
    while len(ids):
        best = np.argmin(cand[0], axis=1)  # the first of equal ranks is the leftmost
        go = cand[0][np.arange(len(ids)), best] < _NONE
        done = ~go
        if done.any():
            _store(sym, ids[done], work_sym[done], work_place[done])
            ids, work_sym, work_place, best = ids[go], work_sym[go], work_place[go], best[go]
            cand = (cand[0][go], cand[1][go])
            if not len(ids):
                return
        r = np.arange(len(ids))
        new = cand[1][r, best]
        w = work_sym.shape[1]
        work_sym[r, best] = new
        # close the gap at best + 1
        col = np.arange(w - 1)
        src = col[None, :] + (col[None, :] > best[:, None])
        ns = np.take_along_axis(work_sym, src, axis=1)
        np_ = np.take_along_axis(work_place, src, axis=1)
        rank, val = cand
        if w - 2 > 0:
            csrc = np.minimum(np.arange(w - 2)[None, :] + (np.arange(w - 2)[None, :] > best[:, None]), w - 2)
            rank, val = np.take_along_axis(rank, csrc, axis=1), np.take_along_axis(val, csrc, axis=1)
            for off in (-1, 0):
                p = best + off
                ok = (p >= 0) & (p < w - 2)
                if ok.any():
                    rr, pp = r[ok], p[ok]
                    a, b = ns[rr, pp], ns[rr, pp + 1]
                    s = _score(np.where(a < 0, -1, a), np.where(b < 0, -1, b), np_[rr, pp], keys[ids[ok]], m, limit)
                    rank[rr, pp], val[rr, pp] = s
            work_sym, work_place, cand = ns, np_, (rank, val)
        else:
            _store(sym, ids, ns, np_)
            return


def _trace_block(sym: np.ndarray, skip: np.ndarray, m: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """_merge_block with skips by bits; for each step the rows still at work and the hash of the candidate each met."""
    width = sym.shape[1]
    work, place = sym.copy(), np.broadcast_to(np.arange(width), sym.shape).copy()
    piece = np.where(work < 0, -1, work)
    rank, val = _score(piece[:, :-1], piece[:, 1:], place[:, :-1], np.uint64(0), m, np.uint64(0))
    ids = np.arange(len(sym))
    log: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        best = np.argmin(rank, axis=1)
        go = rank[np.arange(len(ids)), best] < _NONE
        if not go.all():
            sym[ids[~go]] = work[~go]
            ids, work, place, rank, val, best = ids[go], work[go], place[go], rank[go], val[go], best[go]
        if not len(ids):
            return log
        r = np.arange(len(ids))
        late = (skip[ids] >> np.uint64(len(log))) & np.uint64(1) == 1
        log.append((ids, _candidate(place[r, best], work[r, best], work[r, best + 1])))
        rank[r[late], best[late]] = _NONE
        k = np.flatnonzero(~late)
        if not len(k):
            continue
        b, n = best[k], np.arange(len(k))
        own = work[k]
        own[n, b] = val[k, b]
        src = np.arange(width)[None, :] + (np.arange(width)[None, :] > b[:, None])
        src = np.minimum(src, width - 1)
        own, at = np.take_along_axis(own, src, axis=1), np.take_along_axis(place[k], src, axis=1)
        own[:, -1] = -1
        src = np.minimum(src[:, :-1], width - 2)
        rk, vl = np.take_along_axis(rank[k], src, axis=1), np.take_along_axis(val[k], src, axis=1)
        rk[:, -1] = _NONE
        for off in (-1, 0):
            p = b + off
            ok = p >= 0
            x, y = own[n[ok], p[ok]], own[n[ok], p[ok] + 1]
            rk[n[ok], p[ok]], vl[n[ok], p[ok]] = _score(np.where(x < 0, -1, x), np.where(y < 0, -1, y), at[n[ok], p[ok]], np.uint64(0), m, np.uint64(0))
        work[k], place[k], rank[k], val[k] = own, at, rk, vl


def _score(left, right, place, key, m: Pieces, limit: np.uint64):
    new = m.lookup(left, right)
    rank = np.where(new >= 0, m.rank[new], _NONE)
    if limit:
        rank[(new >= 0) & _dropped(np.broadcast_to(key, new.shape), place, left, right, limit)] = _NONE
    return rank, new


def _store(sym: np.ndarray, ids: np.ndarray, work: np.ndarray, place: np.ndarray) -> None:
    sym[ids] = -1
    sym[ids, : work.shape[1]] = work


class _Words(dict):
    """Chunk -> number, given out at first sight."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        return n


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.all, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            grown = np.zeros(max(self.n + len(x), len(self.all) * 3 // 2), dtype=self.all.dtype)
            grown[: self.n] = self.all[: self.n]
            self.all = grown
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)


class Encoder:
    """Encodes texts with a memory of chunks that is emptied past CACHE chunks or twice as many entries."""

    def __init__(self, m: Pieces, rate: float, seed: int, most: int = CACHE) -> None:
        self.m, self.most = m, most
        self.limit = min(int(min(max(rate, 0.0), 1.0) * 2**64), 2**64 - 1)
        self.seed = common.mix64(np.array([seed & 0xFFFFFFFF], dtype=np.uint64) * np.uint64(1000003), 1)[0]
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.root = _Rows(np.int64)  # chunk -> entry without a skip, plus 1
        self.pool, self.met, self.child = _Rows(np.int32), _Rows(np.uint64), _Rows(np.int64)  # pieces; candidates; entry if skipped there, plus 1
        # an entry: its pieces, its candidates, the first of them that is open, skips before that
        self.start, self.count, self.first, self.end, self.open, self.skips = (_Rows(k) for k in (*[np.int64] * 5, np.uint64))

    def _enter(self, words: list[str], skips: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """New entries, their candidates before number `opened` decided."""
        log: list[tuple] = []
        ids, counts = merge_all(words, skips, self.m, 0, log)
        who, met = (np.concatenate(x) for x in zip(*log)) if log else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
        n = np.bincount(who, minlength=len(words))
        end = self.met.n + np.cumsum(n)
        got = self.count.n + np.arange(len(words))
        self.start.add(self.pool.n + np.cumsum(counts) - counts), self.count.add(counts)
        self.first.add(end - n), self.end.add(end), self.open.add(end - n + opened), self.skips.add(skips)
        self.pool.add(ids), self.met.add(met[np.argsort(who, kind="stable")]), self.child.add(np.zeros(len(met), dtype=np.int64))
        return got

    def _walk(self, entry: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences, places in met) of the first open candidate that each occurrence skips."""
        who, at = [], []
        for s in range(0, len(entry), BLOCK):
            e = entry[s : s + BLOCK]
            a, n = self.open.all[e], self.end.all[e] - self.open.all[e]
            place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            hit = np.flatnonzero(common.mix64(np.repeat(key[s : s + BLOCK], n) ^ self.met.all[place], 5) < np.uint64(self.limit))
            o = np.searchsorted(np.cumsum(n), hit, "right")
            new = np.ones(len(o), dtype=bool)
            new[1:] = o[1:] != o[:-1]
            who.append(s + o[new]), at.append(place[hit[new]])
        return np.concatenate(who), np.concatenate(at)

    def encode(self, texts: list[str | None], row_keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and their number for each text (0 for null and empty ones)."""
        if len(self.words) > self.most or self.count.n > 2 * self.most:
            self.forget()
        words: list[str] = []
        n = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                got = _CHUNK.findall(" " + t)  # the dummy space that the model puts first
                words += got
                n[k] = len(got)
        if not words:
            return np.zeros(0, dtype=np.int32), n
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        row = np.array([k & 0xFFFFFFFFFFFFFFFF for k in row_keys], dtype=np.uint64)
        with np.errstate(over="ignore"):
            key = common.mix64(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.repeat(row, n), 2)
        key = common.mix64(key ^ self.seed, 3)
        long = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) > MEMO if self.limit else np.zeros(len(words), dtype=bool)
        per_word, start = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        short = np.flatnonzero(~long)
        if len(short):
            seen = len(self.words)
            w = np.fromiter(map(self.words.__getitem__, compress(words, ~long)), dtype=np.int64, count=len(short))
            if self.limit:  # a chunk met for the first time, and once, is merged with its own skips: a tree would pay from the next time on
                chunk, at, times = np.unique(w, return_index=True, return_counts=True)
                once = at[(times == 1) & (chunk >= seen)]
                long[short[once]] = True
                short, w = np.delete(short, once), np.delete(w, once)
            if len(self.words) > self.root.n:
                self.root.add(np.zeros(len(self.words) - self.root.n, dtype=np.int64))
            chunk, at = np.unique(w, return_index=True)
            new = self.root.all[chunk] == 0
            if new.any():
                chunk, at = chunk[new], at[new]
                zero = np.zeros(len(chunk), dtype=np.int64)
                self.root.all[chunk] = 1 + self._enter([words[i] for i in short[at]], zero.astype(np.uint64), zero)
            entry = self.root.all[w] - 1
            left = np.arange(len(short)) if self.limit else np.zeros(0, dtype=np.int64)
            while len(left):
                who, at = self._walk(entry[left], key[short[left]])
                left = left[who]
                slot, one = np.unique(at, return_index=True)
                new = self.child.all[slot] == 0
                if new.any():
                    slot, one = slot[new], one[new]
                    e = entry[left[one]]
                    number = slot - self.first.all[e]
                    skips = self.skips.all[e] | (np.uint64(1) << number.astype(np.uint64))
                    self.child.all[slot] = 1 + self._enter([words[i] for i in short[left[one]]], skips, number + 1)
                if len(left):
                    entry[left] = self.child.all[at] - 1
            per_word[short], start[short] = self.count.all[entry], self.start.all[entry]
        pool = self.pool.all[: self.pool.n]
        far = np.flatnonzero(long)
        if len(far):
            ids, counts = merge_all([words[i] for i in far], key[far], self.m, self.limit)
            per_word[far], start[far] = counts, len(pool) + np.cumsum(counts) - counts
            pool = np.concatenate([pool, ids])
        total = np.concatenate([[0], np.cumsum(per_word)])
        ends = np.cumsum(n)
        return spread(pool, start, per_word), total[ends] - total[ends - n]


def decoded(ids: np.ndarray, m: Pieces) -> bytes:
    """The UTF-8 bytes of the text that was encoded."""
    return spread(m.byte_pool, m.byte_start[ids], m.byte_count[ids])[1:].tobytes()


def decode(ids, m: Pieces) -> str | None:
    """The text that was encoded, sign for sign."""
    return None if ids is None else decoded(np.asarray(ids, dtype=np.int64), m).decode("utf-8", "surrogatepass")


# -- Spark
_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model at path; a worker process reads it once."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


_ENCODERS: dict[tuple, Encoder] = {}


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", check: bool = True,
           at_once: int = SLICE, remembered: int = CACHE) -> DataFrame:
    """id, n_pieces, ids (array<int>), lossless (decoding gives the text back) for every row.

    Null text: null ids, count and lossless. Empty text: no ids. Repeated rows have the same key and come out the same;
    a null id keys as the seed alone. The model's path must be readable on every executor. Very long texts are encoded whole.
    at_once (texts) and remembered (chunks) trade memory for time; the result is the same.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        m = load(model)
        enc = _ENCODERS.setdefault((model, rate, seed, remembered), Encoder(m, rate, seed, remembered))  # a reused worker keeps its memory
        for big in batches:
            for at in range(0, big.num_rows, at_once):
                b = big.slice(at, at_once)
                texts = b.column("__text").to_pylist()
                flat, n = enc.encode(texts, b.column("__key").to_pylist())
                ends = np.cumsum(n)
                same = [None] * len(texts)
                if check:
                    same = [None if t is None else decoded(flat[e - k : e], m) == t.encode("utf-8", "surrogatepass") for t, k, e in zip(texts, n.tolist(), ends.tolist())]
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, pa.int32()))
                if null.any():
                    lists = pa.array([None if x else y for x, y in zip(null, lists.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("__id"), pa.array(n.astype(np.int32), mask=null), lists, pa.array(same, pa.bool_())], names=["__id", "n_pieces", "ids", "lossless"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("__key"), F.col(text_col).alias("__text"))
    return src.mapInArrow(common.frugal(run), f"__id {kind}, n_pieces int, ids array<int>, lossless boolean").withColumnRenamed("__id", id_col)
