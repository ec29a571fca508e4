"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are first split by masked bit patterns: for links within k bits the 64 bits are cut in k+2 blocks, and two
fingerprints within k bits agree on at least two of them, so every link lies in one of C(k+2, 2) tables. The rows of one
table and pattern are sorted by Gray rank. Over each sorted run an index is built bottom-up: a node holds the bits all of
its members share (value and mask). The search walks pairs of nodes from the top, adds up the differences on bits both
nodes fix, and drops a pair of whole groups once they pass k.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import common
from cairn.llm.components import components, forest, tree

FAN = 8
SLICE = 1 << 17
HOT_BUCKET = 50_000
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints
def shingle_hashes(text: bytes | None, words: int, seed: int = 42):
    """Blocks of XXH64 values of the text's word shingles, repeats included; nothing if there is no word."""
    ws = text.lower().split() if text else []  # bytes: A-Z only, and exactly the six ASCII spaces
    if not ws:
        return
    joined = b" ".join(ws)
    ends = list(accumulate((len(w) + 1 for w in ws), initial=0))  # start of each word; the last: end + 1
    h = xxhash.xxh64_intdigest
    n = max(1, len(ws) - words + 1)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        yield np.array([h(joined[s : e - 1], seed) for s, e in zip(ends[at:to], ends[at + min(words, len(ws)) : to + words])], dtype=np.uint64)


def fold(blocks) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    n = 0
    for h in blocks:
        for at in range(0, len(h), 8192):
            part = h[at : at + 8192]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """__id and one bigint fp0, fp1, ... per seed."""

    def run(batches):
        for b in batches:
            texts = b.column("__text").to_pylist()
            cols = [pa.array(np.array([fold(shingle_hashes(t, words, s)) for t in texts], dtype=np.uint64).view(np.int64)) for s in seeds]
            yield pa.RecordBatch.from_arrays([b.column("__id"), *cols], names=["__id", *(f"fp{k}" for k in range(len(seeds)))])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    return src.mapInArrow(common.frugal(run), f"__id {kind}, " + ", ".join(f"fp{k} bigint" for k in range(len(seeds))))


# -- index
def block_masks(k: int, bits: int = 64) -> list[int]:
    """Masks of two of k+2 blocks: two fingerprints within k bits agree on at least one mask."""
    cuts = [bits * i // (k + 2) for i in range(k + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Position of the bit pattern in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def build(fps: np.ndarray, bucket: np.ndarray, tag: np.ndarray | None = None) -> list[dict]:
    """Levels of the index over runs of equal bucket, each sorted by Gray rank; level 0 are the fingerprints.

    tag: where all members of a node have one tag, the node has it too, and pairs within one tag are not searched.
    """
    levels = [{"value": fps, "mask": np.full(len(fps), _ONES), "bucket": bucket}]
    if tag is not None:
        levels[0] |= {"tag": tag, "one": np.ones(len(fps), dtype=bool)}
    while True:
        low = levels[-1]
        b = low["bucket"]
        new = np.ones(len(b), dtype=bool)
        new[1:] = b[1:] != b[:-1]
        first = np.flatnonzero(new)
        if len(first) == len(b):
            return levels
        pos = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        start = np.flatnonzero(pos % FAN == 0)
        same = np.bitwise_and.reduceat(low["mask"], start)
        ones = np.bitwise_and.reduceat(low["value"] | ~low["mask"], start)
        any_ = np.bitwise_or.reduceat(low["value"] & low["mask"], start)
        mask = same & ~(ones ^ any_)
        up = {"value": ones & mask, "mask": mask, "bucket": b[start], "start": np.append(start, len(b))}
        if tag is not None:
            same_tag = np.minimum.reduceat(low["tag"], start) == np.maximum.reduceat(low["tag"], start)
            up |= {"tag": low["tag"][start], "one": same_tag & np.logical_and.reduceat(low["one"], start)}
        levels.append(up)


def search(levels: list[dict], k: int):
    """Blocks (i, j), i < j, of positions whose fingerprints lie within k bits in the same bucket."""
    top = len(levels) - 1
    roots = np.arange(len(levels[top]["value"]))
    stack = [(top, roots, roots)]
    while stack:
        lv, i, j = stack.pop()
        if lv == 0:
            yield i, j
            continue
        if len(i) > SLICE // (FAN * FAN):
            n = SLICE // (FAN * FAN)
            stack.extend((lv, i[s : s + n], j[s : s + n]) for s in range(0, len(i), n))
            continue
        st, low = levels[lv]["start"], levels[lv - 1]
        ni, nj = st[i + 1] - st[i], st[j + 1] - st[j]
        size = ni * nj
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(nj, size)
        x, y = np.repeat(st[i], size) + at // width, np.repeat(st[j], size) + at % width
        keep = (x < y) if lv == 1 else (x <= y)
        x, y = x[keep], y[keep]
        both = low["mask"][x] & low["mask"][y]
        near = np.bitwise_count((low["value"][x] ^ low["value"][y]) & both) <= k
        if "tag" in low:
            near &= ~(low["one"][x] & low["one"][y] & (low["tag"][x] == low["tag"][y]))
        if near.any():
            stack.append((lv - 1, x[near], y[near]))


def _bucketed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """t, key, c1, c2, c, fp (, id, tag) in runs sorted by Gray rank; a bucket over HOT_BUCKET is split in chunks, met two by two."""
    n_parts = common.parts(fps.sparkSession)
    own = [c for c in ("fp", "id", "tag") if c in fps.columns]
    keyed = fps.select(*own, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "key"))
    big = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_BUCKET)
    big = big.select("t", "key", F.ceil(F.col("n") / HOT_BUCKET).cast("int").alias("m"))
    row = keyed.join(big, ["t", "key"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    row = row.withColumn("c", F.pmod(F.xxhash64(own[1] if len(own) > 1 else "fp"), F.col("m")).cast("int"))
    row = row.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    row = row.select("t", "key", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "c", *own)
    return row.repartition(n_parts, "t", "key", "c1", "c2").sortWithinPartitions("t", "key", "c1", "c2", gray_rank(F.col("fp")))


def links(fps: DataFrame, k: int, masks: list[int] | None = None, spanning: bool = False, own: bool = False) -> DataFrame:
    """u, v: pairs of rows whose fingerprints (column fp) lie within k bits, each pair once, u < v.

    Rows are named by column id, or by fp itself; rows of equal column tag, where there is one, make no pair.
    Without masks the result is exact. With own masks, pairs that agree on none are not found.
    spanning: instead of all pairs, fewer links that connect the same.
    own: so too, but each is a pair within k bits itself, the nearest are preferred, and a row has about one in each table.
    """
    masks = masks or block_masks(k)
    m64 = np.array(masks, dtype=np.uint64)
    names = ["t", "key", "c1", "c2", "c", *(c for c in ("fp", "id", "tag") if c in fps.columns)]
    named, tagged = "id" in fps.columns, "tag" in fps.columns

    def emit(cols: dict[str, np.ndarray]):
        t, key, c1, c2, c = (cols[n] for n in names[:5])
        fp = cols["fp"].view(np.uint64)
        ids = cols["id"] if named else fp
        tag = cols["tag"] if tagged else None
        new = np.zeros(len(t), dtype=np.int64)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        us, vs, ds, held = [], [], [], 0
        for i, j in search(build(fp, np.cumsum(new), tag), k):
            x = fp[i] ^ fp[j]
            first = np.argmax((x[:, None] & m64[None, :]) == 0, axis=1)  # a pair counts in the first table that has it
            ok = (first == t[i]) & ((c1[i] == c2[i]) | (c[i] != c[j]))
            if tagged:
                ok &= tag[i] != tag[j]
            us.append(np.minimum(ids[i], ids[j])[ok])
            vs.append(np.maximum(ids[i], ids[j])[ok])
            if own:
                ds.append(np.bitwise_count(x[ok]))
            held += int(ok.sum())
            if held > 1 << 18:
                if own:
                    us, vs, ds = nearest(us, vs, ds)
                else:
                    yield from flush(us, vs)
                    us, vs, ds = [], [], []
                held = 0
        yield from flush(*(nearest(us, vs, ds)[:2] if own and us else (us, vs)))

    def nearest(*cols):
        u, v, d = map(np.concatenate, cols)
        at = np.argsort(d, kind="stable")
        at = at[tree(u[at], v[at])]
        return [u[at]], [v[at]], [d[at]]

    def flush(us, vs):
        u, v = (np.concatenate(us), np.concatenate(vs)) if us else ([], [])
        if len(u):
            if spanning:
                u, v = forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            rows += b.num_rows
            if rows < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            t, key, c1, c2 = cols[:4]
            last = (t == t[-1]) & (key == key[-1]) & (c1 == c1[-1]) & (c2 == c2[-1])
            at = int(np.argmax(last))  # the last bucket may go on in the next batch
            if at:
                yield from emit(dict(zip(names, (x[:at] for x in cols))))
            held, rows = [[x[at:] for x in cols]], len(t) - at
        if rows:
            yield from emit(dict(zip(names, (np.concatenate(x) for x in zip(*held)))))

    return _bucketed(fps, masks).mapInArrow(common.frugal(run), "u bigint, v bigint")


# -- operators
def near_groups(docs: DataFrame, words: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (bigint), component_id for every row: fingerprints within k bits are linked, components are transitive.

    component_id is the least id reachable, the row's own included; null ids are passed over (null if there is no other).
    Null and blank texts have fingerprint 0 and link like any other. Equal fingerprints are one node, so copies
    cost one row each and a group of copies is never expanded into pairs. Empty table: no rows.
    """
    common.ship(docs.sparkSession)
    rows = common.cut(fingerprints(docs, words, id_col, text_col).withColumnRenamed("fp0", "fp"), "fps")
    nodes = common.cut(rows.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    comp = components(links(nodes.select("fp"), k, spanning=True))
    label = _labels(nodes, comp)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = [r["fp"] for r in nodes.filter((F.col("n") > total / 1000) & (F.col("n") > 20_000)).select("fp").collect()]  # under 1000
    out = common.salted_join(rows, label, "fp", hot, "inner")
    return out.select(F.col("__id").alias(id_col), "fp", "component_id")


def _labels(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """fp, component_id: the least id over each component of fingerprints."""
    member = comp.select(F.col("node").alias("fp"), "root").unionByName(comp.select(F.col("root").alias("fp"), "root").distinct())
    low = member.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("c"))
    linked = member.join(low, "root").select("fp", "c")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("c", "least").alias("component_id"))


# -- removal of near-duplicates
def _mark(t: bytes | None) -> str:
    """Key of the exact word sequence."""
    return xxhash.xxh3_128_hexdigest(b" ".join(t.lower().split()) if t else b"")


def _number(key: str) -> int:
    return int(key[:16], 16) - (1 << 63)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a number that names the row on every reading: from its place in its file, else from a written copy."""
    place = ("_metadata.file_path", "_metadata.row_index")
    try:
        return docs.select("*", F.xxhash64(*place).alias("__row"))
    except Exception as e:  # no file source
        if "_metadata" not in str(e):
            raise
        return common.cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


SIEVE_BITS = 20, 25  # least and most; the bitmap has 8 bits or more per key up to the most, 4 MB


def sieve(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with __maybe: false where __row is surely not among keys(__row). A bitmap of at most 2^25 bits is broadcast."""
    bits = min(max((8 * keys.count()).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])
    place = F.pmod(F.xxhash64("__row", F.lit(77)), F.lit(1 << bits))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("__bits"))
    words = common.cut(words, "sieve")  # at most 2^(25 - 6) rows of 16 bytes
    out = rows.withColumn("__p", place).withColumn("__word", F.shiftright("__p", 6)).join(F.broadcast(words), "__word", "left")
    return out.withColumn("__maybe", F.coalesce(F.expr("(shiftright(__bits, cast(__p & 63 as int)) & 1) = 1"), F.lit(False))).drop("__p", "__word", "__bits")


def _sets(rows: DataFrame, words: int, text_col: str) -> DataFrame:
    """node, s: the distinct shingle hashes of rows that a candidate pair may need."""

    def run(batches):
        for b in batches:
            got = []
            for t in b.column("__text").to_pylist():
                blocks = list(shingle_hashes(t, words))
                got.append(np.unique(np.concatenate(blocks)).view(np.int64) if blocks else np.zeros(0, dtype=np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            flat = np.concatenate(got) if got else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "s"])

    return rows.select("__row", F.col(text_col).cast("binary").alias("__text")).mapInArrow(common.frugal(run), "node long, s array<long>")


SAMPLE, HOT_IN, MOST_HOT = 4_000, 4, 100_000  # texts looked at for frequent shingles, texts one must stand in, shingles kept
HELD = 200_000  # rows of a group table taken at once
PREFIX = "token long, mark long, n int, pos int"
PARITY = 512  # bits of the shortest parity bitmap


def frequent(rows: DataFrame, total: int, words: int, text_col: str) -> np.ndarray:
    """Shingle hashes that stand in many of about SAMPLE texts, the rarer first; at most MOST_HOT."""
    some = rows.filter(F.pmod(F.xxhash64("__row", F.lit(31)), F.lit(max(1, total // SAMPLE))) == 0)
    n = _sets(some, words, text_col).select(F.explode("s").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_IN)
    top = n.orderBy(F.desc("n"), "token").limit(MOST_HOT).collect()  # bounded
    return np.array([r["token"] for r in reversed(top)], dtype=np.int64).view(np.uint64)


def parity(h: np.ndarray) -> bytes:
    """Bitmap of a set: a bit is 1 if an odd number of members fall on it. About as many bits as members, a power of two."""
    m = max(PARITY, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap of the same set over fewer bits, size bytes."""
    x = np.frombuffer(bits, dtype=np.uint8)
    return bits if len(x) <= size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least so many members stand in one of two sets alone: each of them changes one bit."""
    n = min(len(a), len(b))
    return (int.from_bytes(folded(a, n), "little") ^ int.from_bytes(folded(b, n), "little")).bit_count()


def most_apart(n1, n2, similarity: float):
    """Members that may stand in one of two sets of n1 and n2 alone at that Jaccard similarity."""
    return (n1 + n2) * ((1 - similarity) / (1 + similarity)) + 1e-6


def sketches(rows: DataFrame, hot: np.ndarray, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Of each text one row __row, id, key, mark, n, bits, fp (its SimHash fingerprint), then its prefix in rows of PREFIX.

    The prefix are the first n - ceil(similarity n) + 1 of its n shingles, and their places, in one order for all texts.
    Two sets of that similarity share at least ceil(similarity n) shingles of either, so the first one they share is among
    these in both. Any order will do; by hash, with frequent shingles last, few texts share a shingle. Of copies read by one
    task the first alone gives bits, fp and prefix.
    """
    by_hash = np.argsort(hot)
    shared = rows.sparkSession.sparkContext.broadcast((hot[by_hash], by_hash + 1))
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["__row", "id", "key", "mark", "n", "bits", "fp", "token", "pos"]

    def run(batches):
        known, rank = shared.value
        met: set[str] = set()
        for b in batches:
            ids = b.column("id").type
            key, size, bits, fp, token, mark, long, pos = [], [], [], [], [], [], [], []
            for t in b.column("__text").to_pylist():
                k = _mark(t)
                key.append(k)
                blocks = [] if k in met else list(shingle_hashes(t, words))
                met.add(k)
                if not blocks:
                    size.append(0), bits.append(None), fp.append(None)
                    continue
                fp.append(signed(fold(blocks)))
                h = np.unique(np.concatenate(blocks))
                n = len(h)
                size.append(n), bits.append(parity(h))
                m = n - int(np.ceil(similarity * n - 1e-9)) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    late = np.where(known[at] == h, rank[at], 0)
                    if late.any():
                        h = h[np.lexsort((h, late))]
                token.append(h[:m].view(np.int64))
                mark.append(_number(k)), long.append(n), pos.append(m)
            rest = [pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int32())]
            cols = [b.column("__row"), b.column("id"), pa.array(key, pa.string()), pa.array(list(map(_number, key)), pa.int64()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *rest], names=names)
            if token:
                cols = [np.repeat(np.array(mark, dtype=np.int64), pos), np.repeat(np.array(long, dtype=np.int32), pos), np.concatenate(token), np.concatenate([np.arange(m, dtype=np.int32) for m in pos])]
                for at in range(0, len(cols[0]), HELD):
                    mk, n, tk, ps = (pa.array(c[at : at + HELD]) for c in cols)
                    none = [pa.nulls(len(mk), x) for x in (pa.int64(), ids, pa.string(), pa.binary(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*none[:3], mk, n, *none[3:], tk, ps], names=names)

    src = rows.select("__row", F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("__text"))
    return src.mapInArrow(common.frugal(run), f"__row long, id {kind}, key string, mark long, n int, bits binary, fp long, token long, pos int")


def _groups(batches, keys: tuple[str, ...], names: tuple[str, ...]):
    """Columns of whole runs of equal keys, about HELD rows at a time, from sorted batches."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows += b.num_rows
        if rows < HELD:
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        last = np.logical_and.reduce([cols[names.index(k)] == cols[names.index(k)][-1] for k in keys])
        at = int(np.argmax(last))  # the last run may go on in the next batch
        if at:
            yield dict(zip(names, (x[:at] for x in cols)))
        held, rows = [[x[at:] for x in cols]], len(last) - at
    if rows:
        yield dict(zip(names, (np.concatenate(x) for x in zip(*held))))


def _possible(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts whose first common shingle stands at these places can still be similar enough."""
    n1, n2 = c["n"][i].astype(np.int64), c["n"][j].astype(np.int64)
    rest = np.minimum(n1 - c["pos"][i], n2 - c["pos"][j])
    return (np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-6) & (rest >= similarity / (1 + similarity) * (n1 + n2) - 1e-6)


def sharing(entries: DataFrame, similarity: float) -> DataFrame:
    """The entries, once per mark, of tokens that several marks have; prev: the mark before it by size, if the two can be similar."""
    laid = entries.repartition(common.parts(entries.sparkSession), "token").sortWithinPartitions("token", "n", "mark")

    def run(batches):
        names = ("token", "mark", "n", "pos")
        for c in _groups(batches, ("token",), names):
            once = np.ones(len(c["token"]), dtype=bool)
            once[1:] = (c["token"][1:] != c["token"][:-1]) | (c["mark"][1:] != c["mark"][:-1])
            c = {k: x[once] for k, x in c.items()}
            same = c["token"][1:] == c["token"][:-1]
            many = np.append(same, False) | np.insert(same, 0, False)
            j = np.flatnonzero(same) + 1
            has = np.zeros(len(many), dtype=bool)
            has[j[_possible(c, j - 1, j, similarity)]] = True
            prev = pa.array(np.roll(c["mark"], 1)[many], mask=~has[many])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k][many]) for k in names), prev], names=[*names, "prev"])

    return laid.mapInArrow(common.frugal(run), PREFIX + ", prev long")


def across(entries: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v: pairs of nodes of different tag that share a token and can be similar enough, u < v, each at least once.

    nodes: node, bits. Pairs whose parity bitmaps differ too much are never emitted, so a group of texts that are alike but
    less than similar costs comparisons, not rows. A token of over HOT_BUCKET nodes is split in chunks, met two by two.
    """

    def short(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([folded(x, PARITY // 8) for x in b.column("bits").to_pylist()], pa.binary())], names=["node", "bits"])

    big = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("tag").alias("t1"), F.max("tag").alias("t2")).filter("t1 != t2")
    row = entries.join(big.select("token", F.ceil(F.col("k") / HOT_BUCKET).cast("int").alias("m")), "token")
    row = row.join(nodes.select("node", "bits").filter("bits is not null").mapInArrow(common.frugal(short), "node long, bits binary"), "node")
    row = row.withColumn("c", F.pmod(F.xxhash64("node", F.lit(8)), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    row = row.select("token", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "c", "node", "n", "pos", "tag", "bits")
    laid = row.repartition(common.parts(entries.sparkSession), "token", "c1", "c2").sortWithinPartitions("token", "c1", "c2", "n")

    def run(batches):
        for c in _groups(batches, ("token", "c1", "c2"), ("token", "c1", "c2", "c", "node", "n", "pos", "tag", "bits")):
            bits = np.frombuffer(b"".join(c.pop("bits")), dtype=np.uint64).reshape(-1, PARITY // 64)
            new = np.ones(len(c["token"]), dtype=bool)
            new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("token", "c1", "c2")])
            end = np.repeat(np.append(np.flatnonzero(new)[1:], len(new)), np.diff(np.append(np.flatnonzero(new), len(new))))
            most = np.empty(len(new), dtype=np.int64)  # where the sizes of a run become too large
            for s, e in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new))):
                most[s:e] = s + np.searchsorted(c["n"][s:e], c["n"][s:e] / similarity + 1e-6, "right")
            width = np.minimum(most, end) - np.arange(len(new)) - 1
            total = np.cumsum(width)
            at = 0
            while at < len(width):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE * 2, "right")))
                w = width[at:to]
                i = np.repeat(np.arange(at, to), w)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
                ok = (c["tag"][i] != c["tag"][j]) & ((c["c1"][i] == c["c2"][i]) | (c["c"][i] != c["c"][j]))
                i, j = i[ok], j[ok]
                ok = _possible(c, i, j, similarity)
                i, j = i[ok], j[ok]
                ok = np.zeros(len(i), dtype=bool)
                for s in range(0, len(i), SLICE):
                    x, y = i[s : s + SLICE], j[s : s + SLICE]
                    ok[s : s + SLICE] = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most_apart(c["n"][x].astype(np.int64), c["n"][y], similarity)
                u, v = c["node"][i[ok]], c["node"][j[ok]]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])
                at = to

    return laid.mapInArrow(common.frugal(run), "u long, v long").distinct()


def alike(nodes: DataFrame, k: int) -> DataFrame:
    """u, v: pairs of nodes (node, fp) from the Gray-order index that connect all whose fingerprints lie within k bits, u < v.

    Nodes of one fingerprint are each paired with the least of them, which stands for the fingerprint in the index.
    """
    some = nodes.filter("fp is not null").select("node", "fp")
    lead = common.cut(some.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = some.join(lead, "fp").filter("node != lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    out = common.cut(same.unionByName(links(lead.select("fp", F.col("lead").alias("id")), k, own=True)), "alike")
    common.drop(lead)
    return out


FAMILY = 128  # nodes of a candidate family in one block


def near_bits(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes (node, size, bits) whose sizes and parity bitmaps allow that similarity: none that has it is lost."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "bu", "bv")

    def run(batches):
        for b in batches:
            n1, n2 = b.column("nu").to_numpy().astype(np.int64), b.column("nv").to_numpy().astype(np.int64)
            ok = (np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-6) & (n1 > 0) & (n2 > 0)
            most = most_apart(n1, n2, similarity)
            x, y = b.column("bu"), b.column("bv")
            for k in np.flatnonzero(ok):
                ok[k] = apart(x[k].as_py(), y[k].as_py()) <= most[k]
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return both.mapInArrow(common.frugal(run), "u long, v long")


def verified(rows: DataFrame, pairs: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs (u, v) of rows whose sets of word shingles have at least that Jaccard similarity.

    Candidates that hang together form a family. A family is cut in blocks; a text's set goes once to each pair of blocks
    that has a pair to check with it, so sets are not moved once per pair.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("__row")).distinct()
    need = sieve(rows, ends).filter("__maybe")  # only texts that stand in a pair are hashed and moved
    comp = components(pairs)
    member = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "fam")
    size = member.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("m"))
    member = member.join(size, "fam").select("node", "fam", F.pmod(F.xxhash64("node", F.lit(6)), F.col("m")).cast("int").alias("b"))
    side = lambda c: member.select(F.col("node").alias(c), "fam", F.col("b").alias(f"b{c}"))
    placed = pairs.join(side("u"), "u").join(side("v").drop("fam"), "v").select("fam", F.least("bu", "bv").alias("b1"), F.greatest("bu", "bv").alias("b2"), "u", "v")
    placed = common.cut(placed, "placed")
    wanted = placed.select("fam", "b1", "b2", F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = _sets(need, words, text_col).join(wanted, "node").select("fam", "b1", "b2", F.lit(0).alias("kind"), F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), "s")
    both = sets.unionByName(placed.select("fam", "b1", "b2", F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("array<long>").alias("s")))
    laid = both.repartition(common.parts(rows.sparkSession), "fam", "b1", "b2").sortWithinPartitions("fam", "b1", "b2", "kind")

    def run(batches):
        for _, held in common.by_key(batches, ("fam", "b1", "b2")):
            own: dict[int, np.ndarray] = {}
            us, vs = [], []
            for b in held:  # the sets come before the pairs
                s = b.column("s")
                for i, (k, u, v) in enumerate(zip(b.column("kind").to_pylist(), b.column("u").to_pylist(), b.column("v").to_pylist())):
                    if k == 0:
                        own[u] = s[i].values.to_numpy()
                        continue
                    x, y = own[u], own[v]
                    n = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else 0
                    if n >= similarity * (len(x) + len(y) - n) - 1e-9:
                        us.append(u), vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return laid.mapInArrow(common.frugal(run), "u long, v long")


def dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the least id (rows without an id last).

    Rows are linked when their sets of `words`-word shingles have at least that Jaccard similarity; groups are transitive.
    First the SimHash fingerprints of the same shingles are searched in the Gray-order hierarchical index (links()), and what it
    finds within k bits is verified exactly. Fingerprints of similar sets may lie further apart, so the rest is taken from a
    prefix filter over the shingles themselves (sketches()), between the groups found so far: none is missed, whatever the edit.
    Pairs whose parity bitmaps differ in more bits than the similarity allows fall away, which loses none, and each other one is
    verified exactly. Of the rest, neighbours by size under each shared shingle are verified before all other pairs across
    groups, so a dense group is not expanded into all of its pairs.
    Texts without a word are copies of each other. Repeated rows count as copies. All columns are kept.
    """
    common.ship(docs.sparkSession)
    rows = numbered(docs)
    hot_shingles = frequent(rows, rows.count(), words, text_col)
    made = common.cut(sketches(rows, hot_shingles, words, similarity, id_col, text_col), "sketch")
    flat = made.filter("key is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__row"))
    nodes = flat.groupBy("key").agg(first.alias("rep"), F.count(F.lit(1)).alias("n"), F.first("mark").alias("mark"), F.max(F.struct("n", "bits", "fp")).alias("set"))
    nodes = common.cut(nodes.select("key", "rep", "n", "mark", F.col("set.n").alias("size"), "set.bits", "set.fp", F.col("rep.__row").alias("node")), "sketch-nodes")

    def tagged(found: DataFrame) -> DataFrame:
        return nodes.select("node", "mark").join(components(found), "node", "left").select("node", "mark", F.coalesce("root", "node").alias("tag"))

    index = alike(nodes, k)
    found = common.cut(verified(rows, near_bits(index, nodes, similarity), words, similarity, text_col), "verified")
    tags = common.cut(tagged(found), "tags")
    entries = common.cut(sharing(made.filter("token is not null").select("token", "mark", "n", "pos"), similarity), "sharing")
    named = lambda c: tags.select(F.col("mark").alias(f"m{c}"), F.col("node").alias(c), F.col("tag").alias(f"t{c}"))
    near = entries.filter("prev is not null").select(F.col("prev").alias("mu"), F.col("mark").alias("mv")).distinct()
    near = near.join(named("u"), "mu").join(named("v"), "mv").filter("tu != tv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    near = common.cut(near_bits(near.distinct().join(index, ["u", "v"], "left_anti"), nodes, similarity), "pairs")
    found = found.unionByName(common.cut(verified(rows, near, words, similarity, text_col), "verified"))
    rest = across(entries.join(tagged(found), "mark").select("token", "node", "n", "pos", "tag"), nodes, similarity)
    rest = common.cut(near_bits(rest.join(near.unionByName(index), ["u", "v"], "left_anti"), nodes, similarity), "pairs")
    common.drop(entries)
    found = found.unionByName(common.cut(verified(rows, rest, words, similarity, text_col), "verified"))
    group = nodes.join(tagged(found).drop("mark"), "node").select("key", "rep", "tag", "n")
    best = group.groupBy("tag").agg(F.min("rep").alias("best"))
    keep = common.cut(group.join(best, "tag").select("key", F.col("best.__row").alias("keep"), "n"), "keep")
    total = keep.agg(F.sum("n")).first()[0] or 0
    hot = [r["key"] for r in keep.filter((F.col("n") > total / 1000) & (F.col("n") > 20_000)).select("key").collect()]  # under 1000
    gone = common.salted_join(flat.select("key", "__row"), keep.select("key", "keep"), "key", hot, "inner").filter(F.col("__row") != F.col("keep"))
    gone = common.cut(gone.select("__row"), "gone")
    for done in (made, nodes, index, tags, near, rest, keep):
        common.drop(done)
    marked = sieve(rows, gone)
    doubtful = marked.filter("__maybe").join(gone, "__row", "left_anti")
    return marked.filter("not __maybe").select(*docs.columns).unionByName(doubtful.select(*docs.columns))
