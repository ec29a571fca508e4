"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. Neighbour lists start from the leaves of random hyperplane trees. A round joins every node's
neighbours with each other (neighbours of neighbours) and keeps each node's best; a list that is full of threshold links is
saturated and may be twice as long in the next round. Links over the threshold join nodes to components; linked nodes
always share one, so the links of every node are then counted exactly, in blocks, within its component: lists that were
still saturated lose nothing. Deeper trees part more pairs, so there are more of them. Rounds go on until the lists hardly change.
Then a sample of nodes, enlarged until it has links enough, is held against all others by brute force; while too few of its
links lie within components, another round follows, from fresh trees. If the audit still fails after the last round, all
pairs of a label are compared in blocks instead, which is exact.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import common
from cairn.llm.components import components, forest

K = 12
TREES, MISS = 4, 0.005  # trees at least, and the chance that a pair at the threshold shares no leaf
LEAF = 512  # nodes per leaf, aimed at
CHUNK = 1024  # nodes compared at once
BLOCK = 4096  # nodes of a component sent together
FLOOR = 0.5  # pairs under it are no news to a list
ROUNDS, MAX_ROUNDS = 2, 6
CHANGED = 0.001  # share of new list entries under which the lists are at rest
AUDIT, TARGET = 512, 0.98  # nodes held against all others, and the share of their links to be found
AUDIT_LINKS, MOST_AUDIT = 200, 32_768  # links that an audit needs, and nodes at most


def nodes_of(rows: DataFrame, vec: str, label: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with their node, nodes). A row whose vector or label can't link has a null node.

    The node number is a 64-bit hash of label and components.
    """
    v = F.col(vec)
    sane = v.isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ok = F.when(sane, norm2 > 0).otherwise(False)
    out = rows.select(
        F.col(id_col).alias("id"), F.col(label).alias("label"), F.size(v).alias("dim"), F.when(ok, v.cast("array<double>")).alias("vec"),
    ).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    nodes = (
        out.filter("node is not null").groupBy("node")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"), F.first("label").alias("label"), F.first("dim").alias("dim"))
        .withColumn("grp", F.xxhash64("label", "dim")).drop("label")
    )
    return out.select("id", "node"), nodes


def _unit(col: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    x = col.values.to_numpy(zero_copy_only=False)[col.offsets[0].as_py() : col.offsets[-1].as_py()].reshape(n, -1)
    # scaled first: squares of very small or large components neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


EDGE = "u long, v long, sim double"


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "sim"])


def _best(ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray):
    """Each row's k most similar others at or over its floor."""
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-s, axis=1)[:, :k]
    got = np.take_along_axis(s, top, axis=1)
    ok = got >= floor[:, None]
    r, c = np.nonzero(ok)
    return ids[r], ids[top[r, c]], got[r, c]


def trees(depth: int, threshold: float) -> int:
    """Trees in which a pair at the threshold shares some leaf but for a chance of MISS; a plane parts it with chance angle / pi."""
    if depth < 1 or threshold >= 1:
        return TREES
    together = (1 - math.acos(max(threshold, -1.0)) / math.pi) ** depth
    return max(TREES, math.ceil(math.log(MISS) / math.log1p(-together)))


def leaves(nodes: DataFrame, seed: int, threshold: float, k: int = K) -> DataFrame:
    """First lists: the k best within each leaf of random hyperplane trees per group, leaves read in chunks."""
    size = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int"))
    src = nodes.join(size.select("grp", "depth"), "grp").select("grp", "node", "vec", "dim", "depth")

    def sign(batches):
        for b in batches:
            dims, depth = b.column("dim").to_numpy(), b.column("depth").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = _unit(part.column("vec"), part.num_rows)
                deep = depth[dims == d]
                wanted = np.array([trees(int(x), threshold) for x in range(int(deep.max()) + 1)])[deep]
                for t in range(int(wanted.max())):
                    planes = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), 30))
                    bits = (x @ planes) > 0
                    leaf = (bits * (1 << np.arange(30)) * (np.arange(30)[None, :] < deep[:, None])).sum(axis=1)
                    cols = [pa.array(np.full(part.num_rows, t), pa.int32()), part.column("grp"), pa.array(leaf, pa.int64()), part.column("node"), part.column("vec")]
                    yield pa.RecordBatch.from_arrays(cols, names=["t", "grp", "leaf", "node", "vec"]).filter(pa.array(t < wanted))

    def best(batches):
        for _, held in common.by_key(batches, ("t", "grp", "leaf"), 4 * CHUNK):
            part = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, part.num_rows, CHUNK):
                b = part.slice(at, CHUNK).combine_chunks().to_batches()[0]
                if b.num_rows > 1:
                    x = _unit(b.column("vec"), b.num_rows)
                    yield _edges(*_best(b.column("node").to_numpy(), x, k, np.full(len(x), FLOOR)))

    signed = src.mapInArrow(sign, "t int, grp long, leaf long, node long, vec array<double>")
    # a cone that planes don't split is one large leaf: its chunks are drawn anew in each tree
    laid = signed.repartition(common.parts(nodes.sparkSession), "t", "grp", "leaf").sortWithinPartitions("t", "grp", "leaf", F.xxhash64("node", "t", F.lit(seed)))
    return laid.mapInArrow(best, EDGE)


def trim(edges: DataFrame, threshold: float, k: int, most: int) -> DataFrame:
    """Both directions of every edge once, each node's k best, or up to `most` while they pass the threshold."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    once = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    first = once.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= most)  # a hub's reverse list is cut before it is moved
    return first.filter((F.col("r") <= k) | (F.col("sim") >= threshold)).select("u", "v", "sim")


def improve(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One neighbours-of-neighbours join: for every node, pairs among its neighbours that beat a list's last entry."""
    last = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).select(F.col("u").alias("v"), F.when(F.col("n") >= k, F.col("low")).otherwise(FLOOR).alias("low"))
    # lists are bounded, but a node may stand in many of them: adaptive skew joins split its rows
    sent = edges.select("u", "v").join(last, "v").join(nodes.select(F.col("node").alias("v"), "vec"), "v")
    laid = sent.select("u", "v", "low", "vec").repartition(common.parts(nodes.sparkSession), "u").sortWithinPartitions("u")

    def join(batches):
        us, vs, ss, n = [], [], [], 0
        for _, held in common.by_key(batches, ("u",)):
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if b.num_rows < 2:
                continue
            u, v, s = _best(b.column("v").to_numpy(), _unit(b.column("vec"), b.num_rows), k, np.maximum(b.column("low").to_numpy(), FLOOR))
            us.append(u), vs.append(v), ss.append(s)
            n += len(u)
            if n > 1 << 17:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))
                us, vs, ss, n = [], [], [], 0
        if n:
            yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    return laid.mapInArrow(join, EDGE)


def audit(nodes: DataFrame, comp: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[int, int]:
    """(those whose ends share a component, all) of the true links of at most `sample` nodes (lowest hashes)."""
    spark = nodes.sparkSession
    rows = nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(sample).select("node", "grp", "dim", "vec").collect()  # bounded
    if not rows:
        return 0, 0
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in rows}:
        own = [r for r in rows if r["grp"] == g]
        x = np.array([r["vec"] for r in own])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        by[g] = (np.array([r["node"] for r in own]), x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    shared = spark.sparkContext.broadcast(by)

    def against(batches):
        for b in batches:
            grp = b.column("grp").to_numpy()
            for g in np.unique(grp):
                if g not in shared.value:
                    continue
                q, y = shared.value[g]
                whole = b.filter(pa.array(grp == g))
                step = max(1, (1 << 22) // len(q))
                for at in range(0, whole.num_rows, step):
                    part = whole.slice(at, step)
                    s = _unit(part.column("vec"), part.num_rows) @ y.T
                    r, c = np.nonzero(s >= threshold)
                    v = part.column("node").to_numpy()[r]
                    other = v != q[c]
                    yield _edges(q[c][other], v[other], s[r, c][other])

    true = nodes.select("node", "grp", "vec").mapInArrow(against, EDGE)
    root = lambda a: comp.select(F.col("node").alias(a), F.col("root").alias(f"{a}_root"))
    got = true.join(root("u"), "u", "left").join(root("v"), "v", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u_root") == F.col("v_root")).alias("k")).first()
    return got["k"], got["n"]


def audited(nodes: DataFrame, comp: DataFrame, threshold: float, total: int) -> tuple[bool, str]:
    """Whether TARGET is met by AUDIT_LINKS links or by all nodes, and the figures. Too few links in MOST_AUDIT nodes are no pass."""
    sample = AUDIT
    while True:
        found, links = audit(nodes, comp, threshold, sample)
        if links >= AUDIT_LINKS or sample >= min(total, MOST_AUDIT):
            break
        sample = min(sample * 8, MOST_AUDIT)
    enough = links >= AUDIT_LINKS or sample >= total
    return enough and found >= TARGET * links, f"{found} of {links} links of {min(sample, total)} among {total} nodes found"


def _blocked(member: DataFrame) -> DataFrame:
    """member (comp, node, w, vec) laid out by comp, b1, b2: a component over BLOCK nodes is cut in blocks that meet two by two."""
    n = member.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    row = member.join(n.select("comp", "blocks"), "comp").withColumn("b", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    row = row.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = row.select("comp", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "node", "w", "vec")
    return row.repartition(common.parts(member.sparkSession), "comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2", "b")


def _near(batches, threshold: float):
    """(nodes, weights, i, j) of the pairs i < j within the threshold, CHUNK rows of a pair of blocks at a time."""
    for (_, b1, b2), held in common.by_key(batches, ("comp", "b1", "b2")):
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x, w, node = _unit(b.column("vec"), b.num_rows), b.column("w").to_numpy(), b.column("node").to_numpy()
        cut = 0 if b1 == b2 else int((b.column("b").to_numpy() == b1).sum())  # rows of the first block come first
        for at in range(0, cut or len(node), CHUNK):
            rows = x[at : min(at + CHUNK, cut or len(node))]
            i, j = np.nonzero(rows @ x[cut:].T >= threshold)
            i, j = i + at, j + cut
            ok = i < j
            yield node, w, i[ok], j[ok]


def count_links(member: DataFrame, threshold: float) -> DataFrame:
    """node, linked: the summed weights of the other nodes of its component that lie within the threshold, exactly.

    member: comp, node, w, vec. Only one count per node and step comes out, never the pairs. A vector of a component of m
    nodes is sent m / BLOCK times.
    """

    def count(batches):
        for node, w, i, j in _near(batches, threshold):
            got = np.bincount(i, w[j], len(node)) + np.bincount(j, w[i], len(node))
            some = np.flatnonzero(got)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(got[some].astype(np.int64))], names=["node", "linked"])

    return _blocked(member).mapInArrow(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def exact_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """u, v: links that connect exactly what all links within the threshold connect, from all pairs of a group in blocks."""

    def link(batches):
        for node, _, i, j in _near(batches, threshold):
            if len(i):
                u, v = forest(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return _blocked(nodes.select(F.col("grp").alias("comp"), "node", "w", "vec")).mapInArrow(link, "u long, v long")


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for every row: cosine at or over the threshold between rows of equal label.

    Null labels, null or zero vectors and vectors with null or non-finite components link with nothing: they are their own
    component and kept. Vectors of different lengths never link. Equal vectors link with each other. component_id is
    the least id reachable; null ids are passed over. Repeated ids each get a row. Empty table: no rows.
    """
    common.ship(rows.sparkSession)
    all_rows, found = nodes_of(rows, vec, label, id_col)
    all_rows = common.cut(all_rows, "vec-rows")
    nodes = common.cut(found, "vec-nodes")
    n_nodes = nodes.count()
    edges = common.cut(trim(leaves(nodes, 0, threshold), threshold, K, 2 * K), "lists")
    most, asked = 2 * K, False
    for r in range(1, MAX_ROUNDS + 1):
        new = improve(edges, nodes, K)
        if asked:  # the audit asked for more: fresh trees too
            new = new.unionByName(leaves(nodes, r, threshold))
        most *= 2
        nxt = common.cut(trim(edges.unionByName(new), threshold, K, most), "lists")
        moving = nxt.join(edges, ["u", "v"], "left_anti").count() > CHANGED * nxt.count()
        common.drop(edges)
        edges = nxt
        if r < MAX_ROUNDS and (r < ROUNDS or (moving and not asked)):
            continue
        comp = components(edges.filter(F.col("sim") >= threshold))
        comp = common.cut(comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct()), "vec-comp")
        passed, figures = audited(nodes, comp, threshold, n_nodes)
        if passed:
            logging.getLogger(__name__).info("audit after %s rounds: %s", r, figures)
            break
        asked = True
    else:
        logging.getLogger(__name__).warning("after %s rounds the audit is not passed (%s): all pairs are compared", MAX_ROUNDS, figures)
        comp = components(exact_links(nodes, threshold))
        comp = common.cut(comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct()), "vec-comp")
    member = nodes.join(comp.withColumnRenamed("root", "comp"), "node").select("comp", "node", "w", "vec", "least")
    low = member.groupBy("comp").agg(F.min("least").alias("low"))
    known = member.select("node", "comp").join(low, "comp").join(count_links(member.drop("least"), threshold), "node").select("node", "low", "linked")
    label_ = nodes.select("node", "least", "w").join(known, "node", "left").select(
        "node", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id")
    )
    total = nodes.agg(F.sum("w")).first()[0] or 0
    hot = [r["node"] for r in nodes.filter((F.col("w") > total / 1000) & (F.col("w") > 20_000)).select("node").collect()]  # under 1000
    alone = all_rows.filter("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = common.salted_join(all_rows.filter("node is not null"), label_, "node", hot, "inner").select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
