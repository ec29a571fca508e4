"""Beliefs, identity, hierarchy, taxonomy, lifecycle and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C

TIERS = ("primary", "secondary", "inferred")


# -- beliefs
def authority(tiers: tuple[str, ...] = TIERS, col: str = "authority_level") -> F.Column:
    """Position in the policy's list from high to low; unlisted ones come last."""
    if not tiers or len(set(tiers)) != len(tiers):
        raise ValueError("the policy must list tiers, each once")
    out = F.lit(len(tiers))
    for i, t in enumerate(tiers):
        out = F.when(F.col(col) == t, i).otherwise(out)
    return out


def reconcile(assertions: DataFrame, at: int, tiers: tuple[str, ...] = TIERS) -> tuple[DataFrame, DataFrame]:
    """(beliefs, contradictions): per subject and predicate the live assertions of the best tier present.

    One object: a belief by the survivor (confidence desc, null as 0, asserted desc, id). More: one contradiction. One
    aggregation with map-side combining does both; no window holds a hot subject.
    """
    live = assertions.filter(C.live_at(F.col("from_s"), F.col("until_s"), F.lit(at))).withColumn("tier", authority(tiers))
    pick = F.struct(-F.coalesce("confidence", F.lit(0.0)), -F.col("asserted_s"), "id")
    by = live.groupBy("subject_key", "predicate", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.min("object").alias("lo"), F.max("object").alias("hi"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("most"),
        F.min_by(F.struct("id", "object", "confidence", "from_s", "until_s"), pick).alias("win"), F.count_distinct("object").alias("objects"),
    )
    best = by.groupBy("subject_key", "predicate").agg(F.min_by(F.struct("n", "lo", "hi", "most", "win", "objects"), "tier").alias("b"))
    key = C.record_key(F.col("subject_key"), F.col("predicate"))
    beliefs = best.filter("b.objects = 1").select(
        F.concat(F.lit("belief:"), key).alias("id"), "subject_key", F.concat("predicate", F.lit(' "'), "b.win.object", F.lit('"')).alias("content"),
        F.coalesce("b.win.confidence", F.lit(1.0)).alias("confidence"), F.col("b.win.id").alias("source_id"), F.col("b.n").alias("live_count"), F.col("b.win.from_s").alias("from_s"), F.col("b.win.until_s").alias("until_s"), F.lit("active").alias("status"),
    )
    contra = best.filter("b.objects > 1").select(
        F.concat(F.lit("contradiction:"), key).alias("id"), "subject_key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.most"))).alias("severity"),
        F.concat(F.col("b.objects").cast("string"), F.lit(" distinct claims")).alias("note"), F.col("b.n").alias("targets"),
    )
    return beliefs, contra


def detect(beliefs: DataFrame) -> DataFrame:
    """Subjects of two or more active beliefs that differ in content."""
    g = beliefs.filter("status = 'active'").groupBy("subject_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("c"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("severity"))
    return g.filter("n >= 2 and c >= 2").select(F.concat(F.lit("contradiction-"), F.substring(F.sha2("subject_key", 256), 1, 16)).alias("id"), "subject_key", "severity", "n")


def supersede(beliefs: DataFrame, ids: F.Column, at: int, status: str = "superseded") -> DataFrame:
    """Close the chosen beliefs at a time; supersede and retract differ in the status alone."""
    return beliefs.withColumn("until_s", F.when(ids, F.lit(at)).otherwise(F.col("until_s"))).withColumn("status", F.when(ids, status).otherwise(F.col("status")))


def latest(beliefs: DataFrame, keys: list[str]) -> DataFrame:
    """The latest valid belief of each key: from desc (nulls last), id desc."""
    return beliefs.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in beliefs.columns if c not in keys]), F.struct("from_s", "id")).alias("b")).select(*keys, "b.*")


def pair_key(a: F.Column, b: F.Column) -> F.Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


RESOLUTION = {"ignore": "ignored", "needs_more": "open"}


def resolution_status(col: str) -> F.Column:
    return F.when(F.col(col) == "ignore", "ignored").when(F.col(col) == "needs_more", "open").otherwise("resolved")


# -- identity
def collisions(entities: DataFrame, key: F.Column) -> DataFrame:
    """identity_key, ids, n of keys that several entities have."""
    k = entities.select("id", key.alias("identity_key")).filter("identity_key is not null")
    g = k.groupBy("identity_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("canonical"))
    return g.filter("n > 1")


def merge_map(entities: DataFrame, key: F.Column) -> DataFrame:
    """id, canonical for every duplicate that is not its key's canonical entity (the least id)."""
    k = entities.select("id", key.alias("k"))
    g = k.groupBy("k").agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return k.join(g, "k").filter("id != canonical").select("id", "canonical")


def redirect(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with both ends led to canonical ids, each (src, dst) once."""
    m = lambda end: moved.select(F.col("id").alias(end), F.col("canonical").alias(f"{end}_to"))
    e = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    return e.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst")).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows replace old ones of equal key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def first_writes(requests: DataFrame, key: list[str], order: str) -> DataFrame:
    """Requests with deduplicated: true for all but the first of a key, and the id first stored."""
    w = requests.groupBy(*key).agg(F.min_by("id", order).alias("stored_id"))
    return requests.join(w, key).withColumn("deduplicated", F.col("id") != F.col("stored_id"))


# -- hierarchy
def path_to_root(nodes: DataFrame, ids: DataFrame, depth: int = 64) -> DataFrame:
    """seed, id, up: every seed's chain of parents, the seed itself at 0. Ends when no chain grows any more.

    A chain over depth, as a circle of parents gives, raises ValueError.
    """
    from cairn.operators.graph import durable

    parent = nodes.filter("parent_id is not null").select("id", "parent_id")
    chain = durable(ids.select(F.col("id").alias("seed"), "id").withColumn("up", F.lit(0)))
    front, out = chain, chain
    for d in range(1, depth + 1):
        front = durable(front.join(parent, "id").select("seed", F.col("parent_id").alias("id"), F.lit(d).alias("up")))  # the frontier alone
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"a chain of parents is longer than {depth}")


def lca(paths: DataFrame, n_seeds: int) -> DataFrame:
    """The nearest node that lies on every seed's chain."""
    shared = paths.groupBy("id").agg(F.count_distinct("seed").alias("n"), F.min("up").alias("up")).filter(F.col("n") == n_seeds)
    return shared.orderBy("up", "id").limit(1).select("id")


def parentage_findings(nodes: DataFrame) -> DataFrame:
    """id, finding: self_parent, missing_parent, layer_order (parent's layer not lower)."""
    p = nodes.select(F.col("id").alias("parent_id"), F.col("layer").alias("pl"))
    j = nodes.filter("parent_id is not null").join(p, "parent_id", "left")
    f = F.when(F.col("id") == F.col("parent_id"), "self_parent").when(F.col("pl").isNull(), "missing_parent").when(F.col("pl") >= F.col("layer"), "layer_order")
    return j.select("id", f.alias("finding")).filter("finding is not null")


# -- taxonomy and ontology
def duplicate_labels(concepts: DataFrame, key: list[F.Column]) -> DataFrame:
    """id, previous_id: each repeat of a normalised label among concepts not rejected, with the one before it."""
    k = concepts.filter("status != 'rejected'").withColumn("k", C.record_key(*key))
    w = Window.partitionBy("k").orderBy("position", "id")
    return k.select("id", F.lag("id").over(w).alias("previous_id")).filter("previous_id is not null")


def dangling(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """id, missing: relations whose subject or object is no known concept."""
    s = relations.join(ids.select(F.col("id").alias("subject_id")), "subject_id", "left_anti").select("id", F.lit("subject").alias("missing"))
    o = relations.join(ids.select(F.col("id").alias("object_id")), "object_id", "left_anti").select("id", F.lit("object").alias("missing"))
    return s.unionByName(o)


def on_cycles(broader: DataFrame) -> DataFrame:
    """id: nodes of broader(child, parent) that are left when nodes without a child, or without a parent, are peeled off.

    These lie on cycles or between two of them. Peeling goes on until nothing falls away, so a chain of any length is no cycle.
    """
    from cairn.operators.graph import durable

    e = durable(broader.select("child", "parent").distinct())
    n = e.count()
    while n:
        e2 = e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        e2 = durable(e2.select("child", "parent"))
        m = e2.count()
        e = e2
        if m == n:
            break
        n = m
    return e.select(F.explode(F.array("child", "parent")).alias("id")).distinct()


def undeclared(edges: DataFrame, declared: DataFrame, cap: int = 5000) -> DataFrame:
    """id, severity: warning for predicates not declared (any case) among the first cap edges by id; info if there are more."""
    seen = edges.select("id", "predicate").orderBy("id").limit(cap + 1)
    rank = F.row_number().over(Window.orderBy("id"))  # cap + 1 rows
    seen = seen.withColumn("r", rank)
    bad = seen.filter(F.col("r") <= cap).withColumn("k", F.lower("predicate")).join(declared.select(F.lower("label").alias("k")), "k", "left_anti")
    return bad.select(F.col("id").cast("string").alias("id"), F.lit("warning").alias("severity")).unionByName(seen.filter(F.col("r") > cap).select(F.lit("truncated").alias("id"), F.lit("info").alias("severity")))


# -- lifecycle
def forget(memories: DataFrame, chosen: F.Column, mode: str) -> DataFrame:
    """delete, redact, tombstone or archive the chosen memories."""
    if mode == "delete":
        return memories.filter(~F.coalesce(chosen, F.lit(False)))
    status = {"redact": "redacted", "tombstone": "forgotten", "archive": "archived"}[mode]
    out = memories.withColumn("status", F.when(chosen, status).otherwise(F.col("status")))
    return out if mode == "archive" else out.withColumn("text", F.when(chosen, "").otherwise(F.col("text")))


def role(kind: str = "kind", retention: str = "retention", session: str = "session") -> F.Column:
    working = F.col(kind).isin("observation", "episode") & F.col(retention).isin("ephemeral", "session") & F.col(session).isNotNull()
    return F.when(working, "working").when(F.col(kind).isin("observation", "episode"), "episodic").when(F.col(kind) == "procedure", "procedural").otherwise("semantic")


def reflection(memories: DataFrame, scope: list[str], show: int = 3) -> DataFrame:
    """One belief per scope over its active texts: count, digest of all texts, and the first few in id order.

    Texts enter as hashes that are combined before the shuffle; a scope's texts are never gathered in one row.
    """
    a = memories.filter("status = 'active'")
    head = F.col("h")
    first = a.select(*scope, "id", F.substring("text", 1, 40).alias("t")).withColumn("r", F.row_number().over(Window.partitionBy(*scope).orderBy("id"))).filter(F.col("r") <= show)  # group limit before the shuffle
    said = first.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("h"))
    n = a.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id", "text")).alias("digest"))
    return n.join(said, scope).select(*scope, "digest", F.concat(F.col("n").cast("string"), F.lit(" active memories: "), F.array_join(F.transform(head, lambda x: x["t"]), "; ")).alias("content"), F.lit(0.5).alias("confidence"))


def retention_curve(elapsed: F.Column, stability: F.Column) -> F.Column:
    return F.when(stability <= 0, 1.0).otherwise(F.exp(-elapsed / stability))


PLANS = {"time_window": ("reflection", "decay"), "event_count": ("reflection", "decay"), "retrieval_failure": ("reflection", "reindex", "evaluation"),
         "hybrid": ("reflection", "decay", "reindex", "merge", "link", "summarize", "contradiction", "evaluation"), "manual": ("evaluation",)}


def consolidation_plan(strategy: str | None) -> list[str]:
    return list(PLANS.get(strategy or "manual", PLANS["manual"]))


# -- evaluation
def evaluate(expected: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, failures: targets that must and must not be there against results(case_id, target_id, score).

    expected: case_id, target_id, must (include or exclude), min_score.
    """
    j = expected.join(results, ["case_id", "target_id"], "left")
    bad = F.when((F.col("must") == "include") & (F.col("score").isNull() | (F.col("score") < F.col("min_score"))), 1).when((F.col("must") == "exclude") & F.col("score").isNotNull(), 1).otherwise(0)
    return j.groupBy("case_id").agg(F.sum(bad).alias("failures"))


def qa_score(answer: str, keywords: str) -> F.Column:
    """no_answer for refusals, correct from half of the keywords on, partial for any, else wrong."""
    a = F.lower(answer)
    n = F.size(keywords)
    hit = F.size(F.filter(F.col(keywords), lambda k: a.contains(F.lower(k))))
    refused = a.rlike("i don't know|no information|cannot find|not found|unable to")
    return F.when(refused, "no_answer").when(hit * 2 >= n, "correct").when(hit > 0, "partial").otherwise("wrong")
