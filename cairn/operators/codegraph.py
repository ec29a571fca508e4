"""Code-graph scanners and look-ups over text lines and edges, evidence bundles, provenance and the engine facade."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = "get|post|put|delete|patch|head|options"
ENDPOINT = rf"(?i)(?:^|[^A-Za-z0-9])({METHODS})\(\s*[\"'`](/[^\"'`]*)"
API_CALL = r"(?i)(?:fetch|axios(?:\.\w+)?|requests\.\w+|http\.\w+|client\.\w+)\(\s*[\"'`]([^\"'`]+)"
ENTRY = r"\bfn main\(|\bint main\(|\bdef main\(|\bfunc main\(|__main__|\bexports\.handler\b|\blambda_handler\b"

BLOCK = 4096  # rows of a key that a task holds of either side of ordered_pairs


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 1), text."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p", "text")).select(id_col, (F.col("p") + 1).alias("line"), "text")


def endpoints(ln: DataFrame, id_col: str) -> DataFrame:
    """id, line, method, path of method("/path") call sites that no letter or digit precedes."""
    m = ln.filter(F.col("text").rlike(ENDPOINT))
    return m.select(id_col, "line", F.upper(F.regexp_extract("text", ENDPOINT, 1)).alias("method"), F.regexp_extract("text", ENDPOINT, 2).alias("path"))


def api_calls(ln: DataFrame, id_col: str) -> DataFrame:
    m = ln.filter(F.col("text").rlike(API_CALL))
    return m.select(id_col, "line", F.regexp_extract("text", API_CALL, 1).alias("url"))


def entry_points(ln: DataFrame, id_col: str) -> DataFrame:
    return ln.filter(F.col("text").rlike(ENTRY)).select(id_col, "line")


def topology(calls: DataFrame, points: DataFrame) -> DataFrame:
    """call_id, endpoint_id: the call's path equals the endpoint's or ends with it.

    Every suffix of a call's path that starts at a slash is a join key, so this is an equi-join, not all pairs.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    parts = F.split(path, "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")))
    keyed = calls.filter(F.size(parts) > 1).select("call_id", F.explode(F.array_distinct(suffix)).alias("path"))
    return keyed.join(points.select("endpoint_id", "path"), "path").select("call_id", "endpoint_id").distinct()


def topology_paths(calls: DataFrame, points: DataFrame, id_col: str) -> DataFrame:
    """path, n_calls, n_endpoints, first_call, first_endpoint, n_links: what topology() links, told by path.

    All calls and endpoints of a path are linked, so counts stand for their pairs, which would grow with the square.
    """
    ends = topology(calls.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", F.col("url").alias("call_id")), points.select("path").distinct().withColumn("endpoint_id", F.col("path")))
    by_url = calls.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("least"))
    c = ends.withColumnRenamed("call_id", "url").join(by_url, "url").groupBy(F.col("endpoint_id").alias("path")).agg(F.sum("n").alias("n_calls"), F.min("least").alias("first_call"))
    e = points.groupBy("path").agg(F.count(F.lit(1)).alias("n_endpoints"), F.min(id_col).alias("first_endpoint"))
    return c.join(e, "path").withColumn("n_links", F.col("n_calls") * F.col("n_endpoints"))


def ordered_pairs(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """All pairs of rows of equal key and id_col < b_id_col; the second row's columns begin with b_.

    A key's rows are cut into blocks of BLOCK in the order of ids. A task joins two blocks, so the pairs of a frequent key are
    spread over all cores, and tasks are counted by pairs: by their bytes, adaptive execution would put them all together.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(id_col))
    rows = df.withColumn("__of", F.ceil(n / BLOCK).cast("int")).withColumn("__at", F.floor((rank - 1) / BLOCK).cast("int"))
    cells = df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()[0] / BLOCK**2
    parts = int(max(df.sparkSession.sparkContext.defaultParallelism, min(cells, 20_000)))
    a = rows.withColumn("__b", F.explode(F.sequence("__at", F.col("__of") - 1))).withColumnRenamed("__at", "__a").drop("__of")
    b = rows.withColumn("__a", F.explode(F.sequence(F.lit(0), "__at"))).withColumnRenamed("__at", "__b").drop("__of")
    b = b.withColumnsRenamed({c: f"b_{c}" for c in df.columns if c != key})
    on = [key, "__a", "__b"]
    return a.repartition(parts, *on).join(b.repartition(parts, *on).hint("shuffle_hash"), on).filter(F.col(id_col) < F.col(f"b_{id_col}")).drop("__a", "__b")


def resolve_entity(entities: DataFrame, wanted: str) -> DataFrame:
    """The entity of that name or id, else the first whose name contains it (any case)."""
    w = wanted.strip().lower()
    rank = F.when((F.col("name") == wanted) | (F.col("id") == wanted), 0).when(F.lower("name").contains(w), 1)
    return entities.withColumn("__r", rank).filter("__r is not null").orderBy("__r", "id").limit(1).drop("__r")


def resolve_targets(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with object_id filled by name where it is missing (the first id of a name)."""
    by = entities.groupBy(F.col("name").alias("object_name")).agg(F.min("id").alias("__id"))
    return edges.join(by, "object_name", "left").withColumn("object_id", F.coalesce("object_id", "__id")).drop("__id")


def substring_scan(entities: DataFrame, query: str, k: int) -> DataFrame:
    return entities.filter(F.lower(F.concat_ws(" ", "name", "kind")).contains(query.lower())).orderBy("id").limit(k)


def diagram(pairs: DataFrame, limit: int = 50) -> DataFrame:
    """text: a Mermaid graph of the first edges between named services."""
    top = pairs.select("a", "b").distinct().orderBy("a", "b").limit(limit)
    return top.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(F.concat("a", F.lit(" --> "), "b"))), "\n")).alias("text"))


def evidence(entities: DataFrame, edges: DataFrame, chunks: DataFrame, terms: list[str], n_entities: int = 20, n_edges: int = 30, n_chunks: int = 8) -> DataFrame:
    """kind, id, score: best entities by their best term, edges that touch them, chunks that hold a term."""
    name = F.lower("name")
    best = F.greatest(F.lit(0), *(F.when(name == t, 3).when(name.startswith(t) | name.endswith(t), 2).when(name.contains(t), 1).otherwise(0) for t in terms))
    e = entities.select("id", best.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(n_entities)
    ids = F.broadcast(e.select("id"))
    hit = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns))
    r = hit.select("src", "dst").distinct().orderBy("src", "dst").limit(n_edges).select(F.concat_ws("->", "src", "dst").alias("id"), F.lit(1).alias("score"))
    text = F.lower("text")
    c = chunks.select("id", sum((text.contains(t).cast("int") for t in terms), F.lit(0)).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(n_chunks)
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), F.col("id").cast("string").alias("id"), F.col("score").cast("int").alias("score"))
    return tag(e, "entity").unionByName(tag(r, "relationship")).unionByName(tag(c, "chunk"))


def predict_terms(queries: DataFrame, col: str) -> DataFrame:
    """term: the distinct lower-case tokens of the recent queries."""
    return queries.select(F.explode(F.split(F.lower(col), r"[^\p{L}\p{N}]+")).alias("term")).filter("term != ''").distinct()


def attach_evidence(records: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """records(id, evidence array) with new evidence(id, ref) appended, each ref once, in order."""
    new = evidence_rows.groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("__new"))  # a record's own evidence
    out = records.join(new, "id", "left")
    return out.withColumn("evidence", F.array_union("evidence", F.coalesce("__new", F.expr("cast(array() as array<string>)")))).drop("__new")


def evidence_by_scope(parts: list[DataFrame], limit: int) -> DataFrame:
    """Rows of the tables one after the other, by id, until limit."""
    out = None
    for i, df in enumerate(parts):
        df = df.orderBy("id").limit(limit).withColumn("__p", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("__p", "id").limit(limit).drop("__p")


def aggregate_status(steps: DataFrame) -> DataFrame:
    """partial if any step failed, else complete."""
    return steps.agg(F.when(F.count_if(F.col("status") == "failed") > 0, "partial").otherwise("complete").alias("status"))


def diagnostics(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def ranked_view(edges: DataFrame, most: int, most_edges: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(id, degree) of the best connected nodes and the edges among them."""
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    top = deg.orderBy(F.desc("degree"), "id").limit(most)
    ids = F.broadcast(top.select("id"))
    e = edges.select("src", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return top, e.orderBy("src", "dst").limit(most_edges)


def dependencies(manifests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name of JSON manifests' dependencies."""
    deps = F.from_json(F.col(text_col), "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.concat(F.coalesce(F.map_keys(deps["dependencies"]), F.expr("cast(array() as array<string>)")), F.coalesce(F.map_keys(deps["devDependencies"]), F.expr("cast(array() as array<string>)")))
    return manifests.select(id_col, F.explode(F.array_sort(F.array_distinct(keys))).alias("name"))


def incremental_windows(events: DataFrame, key: str, order: str) -> DataFrame:
    """events with previous: the value of order before each row within its key."""
    return events.withColumn("previous", F.lag(order).over(Window.partitionBy(key).orderBy(order)))


@dataclass
class Profile:
    """Settings of an engine; paths stay below root."""

    root: str
    embedding_dimensions: int = 384
    fusion: str = "rrf"
    weights: dict = field(default_factory=dict)
    enable_vector: bool = True

    def path(self, name: str) -> str:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} leaves the root")
        return f"{self.root.rstrip('/')}/{name}"


class CapabilityUnsupported(RuntimeError):
    """The engine has no table for what was asked."""


class Engine:
    """One attribute per capability: tables by name, with errors for what is missing."""

    def __init__(self, spark, profile: Profile, tables: dict[str, DataFrame]) -> None:
        self.spark, self.profile, self.tables = spark, profile, tables

    def require(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CapabilityUnsupported(name)
        return self.tables[name]

    def capabilities(self) -> dict[str, bool]:
        known = ("memories", "events", "sources", "documents", "chunks", "entities", "relationships", "beliefs", "hierarchy_nodes", "concepts", "vectors", "procedures")
        return {k: k in self.tables for k in known}

