"""Write path, identity resolution, repository reads and deletes, consolidation runs, and smaller look-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import graph


# -- filters
def scope_or_global(tenant: str, **request: str | None) -> Column:
    """The other polarity of scope_allows: a null record value is global, a set one must be equal to the request's."""
    out = F.col("tenant") == tenant
    for dim, want in request.items():
        out &= F.col(dim).isNull() | (F.col(dim) == want) if want is not None else F.col(dim).isNull()
    return out


def repository_matches(provenance: Column, repository: str) -> Column:
    """The org/repo of any form of address stands in the provenance, in any case."""
    name = repository.strip().lower().removesuffix(".git").rstrip("/")
    return F.lower(provenance).contains("/".join(name.replace(":", "/").split("/")[-2:]))


def target_allowed(target_type: Column, include_chunks: bool) -> Column:
    return target_type.isin(["entity", "chunk"] if include_chunks else ["entity"])


def threshold(hits: DataFrame, least: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Hits that score at least that much, and one row with how many do not."""
    return hits.filter(F.col("score") >= least), hits.agg(F.count_if(~F.coalesce(F.col("score") >= least, F.lit(False))).alias("dropped"))


def concept_links(name: Column, allowed: Iterable[str] = (), generic: Iterable[str] = ()) -> Column:
    """Whether a concept may be linked by name: allowed names always, else names over eight bytes that are not generic."""
    n = C.normalize_name(name)
    return n.isin(list(allowed)) | ((F.octet_length(n) > 8) & ~n.isin(list(generic)))


def entity_search(entities: DataFrame, query: str, k: int, columns: tuple[str, ...] = ("name", "path", "source")) -> DataFrame:
    """The first k entities in id order that hold any term of two signs or more in one of the columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    terms = [t for t in query.lower().split() if len(t) > 1]
    hit = reduce(lambda a, b: a | b, (hay.contains(t) for t in terms), F.lit(False))
    return entities.filter(hit).orderBy("id").limit(k)


def resolve_content(hits: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Hits with the content of their chunk, else the name and kind of their entity; hits without either go.

    hits come after their limit, so they are the small side of both joins.
    """
    c = chunks.select(F.col("id").alias("target_id"), F.col("text").alias("__chunk")).join(F.broadcast(hits.select("target_id")), "target_id", "left_semi")
    e = entities.select(F.col("id").alias("target_id"), F.concat_ws(" ", "name", "kind").alias("__entity")).join(F.broadcast(hits.select("target_id")), "target_id", "left_semi")
    out = hits.join(c, "target_id", "left").join(e, "target_id", "left").withColumn("content", F.coalesce("__chunk", "__entity"))
    return out.filter("content is not null").drop("__chunk", "__entity")


def cross_rerank(cands: DataFrame, scorer: Callable[[Column], Column], limit: int, text: str = "content") -> DataFrame:
    """Candidates by scorer(text), the earlier rank first among equals. scorer may be a Column expression or a pandas UDF."""
    return cands.withColumn("score", scorer(F.col(text))).orderBy(F.desc("score"), "lane_rank").limit(limit)


def recall(lanes: dict[str, Callable[[], DataFrame]], modes: list[str]) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """Candidates of the wanted lanes, and (lane, severity, message) of those that failed or don't exist; others go on.

    A lane is a function, so that a table that is missing or a column that doesn't resolve degrades that lane alone.
    """
    want = set(modes) | ({"vector"} if "semantic" in modes else set())
    good, failures = [], []
    for name, lane in lanes.items():
        if modes and name not in want:
            continue
        try:
            good.append(lane())
        except Exception as e:  # noqa: BLE001  any fault of a lane is its own
            failures.append((name, "degraded", str(e).split("\n")[0][:200]))
    failures += [(m, "warning", "unsupported_mode") for m in sorted(set(modes)) if m not in lanes and not (m == "semantic" and "vector" in lanes)]
    return (reduce(DataFrame.unionByName, good) if good else None), failures


class SnapshotCache:
    """A graph's tables, kept per scope until something is written there."""

    def __init__(self) -> None:
        self.held: dict[tuple, DataFrame] = {}

    def get(self, scope: tuple, load: Callable[[], DataFrame]) -> DataFrame:
        if scope not in self.held:
            self.held[scope] = load().persist()
        return self.held[scope]

    def invalidate(self, scope: tuple) -> None:
        df = self.held.pop(scope, None)
        if df is not None:
            df.unpersist()


# -- graph look-ups
def entity_key(name: Column, id_: Column) -> Column:
    return F.coalesce(F.when(F.trim(name) != "", name), id_)


def endpoints_only(relationships: DataFrame) -> DataFrame:
    """Names and ids of both ends: the only columns of relationships that graph algorithms read."""
    return relationships.select("subject_id", "subject_name", "object_id", "object_name")


def symbol_context(edges: DataFrame, node, depth: int) -> DataFrame:
    """side (caller, callee), id, hops within depth."""
    up = graph.reach(edges, [node], depth, reverse=True).select(F.lit("caller").alias("side"), "id", "hops")
    return up.unionByName(graph.reach(edges, [node], depth).select(F.lit("callee").alias("side"), "id", "hops"))


def process_flow(edges: DataFrame, entry, depth: int) -> DataFrame:
    """id, is_entry: the entry and what it reaches; the entry comes first where the rows are ordered."""
    got = graph.reach(edges, [entry], depth).select("id").filter(F.col("id") != entry).withColumn("is_entry", F.lit(False))
    return edges.sparkSession.createDataFrame([(entry, True)], got.schema).unionByName(got)


def whats_changed(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change, in_degree, out_degree of entities (id, hash) that were added, removed or modified."""
    j = old.select("id", F.col("hash").alias("h0")).join(new.select("id", F.col("hash").alias("h1")), "id", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified")
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    got = j.select("id", change.alias("change")).filter("change is not null").join(i, "id", "left").join(o, "id", "left")
    return got.fillna(0, ["in_degree", "out_degree"])


def overview(labels: DataFrame) -> DataFrame:
    """n_communities, largest."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_communities"), F.max("n").alias("largest"))


def member_index(labels: DataFrame, cap: int = 1000) -> DataFrame:
    """label, id: the first cap members of each label; the limit is taken before rows are moved."""
    r = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return labels.withColumn("r", r).filter(F.col("r") <= cap).select("label", "id")


def community_of(labels: DataFrame, node) -> DataFrame:
    return labels.filter(F.col("id") == node).select("id", "label")


def community_page(labels: DataFrame, edges: DataFrame, label, offset: int, limit: int, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """A page of a label's members in id order, and at most `most` edges within the page."""
    page = labels.filter(F.col("label") == label).select("id").orderBy("id").offset(offset).limit(limit)
    ids = F.broadcast(page)
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return page, inside.select("src", "dst").distinct().orderBy("src", "dst").limit(most)


def calls_in_spans(calls: DataFrame, spans: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """caller, callee of calls(key, line, callee) within spans(key, first, last, caller): the span that starts first, a known
    callee, not the caller itself. Lines are matched within their file only."""
    known = calls.join(names.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")
    j = known.join(spans, key).filter((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last")))
    first = j.groupBy(key, "line", "callee").agg(F.min(F.struct("first", "caller"))["caller"].alias("caller"))
    return first.filter("caller != callee").select("caller", "callee").distinct()


# -- repository
def by_source(entities: DataFrame, graphs: DataFrame, source_key: str) -> DataFrame:
    """Entities of the graphs that a source made."""
    g = graphs.filter(F.col("stable_source_key") == source_key).select("graph_id")
    return entities.join(F.broadcast(g), "graph_id", "left_semi")


def graphs_of(graphs: DataFrame, source_key: str) -> DataFrame:
    return graphs.filter(F.col("stable_source_key") == source_key).orderBy("graph_id")


def chunks_of(chunks: DataFrame, document) -> DataFrame:
    return chunks.filter(F.col("doc_id") == document).orderBy("position")


def delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def delete_graphs(graphs: DataFrame, entities: DataFrame, relationships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the graphs in gone(graph_id) and all that belongs to them."""
    ids = gone.select("graph_id")
    return tuple(t.join(ids, "graph_id", "left_anti") for t in (graphs, entities, relationships))


def retract_prior(graphs: DataFrame, chunks: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graphs and chunks without those of a (source_key, path) that is about to be read again."""
    key = ["source_key", "path"]
    again = incoming.select(*key).distinct()
    return graphs.join(again, key, "left_anti"), chunks.join(again, key, "left_anti")


def gc_repositories(repositories: DataFrame, graphs: DataFrame) -> DataFrame:
    """Repositories that still have a graph."""
    return repositories.join(graphs.select("source_key"), "source_key", "left_semi")


# -- identity
def put_contradictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those of new(id, scope, a, b) whose unordered pair is in neither: the existing one wins, then the least id."""
    pair = [F.col("scope"), F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b")]
    first = new.groupBy(*pair).agg(F.min("id").alias("id"))
    fresh = first.join(old.select(*pair), ["scope", "__a", "__b"], "left_anti").select("id")
    return old.unionByName(new.join(fresh, "id", "left_semi").select(*old.columns))


def merge_memory_entities(given: Column, extracted: Column) -> Column:
    """given names, then extracted ones whose name in lower case is not among them."""
    low = F.transform(given, F.lower)
    return F.concat(given, F.filter(extracted, lambda x: ~F.array_contains(low, F.lower(x))))


def resolve_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """key, outcome (created, matched, merged), aliases of incoming(key, alias) rows against existing(key, aliases).

    merged: an alias is new to a known key; matched: nothing changes.
    """
    new = incoming.groupBy("key").agg(F.array_sort(F.collect_set("alias")).alias("new"))
    j = new.join(existing.select("key", "aliases"), "key", "left")
    outcome = F.when(F.col("aliases").isNull(), "created").when(F.size(F.array_except("new", "aliases")) == 0, "matched").otherwise("merged")
    return j.select("key", outcome.alias("outcome"), F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "new")).alias("aliases"))


def resolve_relationships(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """key, evidence (distinct targets of both, sorted), confidence (the existing one, else the best incoming one)."""
    new = incoming.groupBy(*key).agg(F.collect_set("target_id").alias("n"), F.max("confidence").alias("c"))
    j = existing.select(*key, "evidence", "confidence").join(new, key, "full")
    none = F.array().cast(existing.schema["evidence"].dataType)
    return j.select(*key, F.array_sort(F.array_union(F.coalesce("evidence", none), F.coalesce("n", none))).alias("evidence"), F.coalesce("confidence", "c").alias("confidence"))


# -- memory writes
def invalid(tenant: str = "tenant", text: str = "text", source: str = "source", uses: str = "allowed_uses") -> Column:
    """Why a write is refused, null if it is not."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank(tenant), "tenant_blank").when(blank(text), "text_blank").when(blank(source), "source_blank")
        .when(F.coalesce(F.array_contains(uses, "training_export"), F.lit(False)), "training_export")
    )


def write_memories(requests: DataFrame, stored: DataFrame, key: list[str], order: str, authorized: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, new records, events) of a batch of write requests against stored(key, id).

    Validation, then the authorizer, then the idempotency key: a key that is stored, or came before in the batch, answers
    with the record it stands for. A null key part makes a request its own. responses: id, outcome (stored, deduplicated,
    rejected), reason, stored_id. One event per new record. Nothing is collected; the key is the only shuffle.
    """
    reason = F.coalesce(invalid(), F.when(~authorized, "policy_denied") if authorized is not None else F.lit(None).cast("string"))
    r = requests.withColumn("reason", reason)
    keyed = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    good = r.filter("reason is null").withColumn("__key", F.when(keyed, C.record_key(*(F.col(k).cast("string") for k in key))).otherwise(F.concat(F.lit("own:"), F.col("id").cast("string"))))
    first = good.groupBy("__key").agg(F.min_by("id", order).alias("first_id"))
    had = stored.select(C.record_key(*(F.col(k).cast("string") for k in key)).alias("__key"), F.col("id").alias("had_id"))
    answer = good.join(first, "__key").join(had, "__key", "left").withColumn("stored_id", F.coalesce("had_id", "first_id"))
    outcome = F.when(F.col("had_id").isNull() & (F.col("id") == F.col("first_id")), "stored").otherwise("deduplicated")
    answer = answer.withColumn("outcome", outcome)
    refused = r.filter("reason is not null").select("id", F.lit("rejected").alias("outcome"), "reason", F.lit(None).cast(requests.schema["id"].dataType).alias("stored_id"))
    new = answer.filter("outcome = 'stored'").select(*requests.columns)
    events = new.select(F.col("id").alias("memory_id"), F.lit("memory_written").alias("kind"), F.col(order).alias("sequence"))
    return answer.select("id", "outcome", "reason", "stored_id").unionByName(refused), new, events


def update_status(rows: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """rows with that status where the id is among ids(id), bounded by the caller's request."""
    hit = rows.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return hit.withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).drop("__hit")


def check_retrieval(query: str, limit: int | None, budget: int | None) -> None:
    if not query.strip():
        raise ValueError("query is blank")
    if limit == 0 or budget == 0:
        raise ValueError("limit and budget must not be zero")


# -- consolidation
TRIGGERS = {"time_window": "schedule", "event_count": "event_threshold", "retrieval_failure": "retrieval_failure", "hybrid": "hybrid", "manual": "manual"}


def trigger_of(strategy: str | None) -> str:
    return TRIGGERS.get(strategy or "manual", "manual")


def check_consolidation(tenant: str, actor: str, since: int | None, until: int | None, dry_run: bool, mutating: bool) -> None:
    if not tenant.strip() or not actor.strip():
        raise ValueError("tenant and actor must be given")
    if since is not None and until is not None and since > until:
        raise ValueError("since is after until")
    if mutating == dry_run:
        raise ValueError("the mutating service refuses dry runs, the other one asks for them")


def gated_run(pre: DataFrame, apply: Callable[[], DataFrame], post: Callable[[DataFrame], DataFrame], gate: Callable[[], bool] = lambda: True) -> tuple[str, DataFrame | None, list]:
    """(status, result, failing case ids). Nothing is applied unless the cases before pass and the gate opens.

    pre and post: case_id, failures. At most a hundred failing ids are named.
    """
    failing = evaluation_gate(pre).limit(100).collect()
    if failing:
        return "rejected", None, [r["case_id"] for r in failing]
    if not gate():
        return "skipped", None, []
    out = apply()
    failing = [r["case_id"] for r in evaluation_gate(post(out)).limit(100).collect()]
    return ("partial" if failing else "complete"), out, failing


def evaluation_gate(cases: DataFrame) -> DataFrame:
    return cases.filter("failures > 0").select("case_id", F.concat(F.lit("case failed: "), F.col("case_id").cast("string")).alias("error"))


def composite(results: DataFrame) -> DataFrame:
    """task, status, n_read, n_written of results(task, executor, status, n_read, n_written): the first executor that did not skip
    gives the status; counts are added up, null where no executor gave one."""
    first = F.min_by(F.when(F.col("status") != "skipped", F.col("status")), F.when(F.col("status") != "skipped", F.col("executor")))
    return results.groupBy("task").agg(F.coalesce(first, F.lit("skipped")).alias("status"), F.sum("n_read").alias("n_read"), F.sum("n_written").alias("n_written"))


# -- ingestion
CODE_EXT = "rs ts tsx js jsx py go c h cpp hpp cc java kt rb php cs swift scala sh sql".split()
TEXT_EXT = "md markdown txt rst adoc toml yaml yml json html css".split()
NAMES = {"dockerfile": "code", "makefile": "code", "readme": "text", "license": "text"}


def classify_file(path: Column) -> Column:
    """code, text or none by name, then extension."""
    base = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    ext = F.regexp_extract(base, r"\.([a-z0-9]+)$", 1)
    out = F.when(ext.isin(CODE_EXT), "code").when(ext.isin(TEXT_EXT), "text")
    for name, kind in NAMES.items():
        out = out.when(base == name, kind)
    return out.otherwise("none")


def source_key(remote: Column) -> Column:
    """host/org/repo of a git remote in lower case: no scheme, user, port or .git."""
    x = F.regexp_replace(F.lower(F.trim(remote)), r"^[a-z][a-z0-9+.-]*://", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^[^@/]*@", ""), r"^([^/:]+):[0-9]+/", "$1/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^([^/:]+):", "$1/"), r"/+$", ""), r"\.git$", "")


def contract_key(method: Column, path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, r"\{[^}]*\}", "{}"), r"/+$", "")
    return F.concat(F.upper(method), F.lit(" "), F.when(p == "", "/").otherwise(p))


def api_entities(operations: DataFrame) -> DataFrame:
    """key, source_refs (sorted), metadata of the last writer, of operations(key, source_ref, metadata, ts)."""
    last = F.max(F.struct("ts", "source_ref", "metadata"))["metadata"]
    return operations.groupBy("key").agg(F.array_sort(F.collect_set("source_ref")).alias("source_refs"), last.alias("metadata"))


def retract_source(entities: DataFrame, ref: str) -> DataFrame:
    """Entities without that source; those that have no other go."""
    return entities.withColumn("source_refs", F.array_remove("source_refs", ref)).filter(F.size("source_refs") > 0)


def exposes(operations: DataFrame) -> DataFrame:
    """id, source_ref, key, confidence: one edge from a source to each operation it serves."""
    d = operations.select("source_ref", "key").distinct()
    return d.select(F.sha2(F.concat_ws("\u001f", F.lit("exposes"), "source_ref", "key"), 256).alias("id"), "source_ref", "key", F.lit(0.95).alias("confidence"))


def yaml_fault(text: Column, lines: int = 20_000, indent: int = 64, width: int = 10_000) -> Column:
    """Why a YAML text is not parsed: too many lines, too deep, a line too long, an anchor or alias; null if it may be."""
    ln = F.split(text, "\n")
    return (
        F.when(F.size(ln) > lines, "lines").when(F.exists(ln, lambda x: F.length(x) > width), "width")
        .when(F.exists(ln, lambda x: F.length(x) - F.length(F.ltrim(x)) > indent), "indent").when(F.exists(ln, lambda x: x.rlike(r"(?:^|[:\-\s])[&*][A-Za-z0-9_]+\s*(?:$|\S)")), "anchor")
    )


def repo_label(provenance: Column) -> Column:
    """The part in the first brackets, else the part before the first colon."""
    inner = F.regexp_extract(provenance, r"\[([^\]]+)\]", 1)
    return F.when(inner != "", inner).otherwise(F.split(provenance, ":")[0])


# -- provenance, embedding, evaluation
def evidence_for(kind: str, id_, entities: DataFrame, relationships: DataFrame, sources: DataFrame) -> DataFrame:
    """ref of an entity's, relationship's or source's evidence; a relationship has its own and its provenance."""
    table = {"entity": entities, "relationship": relationships, "source": sources}.get(kind)
    if table is None:
        raise ValueError(f"no evidence is kept for {kind}")
    refs = F.concat(F.col("evidence"), F.col("provenance")) if kind == "relationship" else F.col("evidence")
    return table.filter(F.col("id") == id_).select(F.explode(F.array_distinct(refs)).alias("ref"))


def embed(rows: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """rows with embedding: the stand-in provider without a model, word counts by hash. Blank texts are refused (null)."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at = F.transform(words, lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(F.col("__at"), lambda x: x == d)).cast("double"))
    return rows.withColumn("__at", at).withColumn("embedding", F.when(F.size("__at") > 0, vec)).drop("__at")


def uncovered(required: DataFrame, present: DataFrame) -> DataFrame:
    """Capabilities asked for that no case covers."""
    return required.select("capability").distinct().join(present.select("capability"), "capability", "left_anti")


def pass_summary(runs: DataFrame) -> DataFrame:
    """pass, n, avg_ms, coverage, hit_rate of runs(pass, ms, covered, hit)."""
    return runs.groupBy("pass").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ms").alias("avg_ms"), F.avg(F.col("covered").cast("int")).alias("coverage"), F.avg(F.col("hit").cast("int")).alias("hit_rate")
    )
