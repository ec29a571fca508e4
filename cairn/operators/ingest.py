"""Chunkers, extraction, scanners and manifests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.sources.domain import spread

CHUNK = "array<struct<kind:string,text:string,start_line:int,end_line:int>>"
_DECLARE = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+|default\s+|async\s+|static\s+|public\s+|private\s+|protected\s+|abstract\s+)*(fn|struct|enum|trait|impl|mod|function|class|interface|type|def|func|const)\s+([A-Za-z_$][\w$]*)")


def pack_lines(text: str | None, most: int = 1200) -> list[dict]:
    """Lines packed greedily up to most bytes, newlines counted; a longer line is a chunk of its own."""
    out, buf, size, start = [], [], 0, 1
    for i, line in enumerate((text or "").split("\n"), 1):
        n = len(line.encode()) + (1 if buf else 0)
        if buf and size + n > most:
            out.append((buf, start, i - 1))
            buf, size, start = [], 0, i
            n = len(line.encode())
        buf.append(line)
        size += n
    if buf:
        out.append((buf, start, start + len(buf) - 1))
    return [{"kind": "paragraph", "text": "\n".join(b), "start_line": s, "end_line": e} for b, s, e in out if "".join(b).strip()]


def markdown(text: str | None) -> list[dict]:
    """Front matter off; fenced code, sections under # headers, other paragraphs."""
    lines = (text or "").split("\n")
    at = 0
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        at = end + 1 if end else 0
    out, buf, kind, start, fence = [], [], "paragraph", at + 1, None

    def flush(last: int) -> None:
        while buf and not buf[-1].strip():
            buf.pop()
            last -= 1
        if buf:
            out.append({"kind": kind, "text": "\n".join(buf), "start_line": start, "end_line": last})
        buf.clear()

    for i in range(at, len(lines)):
        line = lines[i]
        mark = re.match(r"^\s*(```+|~~~+)", line)
        if fence:
            buf.append(line)
            if mark and mark[1].startswith(fence):
                flush(i + 1)
                fence, kind, start = None, "paragraph", i + 2
        elif mark:
            flush(i)
            fence, kind, start = mark[1][:3], "code_block", i + 1
            buf.append(line)
        elif re.match(r"^#{1,6}\s", line):
            flush(i)
            kind, start = "section", i + 1
            buf.append(line)
        elif not line.strip() and kind == "paragraph":
            flush(i)
            start = i + 2
        else:
            buf.append(line)
    flush(len(lines))
    return out


def code_symbols(text: str | None) -> list[dict]:
    """A chunk from each declaration to the next; one file chunk without any."""
    lines = (text or "").split("\n")
    at = [i for i, x in enumerate(lines) if _DECLARE.match(x)]
    if not at:
        return [{"kind": "file", "text": text or "", "start_line": 1, "end_line": len(lines)}] if (text or "").strip() else []
    return [{"kind": "symbol", "text": "\n".join(lines[a:b]), "start_line": a + 1, "end_line": b} for a, b in zip(at, [*at[1:], len(lines)])]


def capitalized(text: str | None) -> list[str]:
    """Runs of two or more capitalised words, each once in any case; of over 20 the longest."""
    runs, run = [], []
    for raw in [*(text or "").split(" "), ""]:
        w = raw.strip(".,;:!?()[]{}\"'\n\t")
        if w and w[0].isupper():
            run.append(w)
            continue
        if len(run) >= 2:
            runs.append(" ".join(run))
        run = []
    seen, out = set(), []
    for r in runs:
        if r.lower() not in seen:
            seen.add(r.lower())
            out.append(r)
    return out if len(out) <= 20 else sorted(out, key=lambda x: -len(x))[:20]


CHUNKERS = {"plain": pack_lines, "markdown": markdown, "code": code_symbols}


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with Arrow batches of 4 MB unless the session sets a bound: 10,000 long texts, their chunks and copies don't fit a worker."""
    if docs.sparkSession.conf.get(BATCH, None) is None:
        docs.sparkSession.conf.set(BATCH, str(4 << 20))
    return docs


def chunk(docs: DataFrame, id_col: str, text_col: str, how: str = "plain") -> DataFrame:
    """id, position, kind, text, start_line, end_line: one row per chunk, in Arrow batches; blank texts give none."""
    f = CHUNKERS[how]

    @F.pandas_udf(CHUNK)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return spread(bounded(docs.select(id_col, text_col))).select(id_col, F.posexplode(run(F.col(text_col))).alias("position", "c")).select(id_col, F.col("position").cast("long").alias("position"), "c.*")


def extract_names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name of capitalised runs; of over twenty in a text the longest twenty."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(capitalized)

    return spread(bounded(docs.select(id_col, text_col))).select(id_col, F.explode(run(F.col(text_col))).alias("name"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, removed) between manifests (path, hash); equal hashes are skipped."""
    j = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return j.select("path", change.alias("change")).filter("change is not null")


def enclosing(lines: DataFrame, keys: list[str], order: str, header: F.Column) -> DataFrame:
    """lines with enclosing: the last header at or before each line."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("enclosing", F.last(header, ignorenulls=True).over(w))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, position, href of every link."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(hrefs).alias("position", "href"))


def describes(concepts: DataFrame, symbols: DataFrame) -> DataFrame:
    """concept_id, symbol_id of equal names (the first symbol of a name), confidence 0.8."""
    s = symbols.groupBy(C.normalize_name(F.col("name")).alias("k")).agg(F.min("id").alias("symbol_id"))
    return concepts.select(F.col("id").alias("concept_id"), C.normalize_name(F.col("name")).alias("k")).join(s, "k").select("concept_id", "symbol_id", F.lit(0.8).alias("confidence"))


def co_mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """chunk_id, name of whole-word mentions: an equi-join on words, never all pairs."""
    w = chunks.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))).alias("name"))
    return w.join(names, "name", "left_semi")


def openapi_operations(spec: dict) -> list[tuple[str, str]]:
    """(key, summary) of each operation: METHOD /path with parameters as {}, no slash at the end."""
    out = []
    for path, ops in sorted((spec.get("paths") or {}).items()):
        for m in ("get", "put", "post", "delete", "options", "head", "patch", "trace"):
            if isinstance(ops, dict) and m in ops:
                key = re.sub(r"\{[^}]*\}", "{}", path).rstrip("/") or "/"
                out.append((f"{m.upper()} {key}", (ops[m] or {}).get("summary", "")))
    return out


def cargo_dependencies(text: str) -> list[str]:
    """Names in the dependency sections of a Cargo manifest."""
    out, on = set(), False
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("["):
            on = bool(re.match(r"^\[(?:.*\.)?(?:dev-|build-)?dependencies\]$", s))
        elif on and (m := re.match(r"^([A-Za-z0-9_-]+)\s*[=.]", s)):
            out.add(m[1])
    return sorted(out)


def owners(text: str) -> list[tuple[str, str]]:
    """(pattern, owner) rules of a CODEOWNERS file."""
    rules = []
    for line in text.split("\n"):
        parts = line.split("#")[0].split()
        rules += [(parts[0], o) for o in parts[1:]]
    return rules
