"""Scalar functions as Column builders: all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def facts_terms(query: str) -> list[str]:
    """Distinct sorted lower-case runs of letters and digits."""
    import re

    return sorted({w for w in re.split(r"[^\w]|_", query.lower()) if w})


def graph_terms(query: str) -> list[str]:
    """Lower-case runs of letters and digits of over two bytes, repeats kept."""
    import re

    return [w for w in re.split(r"[^\w]|_", query.lower()) if len(w.encode()) > 2]


def identifier_text(c: Column) -> Column:
    """camelCase split, punctuation to one space, lower case, other scripts to spaces."""
    split = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(split, "[^A-Za-z0-9]+", " ")))


def live_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open validity; null start is the far past, null end the far future."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def as_of(start: Column, end: Column, at: Column) -> Column:
    """Retrieval as-of: like live_at, but a null start is left out."""
    return start.isNotNull() & (start <= at) & (end.isNull() | (at < end))


def recency(age_days: Column, half_life: float = 14.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / max(half_life, 1e-9))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def normalize_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def record_key(*parts: Column) -> Column:
    """Injective key: byte length and text of every part."""
    out = []
    for p in parts:
        p = F.coalesce(p, F.lit(""))
        out.append(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p))
    return F.concat_ws("", *out)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def excerpt(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("\n... [truncated]")))


def label(c: Column, n: int = 60) -> Column:
    """First non-blank line, cut to n signs."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.get(lines, F.lit(0))), 1, n)


def concept_name(c: Column) -> Column:
    """First line without leading #, spaces collapsed, 48 signs."""
    first = F.get(F.split(c, "\n"), F.lit(0))
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(first, "^[# ]+", ""), r"\s+", " ")), 1, 48)


def route(c: Column) -> Column:
    """A url path with query stripped and parameters, numbers and long slugs as {param}."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    part = lambda s: F.when(s.rlike(r"^[0-9]+$") | s.rlike(r"^[:{]") | (F.length(s) > 20), F.lit("{param}")).otherwise(s)
    return F.array_join(F.transform(F.split(path, "/"), part), "/")


def redact(key: Column, value: Column) -> Column:
    """Values of sensitive keys, and user:password in urls."""
    hidden = F.lower(key).rlike("token|secret|password|authorization|api_key|apikey|credential")
    return F.when(hidden, F.lit("[REDACTED]")).otherwise(F.regexp_replace(value, r"://[^/@\s]+@", "://[REDACTED]@"))


def query_shape(c: Column) -> Column:
    """doc, mixed or code by how many of five code signals a query shows."""
    signals = [r"[a-z][A-Z]", r"[A-Za-z0-9]_[A-Za-z0-9]", r"::|->|\(\)", r"\.[a-z]{1,4}\b", r"(?i)\b(function|class|method|module|struct|impl|call|import)\b"]
    n = sum((F.when(c.rlike(s), 1).otherwise(0) for s in signals[1:]), F.when(c.rlike(signals[0]), 1).otherwise(0))
    return F.when(n == 0, "doc").when(n <= 2, "mixed").otherwise("code")


def secret_file(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    env = base.rlike(r"^\.env") & ~base.isin(".env.example", ".env.sample", ".env.template", ".env.dist", ".env.defaults")
    return env | base.rlike(r"(?i)\.(pem|key|p12|pfx|crt|cer|der|jks|keystore)$") | base.isin("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")


def denied(path: Column, dirs: list[str], exts: list[str]) -> Column:
    seg = F.split(path, r"[/\\]")
    return F.arrays_overlap(seg, F.array(*map(F.lit, dirs))) | F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(exts)


def cyclomatic(c: Column) -> Column:
    """1 + branch keywords and boolean operators on lines that are no comments."""
    code = F.filter(F.split(c, "\n"), lambda x: ~F.ltrim(x).rlike(r"^(//|#|\*|/\*)"))
    words = r"\b(if|for|while|case|catch|match|elif|except|when|switch|loop|unless|until)\b"
    return F.aggregate(code, F.lit(1), lambda s, x: s + F.regexp_count(x, F.lit(words)) + F.regexp_count(x, F.lit(r"&&|\|\|")))
