"""Scope, policy and cue predicates as Columns, folded into the scan's filter where request values are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("subject", "workspace", "session", "environment")


def scope_allows(tenant: str, **request: str | None) -> Column:
    """Tenant equal; a null request value is a wildcard, a set one must be equal (a null record value is not)."""
    out = F.col("tenant") == tenant
    for dim, want in request.items():
        if dim not in DIMS:
            raise ValueError(f"unknown scope dimension {dim}")
        if want is not None:
            out &= F.col(dim) == want
    return out


def omit_reason(now: int, include_archived: bool = False, authorized: Column | None = None) -> Column:
    """Why a record is left out of retrieval, null if it is not; archived ones are 'archived' unless included."""
    out = F.when(F.col("expires_s") <= now, "expired").when(F.col("status").isin("redacted", "forgotten"), "redacted")
    if not include_archived:
        out = out.when(F.col("status") == "archived", "archived")
    out = out.when((F.size("allowed_uses") > 0) & ~F.array_contains("allowed_uses", "retrieval"), "policy_denied")
    return out.when(~authorized, "policy_denied") if authorized is not None else out


def memory_filter(kinds: list[str] | None = None, since: int | None = None, until: int | None = None, min_confidence: float | None = None) -> Column:
    parts = [F.lit(True)]
    if kinds:
        parts.append(F.col("kind").isin(kinds))
    if since is not None:
        parts.append(F.col("created_s") >= since)
    if until is not None:
        parts.append(F.col("created_s") <= until)
    if min_confidence is not None:
        parts.append(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    return reduce(lambda a, b: a & b, parts)


def cue_matches(value: Column, operator: str, target: str) -> Column:
    """Trimmed, lower-cased comparison; blank targets and unknown operators never match."""
    t = target.strip().lower()
    v = F.lower(F.trim(value))
    if not t:
        return F.lit(False)
    return {"equals": v == t, "contains": v.contains(t), "starts_with": v.startswith(t), "ends_with": v.endswith(t)}.get(operator, F.lit(False))


def decay_due(now: int) -> Column:
    return (F.col("status") == "active") & (F.col("retention") != "legal_hold") & F.coalesce(F.col("expires_s") <= now, F.lit(False))


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page by key; limit is held to 1..500."""
    return df.filter(F.col(key) > after).orderBy(key).limit(max(1, min(limit, 500)))


LANES = {"memory": ["memory"], "knowledge": ["entity", "relationship", "concept"], "code": ["entity", "relationship", "concept"], "docs": ["chunk", "document"], "beliefs": ["belief"]}


def lane_types(lanes: list[str]) -> list[str] | None:
    """Target types of the named lanes; None (all) for no names; unknown ones are passed over."""
    return sorted({t for x in lanes for t in LANES.get(x, [])}) if lanes else None
