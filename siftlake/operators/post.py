"""Policies, baselines, allow lists, ignore files, deduplication: what becomes of findings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T

PROVENANCES = {"AUTH_CREDENTIAL", "HUMAN_AUTHORED", "BUILD_GENERATED", "DERIVED_VALUE", "DOC_EXAMPLE", "UNCERTAIN"}
#: Pattern tables up to so many rows are broadcast.
BROADCAST_ROWS = 50_000


@dataclass
class Policy:
    min_confidence: float = 0.0
    max_file_size: int = 10_000_000
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    severity_map: dict[str, str] = field(default_factory=dict)
    ignore_provenance: list[str] = field(default_factory=list)
    allow_list: list[dict] = field(default_factory=list)
    custom_prefixes: dict[str, str] = field(default_factory=dict)
    require_verification: bool = False
    block_on_findings: bool = False

    @classmethod
    def from_json(cls, text: str) -> "Policy":
        given = json.loads(text)
        p = cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v is not None})
        p.validate()
        return p

    def validate(self) -> None:
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence is between 0 and 1")
        if self.max_file_size < 0:
            raise ValueError("max_file_size isn't negative")
        if unknown := set(self.ignore_provenance) - PROVENANCES:
            raise ValueError(f"unknown provenance: {sorted(unknown)}")
        if bad := set(self.severity_map.values()) - {"critical", "high", "medium", "low", "info"}:
            raise ValueError(f"unknown severity: {sorted(bad)}")
        if any(not x.get("pattern") for x in self.allow_list):
            raise ValueError("an allow-list entry has no pattern")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regex: * and ? stop at slashes."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[" and (end := pattern.find("]", at + 2)) > 0:
            inner = pattern[at + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("\\", "\\\\") + "]"
            at = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        at += 1
    return rf"\A{out}\z"


def policy_glob(path: Column, pattern: str) -> Column:
    """A pattern with a slash matches the whole path or is part of it; others match the base name."""
    if "/" in pattern:
        return path.rlike(glob_regex(pattern)) | path.contains(pattern)
    return T.base_name(path).rlike(glob_regex(pattern))


def git_glob(path: Column, pattern: str) -> Column:
    """*.ext ends a path, dir/** begins it, **/name ends it; without stars a pattern is part of it."""
    if "*" not in pattern:
        return path.contains(pattern)
    if pattern.startswith("*.") and "*" not in pattern[1:]:
        return path.endswith(pattern[1:])
    if pattern.endswith("/**"):
        return path.startswith(pattern[:-2])
    if pattern.startswith("**/"):
        return path.endswith(pattern[3:])
    return path.contains(pattern.replace("*", ""))


def path_filter(path: Column, include=(), exclude=(), glob=git_glob) -> Column:
    out = ~T.any_of([F.lit(False), *[glob(path, p) for p in exclude]])
    return out & T.any_of(glob(path, p) for p in include) if include else out


def should_scan(files: DataFrame, policy: Policy, size_col: str = "length") -> DataFrame:
    size = F.col(size_col) <= policy.max_file_size if policy.max_file_size else F.lit(True)
    return files.where(size & path_filter(F.col("path"), policy.include_patterns, policy.exclude_patterns, policy_glob))


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines and comments left out."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


def without_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(~T.any_of([F.lit(False), *[policy_glob(F.col("path"), p) for p in patterns]]))


def inline_allowed(line: Column, markers=("siftlake:allow", "siftlake:ignore")) -> Column:
    return T.contains_any(F.lower(line), markers)


def allow_listed(findings: DataFrame, allow: DataFrame, now: Column | None = None, value_col: str = "value") -> DataFrame:
    """findings without those whose value contains an unexpired pattern (pattern, expires_at).

    The pattern is part of the value, so this is a nested loop over the patterns, which are few: more
    than BROADCAST_ROWS are refused.
    """
    live = allow.where(F.col("expires_at").isNull() | (F.col("expires_at") > (now if now is not None else F.current_timestamp()))).select("pattern").distinct()
    if live.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} allow-list patterns")
    return findings.join(F.broadcast(live), F.col(value_col).contains(F.col("pattern")), "left_anti")


def policy_severity(policy: Policy, provenance: Column, detector: Column, confidence: Column) -> Column:
    out = T.severity(confidence)
    for key in (detector, provenance):
        if policy.severity_map:
            out = F.coalesce(F.create_map(*[F.lit(x) for kv in policy.severity_map.items() for x in kv])[key], out)
    return out


def should_report(findings: DataFrame, policy: Policy, now: Column | None = None) -> DataFrame:
    out = findings.where((F.col("confidence") >= policy.min_confidence) & ~F.col("provenance").isin(*policy.ignore_provenance))
    if policy.allow_list:
        rows = [(x["pattern"], x.get("expires_at")) for x in policy.allow_list]
        allow = findings.sparkSession.createDataFrame(rows, "pattern string, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
        out = allow_listed(out, allow, now)
    return out.withColumn("severity", policy_severity(policy, F.col("provenance"), F.col("detector"), F.col("confidence")))


def with_fingerprint(findings: DataFrame, value_col: str = "value") -> DataFrame:
    return findings.withColumn("fingerprint", T.fingerprint(F.col("path"), F.col("line_no"), F.col("detector"), F.col(value_col)))


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint", F.col("path").alias("file"), F.col("line_no").alias("line"), "detector").dropDuplicates(["fingerprint"])


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def baseline_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fingerprint, change): added, removed or kept."""
    a, b = old.select("fingerprint").distinct().withColumn("o", F.lit(1)), new.select("fingerprint").distinct().withColumn("n", F.lit(1))
    return a.join(b, "fingerprint", "full").select("fingerprint", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept").alias("change"))


def earliest(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One finding of each key, the earliest; ties by path and line."""
    w = Window.partitionBy(*keys).orderBy(F.col(order), "path", "line_no")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_mode(findings: DataFrame, mode: str = "default") -> DataFrame:
    shown = {"raw": F.col("is_secret") | (F.col("verdict") == "NEEDS_VERIFICATION"), "verify": F.col("verdict") == "CONFIRMED"}
    return findings.where(shown.get(mode, F.col("is_secret")))


def ui_filter(findings: DataFrame, severity: str | None = None, provenance: str | None = None, text: str | None = None) -> DataFrame:
    out = findings.where(F.col("severity") == severity) if severity else findings
    out = out.where(F.col("provenance") == provenance) if provenance else out
    return out.where(F.lower(F.concat_ws(" ", "path", "var_name", "value", "detector")).contains(text.lower())) if text else out


def page(rows: DataFrame, number: int, order: list, size: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sort_by(rows: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """rows by a field, strings without regard to case; ties keep an order by all columns."""
    kind = dict(rows.dtypes)[field]
    key = F.lower(field) if kind == "string" else F.col(field)
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *plain)
