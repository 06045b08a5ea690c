"""Reports: JSON, text, SARIF and JUnit documents, baselines, audit logs and metrics.

A document is a DataFrame of its lines, so it may be of any length: lines() writes one file, in order, in
one task that holds a line at a time. as_text() is the document as a string, for small ones.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import analytics
from siftlake.sources import sinks
from siftlake.sources.store import cut

VERSION = "1.0.0"
#: Lines of a document that as_text() takes to the driver.
MOST = 1_000_000


def by_confidence(findings: DataFrame) -> list[Column]:
    """The order of reports: the most confident first, then by place."""
    return [F.desc("confidence"), F.col("path"), F.col("line_no")]


def document(body: DataFrame, order: list[Column], head: str, tail: str, comma: bool = False) -> DataFrame:
    """(part, at, value): head, the lines of body (column value) in order, and tail. With `comma`, lines
    but the first have one in front."""
    spark = body.sparkSession
    # a range-partitioned sort numbers the lines, once; no window takes all of them to a task
    rows = cut(body.orderBy(*order).select("value", F.monotonically_increasing_id().alias("at")))
    first = rows.limit(1).select(F.col("at").alias("least"))
    if comma:
        rows = rows.join(F.broadcast(first), F.col("at") == F.col("least"), "left").select("at", F.when(F.col("least").isNull(), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    edge = lambda part, value: spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(value).alias("value"))
    return edge(0, head).unionByName(rows.select(F.lit(1).alias("part"), "at", "value")).unionByName(edge(2, tail))


def lines(doc: DataFrame, path: str) -> None:
    doc.orderBy("part", "at").select("value").coalesce(1).write.text(path)


def as_text(doc: DataFrame) -> str:
    got = doc.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"more than {MOST} lines: write the document with lines()")
    return "\n".join(r.value for r in sorted(got, key=lambda r: (r.part, r.at)))


def _object(**fields) -> str:
    return json.dumps(fields)[:-1]


def engine_json(findings: DataFrame, tool: str = "siftlake") -> DataFrame:
    head = _object(tool=tool, version=VERSION, engine="classification", total=findings.count()) + ', "findings": ['
    return document(_rows(findings, _finding()), by_confidence(findings), head, "]}", True)


def _rows(findings: DataFrame, fields: Column) -> DataFrame:
    return findings.select("confidence", "path", "line_no", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def _finding() -> Column:
    return F.struct(
        F.col("path").alias("file"), F.col("line_no").alias("line"), T.redact(F.col("value")).alias("matched_value"), "detector",
        F.round("confidence", 4).alias("confidence"), "provenance", T.severity(F.col("confidence")).alias("severity"),
        T.fingerprint(F.col("path"), F.col("line_no"), F.col("detector"), F.col("value")).alias("fingerprint"), "signals",
    )


def cli_json(findings: DataFrame, candidates: int, suppressed: int, mode: str = "default", seconds: float = 0.0, level: int = 100, tool: str = "siftlake") -> DataFrame:
    """The scan's report: findings with verdicts, signals and evidence, and what was looked at."""
    head = _object(tool=tool, version=VERSION, engine="classification and context", mode=mode, total_findings=findings.count(), candidates_evaluated=candidates, suppressed_unverified=suppressed, scan_time=f"{seconds:.3f}s") + ', "findings": ['
    fields = F.struct(
        F.col("path").alias("file"), F.col("line_no").alias("line"), F.lit(f"{tool}:classification").alias("detector"),
        F.coalesce(F.get("evidence", F.lit(0))["type"], F.lit("")).alias("description"), T.redact_level(F.col("value"), level).alias("matched_value"),
        F.round("confidence", 4).alias("confidence"), "provenance", "verdict", F.col("risk").alias("risk_level"), F.col("alert").alias("should_alert"), F.col("block").alias("should_block"), "signals", "evidence",
    )
    return document(_rows(findings, fields), by_confidence(findings), head, "]}", True)


def _bar(confidence: Column) -> Column:
    filled = F.least(F.floor(confidence * 10 + F.lit(1e-9)).cast("int"), F.lit(10))
    return F.concat(F.lit("  ["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), 10 - filled), F.lit("] "), F.format_string("%.0f%%", confidence * 100))


def text_report(findings: DataFrame, candidates: int, suppressed: int, seconds: float = 0.0, level: int = 100, verified: bool = False) -> DataFrame:
    """A report for people, the most confident first, with a bar and a summary."""
    c = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") == "critical").alias("critical"), F.count_if(F.col("risk") == "high").alias("high")).first()
    if not c.n:
        head = f"No confirmed secrets. ({candidates} candidates evaluated, {suppressed} suppressed as unverified, {seconds:.3f}s)" if candidates else "No secrets detected."
        return document(findings.select("confidence", "path", "line_no", F.lit("").alias("value")), by_confidence(findings), head, "")
    head = f"{c.n} {'verified' if verified else 'confirmed'} secrets (scanned in {seconds:.3f}s)" + (f"\n  ({candidates} candidates evaluated, {suppressed} suppressed as unverified)" if suppressed else "")
    evidence = F.array_join(F.transform("evidence", lambda e: F.format_string("\n    [%s] %.1f", e["type"], e["impact"])), "")
    value = F.concat(
        _bar(F.col("confidence")), F.lit("  "), "verdict", F.lit("  ("), "risk", F.lit(" risk)\n    File: "), "path", F.lit(":"), F.col("line_no").cast("string"),
        F.lit("\n    Value: "), T.redact_level(F.col("value"), level), F.lit("\n    Provenance: "), "provenance", F.when(F.col("block"), "\n    CI/CD: WOULD BLOCK").otherwise(""), F.coalesce(evidence, F.lit("")),
    )
    tail = f"Summary: {c.n} findings ({c.critical} critical, {c.high} high) in {seconds:.3f}s"
    return document(findings.select("confidence", "path", "line_no", value.alias("value")), by_confidence(findings), head, tail)


def git_json(findings: DataFrame, seconds: float = 0.0, tool: str = "siftlake") -> DataFrame:
    """Findings of a history, with their commits."""
    head = _object(tool=tool, version=VERSION, engine="history", scan_type="git_history", total_findings=findings.count(), scan_time=f"{seconds:.3f}s") + ', "findings": ['
    known = lambda c: F.col(c) if c in findings.columns else F.lit("")
    fields = F.struct(
        F.col("path").alias("file"), F.col("line_no").alias("line"), "detector", T.redact(F.col("value")).alias("matched_value"), F.round("confidence", 4).alias("confidence"), "provenance",
        F.col("reasoning").alias("description"), F.col("commit").alias("commit_hash"), known("author").alias("commit_author"), known("date").alias("commit_date"), known("message").alias("commit_message"), known("branch").alias("branch"), "signals",
    )
    return document(_rows(findings, fields), by_confidence(findings), head, "]}", True)


def git_text(findings: DataFrame, seconds: float = 0.0) -> DataFrame:
    n = findings.count()
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in findings.columns else F.lit("")
    value = F.concat(
        _bar(F.col("confidence")), F.lit("  "), "provenance", F.lit("\n    File: "), "path", F.lit(":"), F.col("line_no").cast("string"), F.lit("\n    Value: "), T.redact(F.col("value")),
        F.lit("\n    Commit: "), F.substring("commit", 1, 12), F.lit("\n    Author: "), known("author"), F.lit("\n    Date: "), known("date"), F.lit("\n    Message: "), known("message"),
    )
    head, tail = (f"{n} secrets in git history (scanned in {seconds:.3f}s)", f"Summary: {n} findings in {seconds:.3f}s") if n else ("No secrets detected in git history.", "")
    return document(findings.select("confidence", "path", "line_no", value.alias("value")), by_confidence(findings), head, tail)


def sarif_json(findings: DataFrame, tool: str = "siftlake") -> DataFrame:
    """SARIF of any number of findings: rules are few, results are lines of the document."""
    rules = [{"id": r.detector, "defaultConfiguration": {"level": r.level}} for r in analytics.sarif_rules(findings, ["path", "line_no"]).orderBy("rule_index").collect()]
    driver = json.dumps({"name": tool, "version": VERSION, "rules": rules})
    head = '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": ' + driver + '}, "results": ['
    rows = findings.select("confidence", "path", "line_no", F.to_json(sinks.sarif_result()).alias("value"))
    return document(rows, by_confidence(findings), head, "]}]}", True)


def junit_xml(findings: DataFrame, seconds: float = 0.0, suite: str = "siftlake-scan") -> DataFrame:
    """JUnit: each finding is a failed case of one suite."""
    n = findings.count()
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites>\n  <testsuite name="{suite}" tests="{n}" failures="{n}" time="{seconds:.3f}">'
    return document(sinks.junit_cases(findings, ("confidence", "path", "line_no")), by_confidence(findings), head, "  </testsuite>\n</testsuites>")


def baseline_json(findings: DataFrame, reason: str = "", at: datetime | None = None) -> DataFrame:
    """A baseline: version, time, and one entry for each fingerprint, sorted by it."""
    made = (at or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = _object(version="1.0", created_at=made) + ', "findings": ['
    rows = findings.groupBy("fingerprint").agg(F.min(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line"), "detector")).alias("f"))
    rows = rows.select("fingerprint", F.to_json(F.struct("fingerprint", "f.file", "f.line", "f.detector", F.lit(reason).alias("reason"))).alias("value"))
    return document(rows, [F.col("fingerprint")], head, "]}", True)


def read_baseline(spark, path: str) -> DataFrame:
    """(fingerprint, file, line, detector, reason) of a baseline that lines() wrote."""
    entry = "struct<fingerprint:string, file:string, line:int, detector:string, reason:string>"
    return spark.read.schema(f"version string, findings array<{entry}>").json(path, multiLine=True).select(F.explode("findings").alias("f")).select("f.*")


AUDIT = "ts timestamp, action string, actor string, resource string, outcome string, details map<string,string>"
_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def audit_lines(entries: DataFrame) -> DataFrame:
    """The line that is logged for each entry (AUDIT)."""
    part = lambda c: F.concat(F.lit(f" {c}="), F.col(c))
    return entries.select(F.concat(F.lit("["), F.date_format("ts", _STAMP), F.lit("]"), *[part(c) for c in ("action", "actor", "resource", "outcome")]).alias("value"))


def entries_since(entries: DataFrame, ts) -> DataFrame:
    return entries.where(F.col("ts") >= F.lit(ts).cast("timestamp"))


def audit_export(entries: DataFrame, kind: str) -> DataFrame:
    """All entries by time, as JSON objects or CSV columns."""
    ordered = entries.orderBy("ts", "action", "actor", "resource")
    if kind == "json":
        fields = F.struct(F.date_format("ts", _STAMP).alias("timestamp"), "action", "actor", "resource", "details", "outcome")
        return ordered.select(F.to_json(fields).alias("value"))
    if kind == "csv":
        pairs = F.array_sort(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        return ordered.select(F.date_format("ts", _STAMP).alias("timestamp"), "action", "actor", "resource", "outcome", F.coalesce(F.array_join(pairs, "; "), F.lit("")).alias("details"))
    raise ValueError(f"{kind} isn't json or csv")


def exit_code(findings: DataFrame, fail: bool = True) -> int:
    """1 if a scan that is to fail on findings has any."""
    return int(fail and not findings.isEmpty())
