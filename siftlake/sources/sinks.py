"""Sinks: JSON, CSV, SARIF, JUnit, annotations, Prometheus, and stores keyed by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T


def json_rows(findings: DataFrame) -> DataFrame:
    """One redacted JSON object per finding; write it as text, or wrap it with report_json()."""
    return findings.select(
        F.to_json(
            F.struct(
                F.col("path").alias("file"), F.col("line_no").alias("line"), T.redact(F.col("value")).alias("matched_value"), "detector",
                F.round("confidence", 4).alias("confidence"), "provenance", "signals", T.severity(F.col("confidence")).alias("severity"),
            )
        ).alias("value")
    )


def report_json(findings: DataFrame, tool: str = "siftlake", version: str = "1.0.0", most: int = 100_000) -> str:
    """One JSON report on the driver; over `most` findings are refused, write json_rows() instead."""
    import json

    rows = [json.loads(r.value) for r in json_rows(findings).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} findings: write json_rows() as text files")
    return json.dumps({"tool": tool, "version": version, "total": len(rows), "findings": rows})


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.select("path", "line_no", "detector", F.format_string("%.4f", "confidence").alias("confidence"), "provenance", T.severity(F.col("confidence")).alias("severity"), T.redact(F.col("value")).alias("matched_value"))


def sarif_result() -> Column:
    """A SARIF result: rule, level, kind, message, location and fingerprint."""
    kind = F.when(F.col("provenance") == "AUTH_CREDENTIAL", "open").when(F.col("provenance") == "UNCERTAIN", "review").otherwise("pass")
    uri = F.replace(F.replace(F.url_encode("path"), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line_no", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("detector").alias("ruleId"), T.sarif_level(F.col("confidence")).alias("level"), kind.alias("kind"),
        F.struct(F.concat(F.col("detector"), F.lit(" "), T.redact(F.col("value"))).alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(T.fingerprint(F.col("path"), F.col("line_no"), F.col("detector"), F.col("value")).alias("primary")).alias("fingerprints"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    return findings.select(sarif_result().alias("result"))


def sarif(findings: DataFrame, tool: str = "siftlake", version: str = "1.0.0", most: int = 100_000) -> str:
    import json

    rows = [json.loads(r[0]) for r in sarif_results(findings).select(F.to_json("result")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} findings for one SARIF file")
    rules = list({r["ruleId"]: {"id": r["ruleId"], "defaultConfiguration": {"level": r["level"]}} for r in reversed(rows)}.values())[::-1]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": rows}]})


def _xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def junit_cases(findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One failed case per finding, named by its place, its class the detector."""
    share = lambda n: F.format_string(f"%.{n}f%%", F.col("confidence") * 100)
    place = F.concat("path", F.lit(":"), F.col("line_no").cast("string"))
    message = F.concat(F.lit("Secret found: "), "provenance", F.lit(" ("), share(0), F.lit(" confidence)"))
    content = F.concat(F.lit("File: "), "path", F.lit("\nLine: "), F.col("line_no").cast("string"), F.lit("\nDetector: "), "detector", F.lit("\nConfidence: "), share(1), F.lit("\nValue: "), T.redact(F.col("value")))
    if "reasoning" in findings.columns:
        content = F.concat(content, F.lit("\nDescription: "), F.coalesce("reasoning", F.lit("")))
    case = F.concat(F.lit('<testcase name="'), _xml(place), F.lit('" classname="'), _xml(F.col("detector")), F.lit('" time="0"><failure message="'), _xml(message), F.lit('" type="'), _xml(F.col("provenance")), F.lit('">'), _xml(content), F.lit("</failure></testcase>"))
    return findings.select(*keep, case.alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("confidence") >= 0.9, "error").otherwise("warning")
    return findings.select(F.concat(F.lit("::"), level, F.lit(" file="), F.col("path"), F.lit(",line="), F.col("line_no").cast("string"), F.lit("::"), F.col("detector"), F.lit(" ("), F.col("provenance"), F.lit(")")).alias("value"))


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """One exposition line per metric (name, labels, value)."""
    return metrics.select(F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), F.col("labels"), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("value"))


def upsert(store: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """store with rows in place of those of the same key; write the result to a new path."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_scan(scans: DataFrame, findings: DataFrame, scan_id: str) -> tuple[DataFrame, DataFrame]:
    return scans.where(F.col("id") != scan_id), findings.where(F.col("scan_id") != scan_id)
