"""Service operations as plain functions; no HTTP."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import post, rules
from siftlake.plans import pipeline

VERSION = "1.0.0"


def files_of(spark: SparkSession, contents: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def classify_one(spark: SparkSession, value: str, var_name: str, path: str = "input.py", line: str | None = None) -> dict:
    row = [(path, 1, line if line is not None else f'{var_name} = "{value}"', var_name, value)]
    t = rules.classify(spark.createDataFrame(row, "path string, line_no int, line string, var_name string, value string"))
    return t.select("provenance", "confidence", "morphology", "role", "signals").first().asDict(True)


def scan_content(spark: SparkSession, content: str, name: str = "stdin", threshold: float = 0.3, deep: bool = False) -> DataFrame:
    files = files_of(spark, {name: content})
    return pipeline.scan(files, 0.0, "raw") if deep else pipeline.engine_scan(files, threshold)


def extract_tokens(spark: SparkSession, content: str, name: str = "stdin.txt", deep: bool = False) -> DataFrame:
    """Redacted candidates of a content, with the heuristic ones if deep."""
    t = pipeline.candidates(files_of(spark, {name or "stdin.txt": content}), deep)
    return t.select(T.redact(t["value"]).alias("value"), "var_name", "line_no", "line")


Detector = Callable[[DataFrame], DataFrame]
_detectors: dict[str, tuple[list[str], Detector]] = {}
_checks: dict[str, Callable[[], str]] = {}


def register_detector(name: str, keywords: list[str], scan: Detector) -> None:
    """scan takes chunks (source, file, link, data) and returns results (detector, raw, redacted,
    verified, source_file, source_line, link, extra). Only chunks with one of the keywords reach it."""
    _detectors[name] = keywords, scan


def run_detectors(chunks: DataFrame, names: list[str] | None = None) -> DataFrame:
    out = []
    for name, (keywords, scan) in _detectors.items():
        if names is None or name in names:
            some = chunks.where(T.contains_any(F.lower("data"), [k.lower() for k in keywords])) if keywords else chunks
            out.append(scan(some))
    if not out:
        raise KeyError("no such detector")
    return reduce(DataFrame.unionByName, out)


def classification_detector(chunks: DataFrame, suppress_below: float = 0.1) -> DataFrame:
    """Candidates of chunks by classification; a chunk's file is its source where it names none."""
    name = F.coalesce(F.nullif("file", F.lit("")), "source")
    files = chunks.select(name.alias("path"), F.col("data").alias("content"))
    t = rules.classify(pipeline.candidates(files))
    t = t.where(t["provenance"].isin(*rules.FINDING_PROVENANCES) & (t["confidence"] >= suppress_below))
    t = t.join(chunks.select(name.alias("path"), "link").dropDuplicates(["path"]), "path", "left")
    p, c = F.col("provenance"), F.col("confidence")
    extra = F.create_map(F.lit("provenance"), p, F.lit("confidence"), F.format_string("%.4f", c), F.lit("var_name"), F.col("var_name"), F.lit("reasoning"), rules.reasoning(F.col("signals")))
    verified = (p == "AUTH_CREDENTIAL") & (c >= 0.8)
    return t.select(F.concat(F.lit("classification:"), F.lower(p)).alias("detector"), F.col("value").alias("raw"), T.redact(F.col("value"), "detector").alias("redacted"), verified.alias("verified"), F.col("path").alias("source_file"), F.col("line_no").alias("source_line"), "link", extra.alias("extra"))


register_detector("classification", [], classification_detector)


def register_health_check(name: str, check: Callable[[], str]) -> None:
    """check returns a status, healthy if all is well; one that raises is unhealthy."""
    _checks[name] = check


def health() -> dict:
    found = {}
    for name, check in _checks.items():
        try:
            found[name] = check()
        except Exception as e:  # a check's failure is its result
            found[name] = f"unhealthy: {e}"
    return {"status": "healthy" if all(s == "healthy" for s in found.values()) else "degraded", "version": VERSION, "checks": found}


def cached_verifications(secrets: DataFrame, cache: DataFrame, now, ttl_seconds: int = 3600, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of secrets (value) in a cache (hash, status, at). Entries older than the time to
    live, and all but the `most` latest, don't count."""
    live = cache.where(F.col("at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    live = live.groupBy("hash").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at")).orderBy(F.desc("at"), "hash").limit(most)
    keyed = secrets.withColumn("hash", F.sha2("value", 256))
    return keyed.join(live, "hash"), keyed.join(live, "hash", "left_anti")


def verify(spark: SparkSession, content: str, name: str, **org) -> DataFrame:
    """The context agent's verdict on all candidates, with the full false-positive signals."""
    t = pipeline.analyzed(files_of(spark, {name: content}), variant="full", filtered=False, **org)
    return t.withColumn("verified", t["verdict"] == "LIKELY_TRUE_POSITIVE")


def validate_policy(text: str) -> list[str]:
    try:
        post.Policy.from_json(text)
    except (ValueError, TypeError) as e:
        return [str(e)]
    return []


def new_api_key(kind: str = "live", secret: bytes = b"") -> str:
    """A key of a kind, random part and 4-byte HMAC checksum."""
    body = base64.urlsafe_b64encode(secrets.token_bytes(24)).decode().rstrip("=")
    check = hmac.new(secret, f"{kind}_{body}".encode(), hashlib.sha256).hexdigest()[:8]
    return f"sl_{kind}_{body}_{check}"


def valid_api_key(key: str, secret: bytes = b"") -> bool:
    head, _, check = key.rpartition("_")
    return head.startswith("sl_") and hmac.compare_digest(hmac.new(secret, head[3:].encode(), hashlib.sha256).hexdigest()[:8], check)


def key_hash(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()
