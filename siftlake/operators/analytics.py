"""Aggregates over stored scans and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["info", "low", "medium", "high", "critical"]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """(dimension, key, n) of several groupings in one pass."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("key")) for c in by]))
    return findings.select(stack.alias("d")).groupBy("d.dimension", "d.key").agg(F.count(F.lit(1)).alias("n"))


def scan_totals(scans: DataFrame) -> DataFrame:
    return scans.agg(F.count(F.lit(1)).alias("scans"), F.coalesce(F.sum("total_findings"), F.lit(0)).alias("findings"), F.avg(F.when(F.col("status") == "completed", F.col("duration"))).alias("avg_duration"))


def hotspots(findings: DataFrame, file_col: str = "file", severity_col: str = "severity", top: int = 10) -> DataFrame:
    """Files by findings, with the worst severity; files of only `info` have none."""
    worst = F.max(severity_rank(F.col(severity_col)))
    names = F.array(F.lit(""), *[F.lit(s) for s in SEVERITIES[1:]])
    out = findings.groupBy(F.col(file_col).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.element_at(names, (worst + 1).cast("int")).alias("severity"))
    return out.orderBy(F.desc("n"), "file").limit(top)


def daily_trend(scans: DataFrame, findings: DataFrame, last_day: Column | str, days: int = 30, scan_ts: str = "started_at", finding_ts: str = "created_at") -> DataFrame:
    """(day, scans, findings) of each of the last days, 0 where there are none."""
    last = F.to_date(F.lit(last_day) if isinstance(last_day, str) else last_day)
    spark = scans.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    of = lambda df, ts, name: df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(of(scans, scan_ts, "scans"), "day", "left").join(of(findings, finding_ts, "findings"), "day", "left").select("day", zero("scans"), zero("findings"))


def recent(scans: DataFrame, n: int = 50, order: str = "started_at") -> DataFrame:
    out = scans.orderBy(F.desc(order), "id")
    return out.limit(n) if n else out


def benchmark_rollup(results: DataFrame) -> DataFrame:
    """results (category, repo, tool, findings, duration_s, memory_kb, timed_out) by category and tool,
    with totals over categories."""
    g = results.groupBy("category", "tool").agg(F.count(F.lit(1)).alias("repos"), F.sum("findings").alias("findings"), F.sum("duration_s").alias("total_s"), F.max("duration_s").alias("max_s"), F.max("memory_kb").alias("max_kb"), F.count_if("timed_out").alias("timeouts"))
    whole = results.groupBy("tool").agg(F.count(F.lit(1)).alias("repos"), F.sum("findings").alias("findings"), F.sum("duration_s").alias("total_s"), F.max("duration_s").alias("max_s"), F.max("memory_kb").alias("max_kb"), F.count_if("timed_out").alias("timeouts"))
    return g.unionByName(whole.withColumn("category", F.lit("all"))).withColumn("avg_s", F.col("total_s") / F.col("repos"))


def by_tool(results: DataFrame, tools: list[str]) -> DataFrame:
    """One row per repository, the tools side by side."""
    return results.groupBy("category", "repo").pivot("tool", tools).agg(F.first("findings").alias("findings"), F.first("duration_s").alias("duration_s"))


def sarif_rules(findings: DataFrame, order: list[str]) -> DataFrame:
    """(rule_index, detector, level, provenance) by first appearance; level and provenance of the first."""
    from siftlake.functions.text import sarif_level

    at = F.struct(*order)
    first = findings.groupBy("detector").agg(F.min(at).alias("at"), F.min_by(F.struct("confidence", "provenance"), at).alias("f"))
    index = F.row_number().over(Window.orderBy("at")) - 1
    return first.select(index.alias("rule_index"), "detector", sarif_level(F.col("f.confidence")).alias("level"), F.col("f.provenance").alias("provenance"))


def run_summary(findings: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(c >= 0.9).alias("critical"), F.count_if((c >= 0.7) & (c < 0.9)).alias("high"), F.count_if(F.col("provenance") == "AUTH_CREDENTIAL").alias("auth"), F.count_if(F.col("provenance") == "UNCERTAIN").alias("uncertain"))


def health(checks: DataFrame) -> DataFrame:
    """One row: healthy if all checks (name, status) are, else degraded."""
    return checks.agg(F.when(F.coalesce(F.bool_and(F.col("status") == "healthy"), F.lit(True)), "healthy").otherwise("degraded").alias("status"))


def dataset_balance(samples: DataFrame) -> DataFrame:
    g = samples.groupBy("source").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return g.withColumn("ratio", F.col("positives") / F.greatest(F.col("negatives"), F.lit(1)))


def scan_metrics(files: DataFrame, candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files scanned and skipped (scanned boolean), bytes, tokens, findings, and findings by
    provenance and severity as maps. Only counts meet."""
    f = files.agg(F.count_if("scanned").alias("files_scanned"), F.count_if(~F.col("scanned")).alias("files_skipped"), F.coalesce(F.sum(F.when(F.col("scanned"), F.col("length"))), F.lit(0)).alias("bytes_processed"))
    c = candidates.agg(F.count(F.lit(1)).alias("tokens_extracted"))
    by = lambda d: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("key", "n")))))
    g = counts(findings, ["provenance", "severity"]).agg(F.coalesce(F.sum(F.when(F.col("dimension") == "provenance", F.col("n"))), F.lit(0)).alias("findings_total"), by("provenance").alias("by_provenance"), by("severity").alias("by_severity"))
    return f.crossJoin(c).crossJoin(g)


def scan_counters(analyzed: DataFrame) -> DataFrame:
    """One row: candidates looked at, suppressed among them, and found secrets."""
    suppressed = F.col("verdict").isin("SUPPRESSED", "LIKELY_FALSE_POSITIVE")
    return analyzed.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(suppressed).alias("suppressed"), F.count_if("is_secret").alias("found"))


def metric_totals(metrics: DataFrame) -> DataFrame:
    """(name, total): metrics (name, labels, value) summed over their labels."""
    return metrics.groupBy("name").agg(F.sum("value").alias("total"))


def bars(counted: DataFrame, top: int = 0) -> DataFrame:
    """(key, n, share): the largest first, each with its share of the total."""
    whole = counted.agg(F.sum("n")).first()[0] or 0
    out = counted.select("key", "n", F.round(F.col("n") / F.lit(max(whole, 1)), 4).alias("share")).orderBy(F.desc("n"), "key")
    return out.limit(top) if top else out


def duration_text(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s, 3.4s or 120ms."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))
    )
