"""Streaming scans: files as they arrive, findings and progress out, deduplication and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """(path, content) of text files as they arrive under root, at most per_trigger a batch."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def scan_stream(files: DataFrame, out: str, checkpoint: str, threshold: float = 0.3, available_now: bool = True) -> StreamingQuery:
    """Scan each batch and append findings and a progress row; a batch that runs again replaces itself."""
    from siftlake.plans.pipeline import scan

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        found = scan(df, threshold=threshold).drop("value", "line").persist()
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/findings/batch_id={number}")
        progress = found.agg(F.count(F.lit(1)).alias("findings"), F.lit(number).alias("batch"), F.lit(df.count()).alias("files"))
        progress.coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch_id={number}")
        found.unpersist()
        df.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedup_stream(findings: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first finding of each key; state goes once the watermark has passed."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def trend_stream(events: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "2 days", by: str = "event_type") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def token_bucket(times: list[float], rate: float, burst: float, state: tuple[float, float] | None) -> tuple[list[bool], tuple[float, float]]:
    """Whether each request, by rising time in seconds, is let through; and (tokens, last time)."""
    tokens, last = state if state else (burst, times[0] if times else 0.0)
    out = []
    for t in times:
        tokens = min(burst, tokens + max(0.0, t - last) * rate)
        last = max(last, t)
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out, (tokens, last)


def rate_limit(requests: DataFrame, rate: float = 10.0, burst: float = 20.0, key: str = "service", ts: str = "ts") -> DataFrame:
    """requests (key, ts) with allowed, by one token bucket a key held in state."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        times = (rows[ts] - pd.Timestamp("1970-01-01")).dt.total_seconds().tolist()
        allowed, new = token_bucket(times, rate, burst, state.get if state.exists else None)
        state.update(new)
        yield pd.DataFrame({key: name[0], ts: rows[ts], "allowed": allowed})

    return requests.groupBy(key).applyInPandasWithState(run, f"{key} string, {ts} timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
