"""Storage: lineage cut by checkpoints, and a store of scans and findings in Parquet."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir, or to a temporary folder where a local session names none."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftlake-"))
    return df.checkpoint(eager=True)


class ScanStore:
    """Scans (id, kind, target, status, started_at, ...) and findings (scan_id, ...) as Parquet tables
    that are partitioned by the scan, so a scan is replaced or deleted without reading the others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def save_scan(self, scan: DataFrame) -> None:
        """Insert scans, or replace those of the same id."""
        rows = scan.withColumn("scan", F.col("id").cast("string"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan").parquet(f"{self.root}/scans")

    def save_findings(self, scan_id: str, findings: DataFrame) -> None:
        """Append findings of a scan; those without created_at get the time of now."""
        made = F.coalesce("created_at", F.current_timestamp()) if "created_at" in findings.columns else F.current_timestamp()
        rows = findings.withColumns({"scan_id": F.lit(scan_id), "created_at": made, "scan": F.lit(scan_id)})
        rows.write.mode("append").partitionBy("scan").parquet(f"{self.root}/findings")

    def scans(self, limit: int = 50) -> DataFrame:
        """The latest scans; all of them if limit is 0."""
        from siftlake.operators.analytics import recent

        return recent(self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/scans").drop("scan"), limit)

    def scan(self, scan_id: str) -> dict:
        row = self.scans(0).where(F.col("id") == scan_id).first() if self._has(f"scans/scan={scan_id}") else None
        if row is None:
            raise KeyError(f"there is no scan {scan_id}")
        return row.asDict(True)

    def all_findings(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/findings")

    def findings(self, scan_id: str) -> DataFrame:
        """Findings of a scan; only its folder is read."""
        return self.all_findings().where(F.col("scan") == scan_id).drop("scan")

    def delete(self, scan_id: str) -> None:
        """Delete a scan and its findings."""
        if not self._has(f"scans/scan={scan_id}"):
            raise KeyError(f"there is no scan {scan_id}")
        for name in ("scans", "findings"):
            path, fs = self._path(f"{name}/scan={scan_id}")
            fs.delete(path, True)

    def dashboard(self) -> dict:
        """Totals, counts by severity and provenance, the files with most findings, the latest scans."""
        from siftlake.operators import analytics

        found, scans = self.all_findings(), self.scans(0)
        counts = analytics.counts(found, ["severity", "provenance"]).collect()
        return {
            "totals": analytics.scan_totals(scans).first().asDict(),
            "counts": {d: {r.key: r.n for r in counts if r.dimension == d} for d in ("severity", "provenance")},
            "hotspots": [r.asDict() for r in analytics.hotspots(found, "path").collect()],
            "recent": [r.asDict(True) for r in self.scans(10).collect()],
        }


def history_filter(scans: DataFrame, kind: str | None = None, text: str | None = None) -> DataFrame:
    """Scans of a kind whose id, target or status has the text, in any case."""
    out = scans.where(F.col("kind") == kind) if kind else scans
    return out.where(F.lower(F.concat_ws(" ", "id", "target", "status")).contains(text.lower())) if text else out
