"""Readers of labelled corpora, JSON lines and benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "path string, line_no int, label int"


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are left out."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def _entries(spark: SparkSession, path: str, name: str, line: bool) -> DataFrame:
    entry = "struct<file:string, line:int>" if line else "struct<file:string>"
    rows = spark.read.schema(f"{name} array<{entry}>").json(path, multiLine=True)
    return rows.select(F.explode_outer(name).alias("e")).where("e is not null").select("e.*")


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Truth of a corpus of true_positives (file, line) and true_negatives (file): the lines of the
    former are positive; a file of the latter has null lines and label 0."""
    yes = _entries(spark, path, "true_positives", True).where("line is not null").select(F.col("file").alias("path"), F.col("line").alias("line_no"), F.lit(1).alias("label"))
    no = _entries(spark, path, "true_negatives", False).select(F.col("file").alias("path"), F.lit(None).cast("int").alias("line_no"), F.lit(0).alias("label"))
    return yes.unionByName(no).distinct()


def scale_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth of a corpus of secrets and fp_traps (file, line; 1 by default), and tn_files."""
    yes = _entries(spark, path, "secrets", True).where("line is not null").withColumn("label", F.lit(1))
    no = _entries(spark, path, "fp_traps", True).withColumns({"line": F.coalesce("line", F.lit(1)), "label": F.lit(0)})
    files = spark.read.schema("tn_files array<string>").json(path, multiLine=True).select(F.explode_outer("tn_files").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(0).alias("label"))
    rows = yes.unionByName(no).unionByName(files.where("file is not null"))
    return rows.select(F.col("file").alias("path"), F.col("line").alias("line_no"), "label").distinct()


def benchmark_results(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(category, repo, tool, findings, duration_s, memory_kb, timed_out) of a tool's results, from JSON
    (one object, or one a line) or CSV with a header."""
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
    else:
        raw = spark.read.option("primitivesAsString", True).json(path, multiLine=not path.endswith(".jsonl"))
    get = lambda name, kind: (F.col(name) if name in raw.columns else F.lit(None)).cast(kind)
    return raw.select(
        F.coalesce(get("category", "string"), F.lit("none")).alias("category"), get("repo", "string").alias("repo"), F.lit(tool).alias("tool"),
        F.coalesce(get("findings", "long"), F.lit(0)).alias("findings"), F.coalesce(get("duration_s", "double"), F.lit(0.0)).alias("duration_s"),
        F.coalesce(get("memory_kb", "long"), F.lit(0)).alias("memory_kb"), F.coalesce(get("timed_out", "boolean"), F.lit(False)).alias("timed_out"),
    )


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """Training samples or usage records, one JSON object a line."""
    rows.write.mode("append" if append else "errorifexists").json(path)
