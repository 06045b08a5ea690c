"""Sources: directories, tables as files, archives, unified diffs, git history."""

from __future__ import annotations

import gzip
import io
import subprocess
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V

ARCHIVES = (".zip", ".jar", ".war", ".apk", ".tar", ".tar.gz", ".tgz", ".gz")
MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL = 10_000, 1 << 20, 10 << 20


def is_archive(path: Column) -> Column:
    return T.any_of(F.lower(path).endswith(e) for e in ARCHIVES)


def definitely_safe(path: Column) -> Column:
    """Files that are never scanned: lock files, binaries, generated code."""
    name = T.base_name(path)
    low = F.lower(name)
    ends = T.any_of([*[name.endswith(e) for e in (".min.js", ".min.css", ".d.ts")], *[low.endswith(e) for e in (".generated.go", ".generated.ts", "_generated.go", "_generated.rs", ".pb.go", "_pb2.py")]])
    return low.isin(*V.LOCK_FILES) | F.regexp_extract(low, r"(\.[^.]*)\z", 1).isin(*V.SKIPPED_EXTENSIONS) | ends


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def engine_scannable(files: DataFrame) -> DataFrame:
    """The narrow walk: no dot folders, archives let through, 1 to 1,000,000 bytes, no build artifacts."""
    from siftlake.operators.signals import file_provenance

    path, size = F.col("path"), F.col("length")
    pruned = F.exists(_dirs(path), lambda d: d.isin(*V.ENGINE_SKIPPED_DIRS) | d.rlike(r"\A\.[^.]"))
    fits = F.when(is_archive(path), size <= MAX_TOTAL).otherwise((size <= 1_000_000) & ~definitely_safe(path))
    return files.where(~pruned & (size > 0) & fits & (file_provenance(path)["value"] != "build_artifact"))


def scannable(files: DataFrame) -> DataFrame:
    """The scan's walk: dot folders stay; bundles, static sites, generated docs and large data go."""
    path, size = F.col("path"), F.col("length")
    dirs, name = _dirs(path), F.lower(T.base_name(path))
    pruned = F.exists(dirs, lambda d: d.isin(*V.SCAN_SKIPPED_DIRS) | T.any_of(d.endswith(s) for s in V.BUNDLE_SUFFIXES))
    static = path.rlike(r"(?:\A|/)(?:website|site|docs|doc)/(?:public|static)/")
    config = T.contains_any(name, ["config", "secret", "credential", ".env", "package"])
    data = (size > 200_000) & T.any_of(name.endswith(e) for e in (".json", ".xml", ".csv", ".html")) & ~config
    bare = ~name.contains(".") & (size > 100_000)
    kept = files.where(~pruned & ~static & ~definitely_safe(path) & size.between(1, 1_000_000) & ~data & ~bare)
    return without_generated_docs(files, kept)


def without_generated_docs(files: DataFrame, kept: DataFrame) -> DataFrame:
    """kept without files under a doc-like folder that holds a marker of a documentation generator."""
    folder = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    marked = files.where(T.base_name(F.col("path")).isin(*V.DOC_MARKERS)).select(folder.alias("marked"))
    marked = marked.where(F.col("marked").rlike(r"(?i)(?:\A|/)[^/]*(?:doc|api|reference|manual|site|html)[^/]*(?:/[^/]*)?\z|(?:\A|/)\d+(?:\.\d+){1,2}\z")).distinct()
    above = kept.withColumn("above", F.transform(F.sequence(F.lit(1), F.greatest(F.size(_dirs(F.col("path"))), F.lit(1))), lambda n: F.array_join(F.slice(_dirs(F.col("path")), F.lit(1), n), "/")))
    hit = above.select("path", F.explode("above").alias("marked")).join(marked, "marked", "left_semi").select("path").distinct()
    return kept.join(hit, "path", "left_anti")


def read_directory(spark: SparkSession, root: str, max_bytes: int = 10_000_000) -> DataFrame:
    """(path, length, data) of all files under root; the size filter reaches the file listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.col("length") <= max_bytes).select("path", "length", F.col("content").alias("data"))


def relative(files: DataFrame, root: str) -> DataFrame:
    """files with paths from root on."""
    base = root.rstrip("/").removeprefix("file:")
    return files.withColumn("path", F.regexp_extract("path", rf"(?:\A|:/*|(?<=/))\Q{base.lstrip('/')}\E/(.*)\z", 1))


def contents(files: DataFrame) -> DataFrame:
    """(path, content) of plain files and of archives' members."""
    plain = files.where(~is_archive(F.col("path"))).select("path", "data")
    return as_text(plain.unionByName(explode_archives(files.where(is_archive(F.col("path"))).select("path", "data"))))


def as_text(files: DataFrame) -> DataFrame:
    """(path, content) of files (path, data): UTF-16 by its mark, else UTF-8; binary files left out."""
    from siftlake.operators.decode import utf16

    wide = utf16(F.col("data"))
    binary = F.hex(F.substring("data", 1, 512)).rlike(r"\A(?:..)*?00")
    return files.where(wide.isNotNull() | ~binary).select("path", F.coalesce(wide, F.make_valid_utf8(F.col("data").cast("string"))).alias("content"))


def table_as_files(docs: DataFrame, path: Column, content: str = "text") -> DataFrame:
    return docs.select(path.alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(virtual path, bytes) of an archive's members within the limits; a broken archive gives none."""
    low, total = name.lower(), 0
    try:
        if low.endswith((".zip", ".jar", ".war", ".apk")):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist()[:MAX_MEMBERS]:
                    if info.is_dir() or ".." in info.filename or info.file_size > MAX_MEMBER:
                        continue
                    body = z.read(info)
                    if (total := total + len(body)) > MAX_TOTAL:
                        return
                    if b"\0" not in body[:512]:
                        yield f"{name}:{info.filename}", body
        elif low.endswith((".tar", ".tar.gz", ".tgz")):
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for k, info in enumerate(t):
                    if k >= MAX_MEMBERS:
                        return
                    if not info.isfile() or ".." in info.name or info.size > MAX_MEMBER:
                        continue
                    body = t.extractfile(info).read()
                    if (total := total + len(body)) > MAX_TOTAL:
                        return
                    if b"\0" not in body[:512]:
                        yield f"{name}:{info.name}", body
        elif low.endswith(".gz"):
            with gzip.open(io.BytesIO(data)) as g:
                body = g.read(MAX_MEMBER + 1)
            if len(body) <= MAX_MEMBER and b"\0" not in body[:512]:
                yield f"{name}:{name.rsplit('/', 1)[-1][:-3]}", body
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError, ValueError):
        return


def explode_archives(files: DataFrame) -> DataFrame:
    """(path, data) of the members of archives (path, data), at most 10 MiB each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["data"]):
                rows = list(members(name, bytes(data))) if data is not None else []
                yield pd.DataFrame(rows, columns=["path", "data"])

    few = files.where(is_archive(F.col("path")) & (F.octet_length("data") <= MAX_TOTAL)).select("path", "data")
    return few.mapInPandas(run, "path string, data binary")


def diff_lines(diffs: DataFrame, diff_col: str = "diff", key: str = "commit") -> DataFrame:
    """(key, path, number, content): added lines of unified diffs with their new line numbers.

    Headers and hunks run on by window: a line belongs to the last header and the last hunk above it,
    and its number is the hunk's start plus the lines of the new file in between.
    """
    rows = diffs.select(key, F.posexplode(F.split(diff_col, "\r?\n", -1)).alias("n", "l"))
    l = F.col("l")
    head = F.when(l.startswith("diff --git ") | l.startswith("Binary files "), F.lit("")).when(l.startswith("+++ "), F.regexp_replace(F.substring(l, F.lit(5), F.length(l)), r"\Ab/", ""))
    hunk = l.startswith("@@ ")
    w = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumns({"path": F.last(head, True).over(w), "section": F.last(F.when(head.isNotNull() | hunk, F.col("n")), True).over(w), "is_hunk": hunk})
    start = F.greatest(F.coalesce(F.regexp_extract(l, r"\+(\d+)", 1).try_cast("int"), F.lit(1)), F.lit(1))
    s = Window.partitionBy(key, "section").orderBy("n")
    rows = rows.withColumns({"start": F.first(F.when(hunk, start)).over(s)})
    skipped = l.startswith("--- ") | hunk
    steps = F.when(skipped | (l.startswith("-")), 0).otherwise(1)
    before = F.sum(steps).over(s.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("number", (F.col("start") + F.coalesce(before, F.lit(0))).cast("int"))
    added = F.col("start").isNotNull() & l.startswith("+") & ~l.startswith("+++ ") & (F.col("path") != "") & (F.col("path") != "/dev/null")
    return rows.where(added).select(key, "path", "number", F.substring(l, F.lit(2), F.length(l)).alias("content"))


def git_log(spark: SparkSession, repo: str, branch: str | None = None, since: str | None = None, most: int | None = None) -> DataFrame:
    """(commit, author, email, date, message) of a repository on the driver."""
    cmd = ["git", "-C", repo, "log", "--format=%H%x1f%an%x1f%ae%x1f%aI%x1f%s", branch or "--all"]
    cmd += [f"--since={since}"] * bool(since) + [f"--max-count={most}"] * bool(most)
    out = subprocess.run(cmd, capture_output=True, text=True, check=True).stdout
    rows = [tuple(x.split("\x1f", 4)) for x in out.splitlines() if x.count("\x1f") >= 4]
    return spark.createDataFrame(rows, "commit string, author string, email string, date string, message string").withColumn("date", F.to_timestamp("date"))


def git_diffs(commits: DataFrame, repo: str, most_bytes: int = 1 << 20) -> DataFrame:
    """commits with diff; the repository lies on every executor; diffs over most_bytes are left out."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in commits.schema)}, diff string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            diffs = [subprocess.run(["git", "-C", repo, "show", "--format=", "-p", c], capture_output=True).stdout for c in pdf["commit"]]
            pdf = pdf.assign(diff=[d.decode("utf-8", "replace") if len(d) <= most_bytes else None for d in diffs])
            yield pdf[pdf["diff"].notna()]

    return commits.mapInPandas(run, schema)


def training_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled files as (path, line, label) from JSON with files[].secrets[]."""
    raw = spark.read.json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.path", F.explode("f.secrets").alias("s"))
    return raw.select("path", F.col("s.line").cast("int").alias("line_no"), F.col("s.is_real_secret").cast("int").alias("label"))


def prometheus(lines: DataFrame, col: str = "value") -> DataFrame:
    """(name, labels, value) of Prometheus text lines; comments left out."""
    p = r"\A([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"
    rows = lines.where(~F.col(col).startswith("#") & F.col(col).rlike(p))
    return rows.select(F.regexp_extract(col, p, 1).alias("name"), F.regexp_extract(col, p, 2).alias("labels"), F.regexp_extract(col, p, 3).cast("double").alias("value"))
