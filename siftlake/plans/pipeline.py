"""Plans: how the operators make up scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import decode, extract, fp, ml, post, rules
from siftlake.sources import files as sources
from siftlake.sources.store import cut


def candidates(files: DataFrame, heuristics: bool = False) -> DataFrame:
    """(path, line_no, line, var_name, value) of files (path, content)."""
    base = extract.extract(files).drop("ord")
    return base.unionByName(extract.extract_heuristic(files)) if heuristics else base


def with_detector(t: DataFrame) -> DataFrame:
    kind = F.coalesce("meta.ecosystem", "morphology")
    return t.withColumns({"detector": kind, "reasoning": rules.reasoning(F.col("signals"))})


def refine(t: DataFrame, files: DataFrame) -> DataFrame:
    """UNCERTAIN candidates scored by the keywords around them; only their files' contents are joined."""
    some = t.where("provenance = 'UNCERTAIN'").select("path", "line_no").distinct()
    scored = T.stage(files.join(some, "path"), s=ml.keyword_score(ml.context_window(F.col("content"), F.col("line_no"))))
    scored = scored.select("path", "line_no", F.col("s.label").alias("ml_label"), F.col("s.confidence").alias("ml_score"))
    return rules.refine_with_score(t.join(scored, ["path", "line_no"], "left")).drop("ml_label", "ml_score")


def engine_scan(files: DataFrame, threshold: float = 0.3, heuristics: bool = False, use_ml: bool = True, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Findings by the classification alone: AUTH_CREDENTIAL or UNCERTAIN from the threshold on."""
    t = rules.classify(candidates(files, heuristics), prefixes)
    t = refine(t, files) if use_ml else t
    return with_detector(t).where(F.col("provenance").isin(*rules.FINDING_PROVENANCES) & (F.col("confidence") >= threshold))


def analyzed(files: DataFrame, heuristics: bool = False, variant: str = "cached", filtered: bool = True, suppress_below: float = 0.1, prefixes: dict[str, str] | None = None, **org) -> DataFrame:
    """All candidates with verdicts, but those on lines with an inline marker that allows them.
    `filtered` drops at once what can't be a finding."""
    t = candidates(files, heuristics)
    t = rules.classify(t.where(~post.inline_allowed(F.col("line"))), prefixes)
    if filtered:
        t = t.where(F.col("provenance").isin(*rules.FINDING_PROVENANCES) & ~T.not_secret(F.col("value")))
    t = refine(t, files)
    name = F.lower("var_name")
    keyish = t.where(((name == "key") | name.endswith("_key") | name.startswith("key_")) & T.is_hex(F.col("value")) & F.octet_length("value").isin(32, 48, 64))
    neighbours = None
    if variant != "cached":
        w = Window.partitionBy("path").orderBy("line_no")
        neighbours = extract.lines(files).select("path", "line_no", F.lag("line").over(w).alias("prev_line"), F.lead("line").over(w).alias("next_line"))
    t = fp.apply(t, fp.file_context(files), fp.sibling_lines(files, keyish), variant, neighbours)
    return with_detector(rules.analyze(t, suppress_below=suppress_below, **org))


def scan(files: DataFrame, threshold: float = 0.7, mode: str = "default", heuristics: bool = False, policy: post.Policy | None = None, baseline: DataFrame | None = None, **how) -> DataFrame:
    """The default scan: candidates, signals, rules, false-positive evidence, verdict, threshold, policy, baseline."""
    prefixes = policy.custom_prefixes if policy and policy.custom_prefixes else None
    t = analyzed(files, heuristics, prefixes=prefixes, **how).withColumn("confidence", F.col("final_confidence"))
    t = post.by_mode(t.where(F.col("confidence") >= threshold), mode)
    if policy:
        t = post.should_report(t, policy)
    else:
        t = t.withColumn("severity", T.severity(F.col("confidence")))
    t = post.with_fingerprint(t)
    return post.new_findings(t, baseline) if baseline is not None else t


def deep_scan(files: DataFrame, threshold: float = 0.3, depth: int = 1) -> DataFrame:
    """Findings in the contents and in what they decode to."""
    more = decode.chain(files, depth).select(F.when(F.col("encoding") == "plain", F.col("path")).otherwise(F.concat("path", F.lit("#"), "encoding")).alias("path"), "content")
    return engine_scan(more, threshold)


def scan_directory(spark: SparkSession, root: str, threshold: float = 0.7, policy: post.Policy | None = None, ignore: list[str] = (), heuristics: bool = False, **how) -> DataFrame:
    """The scan of a folder: the walk with its pruning, the policy's and the ignore file's patterns,
    archives' members beside plain files, then scan()."""
    found = sources.relative(sources.read_directory(spark, root), root)
    kept = sources.scannable(found.where(~sources.is_archive(F.col("path")))).unionByName(sources.engine_scannable(found.where(sources.is_archive(F.col("path")))))
    kept = post.should_scan(kept, policy) if policy else kept
    kept = post.without_ignored(kept, list(ignore)) if ignore else kept
    return scan(sources.contents(kept), threshold, heuristics=heuristics, policy=policy, **how)


def deep_scan_directory(spark: SparkSession, root: str, threshold: float = 0.3) -> DataFrame:
    """The engine's scan of a folder: members of archives and plain files with what they decode to.
    A file whose handler fails or gives nothing is scanned as it is, with the heuristics."""
    found = sources.engine_scannable(sources.relative(sources.read_directory(spark, root), root))
    made = cut(sources.contents(found).withColumn("file", F.regexp_extract("path", r"\A([^:]*)", 1)))
    rest = sources.as_text(found.join(made.select(F.col("file").alias("path")).distinct(), "path", "left_anti"))
    return deep_scan(made.drop("file"), threshold).unionByName(engine_scan(rest, threshold, heuristics=True), allowMissingColumns=True)


def diff_scan(diffs: DataFrame, threshold: float = 0.3, key: str = "commit") -> DataFrame:
    """Findings in the added lines of diffs (key, diff); line_no is the line's number in the new file."""
    added = sources.diff_lines(diffs, key=key).where(extract.has_signal(F.col("content")))
    t = added.select(key, "path", F.col("number").alias("line_no"), F.col("content").alias("line"), F.explode(extract.base_candidates(F.col("content"))).alias("c"))
    t = t.select(key, "path", "line_no", "line", "c.*").dropDuplicates([key, "path", "line_no", "value"])
    t = with_detector(rules.classify(t))
    return t.where(F.col("provenance").isin(*rules.FINDING_PROVENANCES) & ~T.not_secret(F.col("value")) & (F.col("confidence") >= threshold))


def git_scan(commits: DataFrame, threshold: float = 0.3, include=(), exclude=()) -> DataFrame:
    """Findings of commits (commit, author, date, diff), the earliest of each redacted value and file."""
    t = diff_scan(commits, threshold).where(post.path_filter(F.col("path"), include, exclude))
    t = t.join(commits.drop("diff"), "commit").withColumn("matched_value", T.redact(F.col("value")))
    return post.earliest(t.withColumn("hash", F.sha2("matched_value", 256)), ["hash", "path"], "date").drop("hash")
