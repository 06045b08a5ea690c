"""The decision tree over the signals, verdicts, risk, and the arithmetic around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import signals

FINDING_PROVENANCES = ("AUTH_CREDENTIAL", "UNCERTAIN")


def classify(tokens: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """tokens (path, line, var_name, value, ..) with role, morphology, meta, file_kind, line_adj, signals,
    provenance, confidence and rule.

    Each stage gives one struct, and later stages refer to its fields.
    """
    t = T.stage(tokens, s_role=signals.syntactic_role(F.col("var_name")), s_file=signals.file_provenance(F.col("path")), s_line=signals.line_context(F.col("line")))
    t = T.stage(t, s_morph=signals.morphology(F.col("value"), F.col("s_role.value"), prefixes))
    t = T.stage(t, d=decide(F.col("s_role.value"), F.col("s_morph.value"), F.col("s_morph.meta"), F.col("s_file.value"), F.col("s_line.adjustment")))
    one = lambda n, v, c, r: F.struct(F.lit(n).alias("name"), v.alias("value"), c.alias("confidence"), r.alias("reasoning"))
    adj = F.col("s_line.adjustment")
    all_signals = F.array(
        one("syntactic_role", F.col("s_role.value"), F.col("s_role.confidence"), F.col("s_role.reasoning")),
        one("value_morphology", F.col("s_morph.value"), F.lit(0.9), F.col("s_morph.reasoning")),
        one("file_provenance", F.col("s_file.value"), F.col("s_file.confidence"), F.col("s_file.reasoning")),
        one("line_context", F.format_string("adj=%+.1f", adj), 0.5 + adj, F.col("s_line.reasoning")),
    )
    return t.select(
        *tokens.columns,
        F.col("s_role.value").alias("role"),
        F.col("s_morph.value").alias("morphology"),
        F.col("s_morph.meta").alias("meta"),
        F.col("s_file.value").alias("file_kind"),
        adj.alias("line_adj"),
        all_signals.alias("signals"),
        F.col("d.provenance").alias("provenance"),
        F.col("d.confidence").alias("confidence"),
        F.col("d.rule").alias("rule"),
    )


def decide(role: Column, morph: Column, meta: Column, file: Column, adj: Column) -> Column:
    """struct(provenance, confidence, rule); the first rule that holds decides."""
    row = lambda p, c, r: F.struct(F.lit(p).alias("provenance"), (c if isinstance(c, Column) else F.lit(float(c))).alias("confidence"), F.lit(r).alias("rule"))
    is_in = lambda *kinds: file.isin(*kinds)
    test, doc, example = "test", "documentation", "example_config"
    floor = lambda c: F.greatest(c, F.lit(0.1))
    strong, weak, random = role == "strong_credential", role == "weak_credential", morph == "machine_random"
    subtype = meta["subtype"]
    auth = "AUTH_CREDENTIAL"
    return (
        F.when(morph == "prefixed_random", row(auth, floor(F.when(is_in(test, doc, example), 0.6).otherwise(0.95) - F.when(adj < -0.3, 0.3).otherwise(0.0)), "R1"))
        .when(morph == "private_key", row(auth, F.when(is_in(test, doc, example), 0.5).otherwise(0.9), "R2"))
        .when((morph == "connection_string") & meta["has_real_password"], row(auth, floor(F.when(file == test, 0.55).when(is_in(doc, example), 0.2).otherwise(0.85) + adj * 0.3), "R3"))
        .when(morph == "connection_string", row("DOC_EXAMPLE", 0.9, "R3'"))
        .when(morph == "jwt", row(auth, floor(F.when(is_in(test, doc), 0.4).otherwise(0.8) + adj * 0.3), "R4"))
        .when(strong & random, row(auth, floor(F.when(is_in(test, example), 0.5).when(file == doc, 0.3).otherwise(0.85) + adj * 0.3), "R5"))
        .when(morph == "template_placeholder", row("DOC_EXAMPLE", 0.95, "R6"))
        .when((morph == "structured_random") & (subtype == "uuid"), row("BUILD_GENERATED", 0.95, "R7"))
        .when((morph == "structured_random") & (subtype == "hash"), row("BUILD_GENERATED", 0.9, "R8"))
        .when(morph == "encoded_payload", row("DERIVED_VALUE", 0.85, "R9"))
        .when(is_in(test, doc, example, "build_artifact") & ~strong & ~weak, row("DOC_EXAMPLE", 0.8, "R10"))
        .when(weak & random, row("UNCERTAIN", 0.5, "R11"))
        .when(random & is_in("env_config", "iac", "cicd"), row("UNCERTAIN", 0.5, "R12"))
        .when(morph == "human_typed", row("HUMAN_AUTHORED", 0.9, "R13"))
        .when(random & (role == "anti_credential"), row("BUILD_GENERATED", 0.7, "R14a"))
        .when(random, row("UNCERTAIN", 0.4, "R14b"))
        .otherwise(row("HUMAN_AUTHORED", 0.85, "default"))
    )


def reasoning(all_signals: Column) -> Column:
    """All signals as one line: name=value(NN%): reason, joined by bars; percents round half to even."""
    return F.array_join(F.transform(all_signals, lambda s: F.concat(s["name"], F.lit("="), s["value"], F.lit("("), F.bround(s["confidence"] * 100, 0).cast("int").cast("string"), F.lit("%): "), s["reasoning"])), " | ")


def context_verdict(provenance: Column) -> Column:
    """struct(verdict, verify, notify) that a provenance starts with."""
    row = lambda v, a, b: F.struct(F.lit(v).alias("verdict"), F.lit(a).alias("verify"), F.lit(b).alias("notify"))
    return F.when(provenance == "AUTH_CREDENTIAL", row("LIKELY_TRUE_POSITIVE", True, True)).when(provenance == "UNCERTAIN", row("NEEDS_VERIFICATION", True, False)).otherwise(row("LIKELY_FALSE_POSITIVE", False, False))


def org_adjustment(value: Column, path: Column, fp_patterns=(), tp_files=(), test_format: str = "") -> Column:
    """What an organisation's own patterns add: -0.3, +0.2 and -0.4."""
    out = F.lit(0.0)
    if fp_patterns:
        out = out + F.when(T.contains_any(value, fp_patterns), -0.3).otherwise(0.0)
    if tp_files:
        out = out + F.when(T.contains_any(path, tp_files), 0.2).otherwise(0.0)
    if test_format:
        out = out + F.when(value.contains(test_format), -0.4).otherwise(0.0)
    return out


def analyze(classified: DataFrame, alert: float = 0.3, suppress_below: float = 0.1, **org) -> DataFrame:
    """classified with fp_adj, plus final_confidence, verdict, verify, notify, is_secret, block, alert, risk."""
    adj = F.col("fp_adj") + org_adjustment(F.col("value"), F.col("path"), **org)
    t = T.stage(classified, v=context_verdict(F.col("provenance")), total_adj=adj)
    t = T.stage(t, final_confidence=T.clamp(F.col("confidence") + F.col("total_adj")))
    final = F.col("final_confidence")
    verdict = F.when(final < suppress_below, "SUPPRESSED").when(F.col("total_adj") <= -0.8, "LIKELY_FALSE_POSITIVE").otherwise(F.col("v.verdict"))
    dropped = final < suppress_below
    t = t.withColumns({"verdict": verdict, "verify": F.col("v.verify") & ~dropped & (F.col("total_adj") > -0.8), "notify": F.col("v.notify") & (final >= alert) & ~dropped & (F.col("total_adj") > -0.8)})
    secret = F.col("verdict").isin("CONFIRMED", "LIKELY_TRUE_POSITIVE")
    return t.withColumns({"is_secret": secret, "block": secret & (final >= 0.8), "alert": secret, "risk": risk(F.col("verdict"), final)}).drop("v")


def verify_phase(analyzed: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Phases after the context: an optional table (path, line_no, value, status) of verifications
    confirms or drops what was to be verified; blast radius and remediation follow by confidence."""
    if verified is None:
        return analyzed.withColumns({"verification": F.lit(None).cast("string"), "blast_radius": F.lit(False), "remediate": F.lit(False)})
    t = analyzed.join(verified.withColumnRenamed("status", "verification"), ["path", "line_no", "value"], "left")
    asked = F.col("verify") & F.col("verification").isNotNull()
    confirmed = asked & (F.col("verification") == "VERIFIED")
    t = t.withColumn("verdict", F.when(confirmed, "CONFIRMED").when(asked, "DROPPED").otherwise(F.col("verdict")))
    return t.withColumns({"is_secret": F.col("verdict").isin("CONFIRMED", "LIKELY_TRUE_POSITIVE"), "blast_radius": confirmed & (F.col("final_confidence") >= 0.7), "remediate": confirmed & (F.col("final_confidence") >= 0.9)})


def risk(verdict: Column, confidence: Column) -> Column:
    c = confidence
    by_level = F.when(c >= 0.9, "critical").when(c >= 0.7, "high").when(c >= 0.4, "medium").when(c >= 0.2, "low").otherwise("none")
    return F.when(verdict.isin("SUPPRESSED", "LIKELY_FALSE_POSITIVE"), F.when(c >= 0.5, "low").otherwise("none")).otherwise(by_level)


def refine_with_score(classified: DataFrame, label: str = "ml_label", score: str = "ml_score") -> DataFrame:
    """UNCERTAIN rows moved by a classifier's label and score; other rows, and null scores, stay."""
    lab, p, conf = F.col(label), F.col(score), F.col("confidence")
    on = (F.col("provenance") == "UNCERTAIN") & p.isNotNull()
    to = lambda a, b: F.struct(F.lit(a).alias("provenance"), b.alias("confidence"))
    moved = (
        F.when(on & (lab == 1) & (p >= 0.7), to("AUTH_CREDENTIAL", F.greatest(conf, p * 0.85)))
        .when(on & (lab == 0) & (p >= 0.8), to("DOC_EXAMPLE", 1 - p))
        .when(on & (lab == 1) & (p >= 0.55), to("UNCERTAIN", F.least(conf + (p - 0.5) * 0.4, F.lit(0.95))))
        .when(on & (lab == 0) & (p >= 0.6), to("UNCERTAIN", F.greatest(conf - (p - 0.5) * 0.3, F.lit(0.05))))
        .otherwise(F.struct(F.col("provenance"), conf.alias("confidence")))
    )
    added = F.array_append("signals", F.struct(F.lit("ml_classifier").alias("name"), F.when(lab == 1, "SECRET").otherwise("NOT_SECRET").alias("value"), p.alias("confidence"), F.lit("context classifier").alias("reasoning")))
    return classified.withColumns({"signals": F.when(on, added).otherwise(F.col("signals")), "moved": moved}).withColumns({"provenance": F.col("moved.provenance"), "confidence": F.col("moved.confidence")}).drop("moved")
