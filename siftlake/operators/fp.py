"""False-positive signals over a candidate, its line, its path and its file.

variant "cached" is what scans use; "full" also looks at adjacent lines, file structure and headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V


def file_context(files: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per file: path, and what the signals ask of its content. The content itself isn't kept."""
    low = F.lower(content_col)
    head = F.slice(F.split(low, "\n", 6), 1, 5)
    header = F.exists(head, lambda x: T.contains_any(x, ["revoked", "deprecated", "do not use", "expired"]) & T.contains_any(x, ["credential", "key", "token", "secret"]))
    return files.select(
        "path",
        T.contains_any(low, V.CRYPTO_IMPORTS).alias("has_crypto"),
        T.contains_any(low, ["key rotation", "credential rotation", "revoked keys", "deprecated credentials"]).alias("rotation"),
        header.alias("revoked_header"),
        (low.contains("scan_exception") | low.contains('"approved_by"') | (low.contains('"reason"') & low.contains('"pattern"'))).alias("allow_structure"),
        T.contains_any(low, ["nist", "rfc "]).alias("test_vectors"),
    )


def sibling_lines(files: DataFrame, keys: DataFrame, content_col: str = "content") -> DataFrame:
    """(path, value, sibling) for key-like hex values: whether a line from 5 before to 4 after the first
    line with the value has a crypto field."""
    tests = lambda ll: T.any_of(T.contains_any(ll, [f'"{s}"', f"'{s}'", f"{s}:", f"{s} ="]) for s in V.CRYPTO_SIBLINGS)
    rows = files.join(keys.select("path", "value").distinct(), "path").withColumn("ls", F.split(content_col, "\n", -1))
    at = F.array_position(F.transform("ls", lambda x: x.contains(F.col("value"))), True)
    near = F.slice("ls", F.greatest(at - 5, F.lit(1)).cast("int"), (F.least(at + 4, F.size("ls")) - F.greatest(at - 5, F.lit(1)) + 1).cast("int"))
    return rows.where(at > 0).select("path", "value", F.exists(near, lambda x: tests(F.lower(x))).alias("sibling"))


def template_reference(v: Column) -> Column:
    return (
        (v.contains("${") & v.contains("}"))
        | v.rlike(r"\A\$[A-Z0-9_]+\z")
        | T.contains_any(v, ["os.Getenv", "os.LookupEnv", "process.env.", "process.env[", "os.environ", "os.getenv", "System.getenv"])
        | T.starts_with_any(v, ["ENV[", "ENV.fetch"])
    )


def dead_value(v: Column) -> Column:
    low = F.lower(v)
    return v.isin(*V.DEAD_VALUES) | T.starts_with_any(v, V.TEST_PREFIXES) | T.starts_with_any(low, V.PLACEHOLDER_PREFIXES) | (~v.contains("://") & low.contains("example") & (F.octet_length(v) >= 16))


def crypto_domain(name: Column, v: Column, line: Column, has_crypto: Column, sibling: Column) -> Column:
    n, ll = F.lower(name), F.lower(line)
    decoding = T.contains_any(ll, ["fromhex", "from_hex", "hex_decode", "unhexlify"]) & T.contains_any(n, ["key", "iv", "nonce", "tag", "cipher", "plain"])
    key = (n == "key") | n.endswith("_key") | n.startswith("key_")
    hexed = T.is_hex(v) & F.octet_length(v).isin(*V.CRYPTO_KEY_LENGTHS)
    return T.contains_any(n, ["nist", "test_vector", "test_key", "test_iv", "test_tag", "test_nonce"]) | decoding | (key & hexed & (has_crypto | sibling))


def allow_context(name: Column, line: Column, path: Column, cached: bool = True) -> Column:
    n, ll, p = F.lower(name), F.lower(line), F.lower(path)
    out = T.contains_any(n, V.ALLOWLIST_KEYS) | T.any_of(T.contains_any(ll, [f'"{k}"', f"'{k}'"]) for k in V.ALLOWLIST_KEYS) | T.contains_any(p, V.ALLOWLIST_PATHS)
    return out | T.contains_any(ll, ["scan_exception", "approved_by"]) if cached else out


def apply(tokens: DataFrame, context: DataFrame, siblings: DataFrame | None = None, variant: str = "cached", neighbours: DataFrame | None = None) -> DataFrame:
    """tokens with fp_adj and evidence (array of type, impact).

    context: file_context(); siblings: sibling_lines(), only for candidates that may be keys; neighbours:
    (path, line_no, prev_line, next_line), used by variant "full".
    """
    cached = variant == "cached"
    t = tokens.join(context, "path", "left")
    if siblings is not None:
        t = t.join(siblings, ["path", "value"], "left")
    else:
        t = t.withColumn("sibling", F.lit(None).cast("boolean"))
    if neighbours is not None and not cached:
        t = t.join(neighbours, ["path", "line_no"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    name, value, line, path = (F.col(c) for c in ("var_name", "value", "line", "path"))
    p = F.lower(path)
    said = T.contains_any(F.lower(line), V.INSTRUCTIONS)
    if neighbours is not None and not cached:
        for side in ("prev_line", "next_line"):
            said = said | F.coalesce(T.contains_any(F.lower(side), V.INSTRUCTIONS), F.lit(False))
    crypto = crypto_domain(name, value, line, no("has_crypto"), no("sibling"))
    allowed = allow_context(name, line, path, cached)
    gone = T.contains_any(p, ["revok", "rotat", "deprecat"]) | no("rotation") if cached else T.contains_any(p, V.REVOKED_PATHS) | no("revoked_header")
    if not cached:
        crypto = crypto | (no("test_vectors") & T.is_hex(value))
        allowed = allowed | no("allow_structure")
    t = T.stage(t, f_a=template_reference(value), f_l=T.contains_any(F.lower(line), V.EXTERNAL_LOADS), f_b=dead_value(value), f_c=said, f_d=crypto, f_e=allowed, f_f=T.contains_any(p, V.SUPPRESSED_DIRS), f_g=gone)
    amount = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    before = amount("f_l", -0.8)
    soft = before + amount("f_c", -0.7) + amount("f_e", -0.9) + amount("f_f", -0.6) + amount("f_g", -0.9)
    stop_b, stop_d = (F.lit(-1.0), F.lit(-1.0)) if cached else (before - 1.0, before + amount("f_c", -0.7) - 1.0)
    adj = F.when(F.col("f_a"), -1.0).when(F.col("f_b"), stop_b).when(F.col("f_d"), stop_d).otherwise(soft)
    ev = lambda c, kind, x, unless=(): F.when(F.col(c) & ~T.any_of([F.lit(False), *[F.col(u) for u in unless]]), F.struct(F.lit(kind).alias("type"), F.lit(x).alias("impact")))
    evidence = F.array_compact(
        F.array(
            ev("f_a", "template_reference", -1.0),
            ev("f_l", "template_reference_line", -0.8, ["f_a"]),
            ev("f_b", "known_dead_value", -1.0, ["f_a"]),
            ev("f_c", "inline_instruction", -0.7, ["f_a", "f_b"]),
            ev("f_d", "crypto_domain", -1.0, ["f_a", "f_b"]),
            ev("f_e", "allowlist_context", -0.9, ["f_a", "f_b", "f_d"]),
            ev("f_f", "path_suppression", -0.6, ["f_a", "f_b", "f_d"]),
            ev("f_g", "revocation_file", -0.9, ["f_a", "f_b", "f_d"]),
        )
    )
    return T.stage(t, fp_adj=adj, evidence=evidence).select(*tokens.columns, "fp_adj", "evidence")
