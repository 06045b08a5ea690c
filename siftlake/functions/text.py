"""Scalar functions as Column expressions. Lengths are in bytes wherever a length decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import vocab as V


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, computed once a row whatever refers to them.

    A generator of one row stands between them and what follows, so neither projections nor filters
    above take the expressions in and repeat them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, words) -> Column:
    return any_of(text.contains(w) for w in words)


def starts_with_any(text: Column, words) -> Column:
    return any_of(text.startswith(w) for w in words)


def strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def blank_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+\z", "")


def split_name(name: Column) -> Column:
    """Lower-case parts of an identifier in snake, kebab, dotted or camel case."""
    clean = F.regexp_replace(name, r"\A[^A-Za-z0-9]+", "")
    parts = F.split(clean, r"[-_./\\ \t]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", -1)
    return F.filter(F.transform(parts, F.lower), lambda x: x != "")


def _bytes(text: Column) -> Column:
    return F.regexp_extract_all(F.hex(text), F.lit("(..)"), F.lit(1))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the text's bytes; 0 for an empty text."""

    def of(b: Column) -> Column:
        n = F.size(b)
        share = F.transform(F.array_sort(F.array_distinct(b)), lambda c: (n - F.size(F.array_remove(b, c))) / n)
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.octet_length(text) > 0, let(_bytes(text), of)).otherwise(F.lit(0.0))


def unique_ratio(text: Column) -> Column:
    return let(_bytes(text), lambda b: F.size(F.array_distinct(b)) / F.greatest(F.size(b), F.lit(1)))


def fast_entropy_screen(text: Column) -> Column:
    n, r = F.octet_length(text), unique_ratio(text)
    return F.when((n < 16) | (r <= 0.25), False).when((r > 0.85) & (n > 20), True).when((r < 0.35) & (n < 30), False).otherwise(True)


def is_hex(text: Column) -> Column:
    return text.rlike(r"\A[0-9A-Fa-f]+\z")


def is_uuid(text: Column) -> Column:
    return text.rlike(r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z")


def charset(text: Column) -> Column:
    return (
        F.when(is_hex(text), "hex")
        .when(text.rlike(r"\A[0-9A-Za-z+/=]*[+/=][0-9A-Za-z+/=]*\z"), "base64")
        .when(text.rlike(r"\A[0-9A-Za-z]*\z"), "alphanum")
        .otherwise("mixed")
    )


def known_prefix(text: Column, prefixes: dict[str, str] | None = None) -> Column:
    """(prefix, ecosystem) of the longest known prefix; null if there is none."""
    out = F.lit(None).cast("struct<prefix:string,ecosystem:string>")
    for prefix, ecosystem in sorted((prefixes or V.PREFIXES).items(), key=lambda x: len(x[0])):
        out = F.when(text.startswith(prefix), F.struct(F.lit(prefix).alias("prefix"), F.lit(ecosystem).alias("ecosystem"))).otherwise(out)
    return out


def has_prefix(text: Column) -> Column:
    return starts_with_any(text, V.PREFIXES)


def looks_like_identifier(text: Column) -> Column:
    """One case only, and each part between underscores a common word or at most 2 characters."""
    words = strings(V.IDENTIFIER_WORDS)
    low = F.lower(text)
    parts = F.forall(F.split(low, "_", -1), lambda p: (F.length(p) <= 2) | F.array_contains(words, p))
    known = F.when(text.contains("_"), parts).otherwise(F.array_contains(words, low))
    return (F.octet_length(text) >= 3) & text.rlike(r"\A(?:[a-z0-9_]+|[A-Z0-9_]+)\z") & known


def looks_like_full_identifier(text: Column) -> Column:
    return text.rlike(r"\A(?:[a-z0-9_]{8,}|[A-Z0-9_]{8,})\z") & text.rlike("_.*_")


def not_secret(value: Column) -> Column:
    """Values that no extraction pattern keeps: references, markup, defaults, identifiers."""
    tests = [
        value.contains("${") | value.contains("$("),
        F.length(value) - F.length(F.replace(value, F.lit("%"), F.lit(""))) >= 2,
        value.contains("{{"),
        value.startswith("`") & value.endswith("`"),
        value.contains("</") | value.contains("/>"),
        value.isin(*V.WELL_KNOWN_DEFAULTS),
        value.startswith("$"),
        starts_with_any(value, V.ENV_READS),
        looks_like_full_identifier(value),
    ]
    return (F.octet_length(value) >= 8) & any_of(tests)


def is_base64_binary(text: Column) -> Column:
    """Strict base64 of at least 16 characters that decodes to mostly unprintable bytes."""
    strict = text.rlike(r"\A(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z|\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)\z")

    def binary(b: Column) -> Column:
        printable = F.aggregate(b, F.lit(0), lambda a, x: a + F.when((x >= "20") & (x <= "7E"), 1).otherwise(0))
        return printable / F.size(b) < 0.7

    decoded = let(F.regexp_extract_all(F.hex(F.try_to_binary(text, F.lit("base64"))), F.lit("(..)"), F.lit(1)), binary)
    return F.when((F.octet_length(text) >= 16) & (F.octet_length(text) % 4 == 0) & strict, F.coalesce(decoded, F.lit(False))).otherwise(False)


def repeats_block(text: Column) -> Column:
    """Whether the text is a block of 8 to 16 characters, twice or more."""
    n = F.length(text)
    return any_of((n >= 2 * k) & (n % k == 0) & (F.repeat(F.substring(text, 1, k), F.floor(n / k).cast("int")) == text) for k in range(8, 17))


def rot13(text: Column) -> Column:
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    both = up + up.lower()
    return F.translate(text, both, up[13:] + up[:13] + up.lower()[13:] + up.lower()[:13])


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def redact(value: Column, style: str = "finding") -> Column:
    """finding: first 6 and last 4 over 16 characters, 4 and stars over 8; detector: 4 and 4 over 8."""
    n, stars, dots = F.length(value), F.lit("****"), F.lit("...")
    if style == "detector":
        return F.when(n <= 8, stars).otherwise(F.concat(F.substring(value, 1, 4), dots, F.right(value, F.lit(4))))
    return F.when(n > 16, F.concat(F.substring(value, 1, 6), dots, F.right(value, F.lit(4)))).when(n > 8, F.concat(F.substring(value, 1, 4), stars)).otherwise(stars)


def redact_level(value: Column, level: int) -> Column:
    """Hide `level` percent of the characters, from the end: two at least are shown and one is hidden.
    At level 0 all is shown; at 100, and of values of up to 8 characters, nothing."""
    if level <= 0:
        return value
    n = F.length(value)
    shown = F.least(F.greatest(F.floor(n * F.lit(max(0, 100 - level)) / 100).cast("int"), F.lit(2)), n - 1)
    return F.when((n <= 8) | F.lit(level >= 100), F.lit("****")).otherwise(F.concat(F.substring(value, F.lit(1), shown), F.repeat(F.lit("*"), n - shown)))


def fingerprint(file: Column, line: Column, detector: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file, line.cast("string"), detector, value), 256), 1, 32)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def severity(confidence: Column) -> Column:
    c = confidence
    return F.when(c >= 0.9, "critical").when(c >= 0.7, "high").when(c >= 0.5, "medium").when(c >= 0.3, "low").otherwise("info")


def sarif_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "error").when(confidence >= 0.5, "warning").otherwise("note")


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM with a random nonce in front, base64."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt(value: Column, key: Column) -> Column:
    return F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")
