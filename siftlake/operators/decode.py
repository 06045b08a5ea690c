"""Decoded variants of contents: base64, UTF-16, unicode and hex escapes, and chains of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V
from siftlake.sources.store import cut

_ROW = "array<struct<content:string,encoding:string>>"


def base64_chunks(text: Column) -> Column:
    """Readable decodings of base64 runs that hint at a secret."""

    def decoded(x: Column) -> Column:
        std = F.translate(F.regexp_replace(x, r"=+\z", ""), "-_", "+/")
        padded = F.concat(std, F.repeat(F.lit("="), F.pmod(-F.length(std), F.lit(4))))
        return F.when(F.length(std) % 4 != 1, F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))

    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/\-_]{16,}={0,3})"), F.lit(1)), decoded)
    kept = F.filter(found, lambda d: d.isNotNull() & T.contains_any(d, V.BASE64_HINTS))
    return F.transform(kept, lambda d: F.struct(d.alias("content"), F.lit("base64").alias("encoding")))


def _runs(text: Column, pattern: str, to_text) -> Column:
    """text with each run of escapes replaced by what it stands for."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    # longer runs first, so that one run is never replaced inside another
    longest = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda a, r: F.replace(a, r, F.coalesce(to_text(r), r)))


def unescaped(text: Column) -> Column:
    short = lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE")
    long = lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\U"), F.lit(""))), "UTF-32")
    hexed = lambda r: F.make_valid_utf8(F.unhex(F.replace(r, F.lit("\\x"), F.lit(""))).cast("string"))
    kinds = [("unicode_escape", r"(?:\\u[0-9a-fA-F]{4})+", short), ("unicode_escape", r"(?:\\U[0-9a-fA-F]{8})+", long), ("hex_escape", r"(?:\\x[0-9a-fA-F]{2}){2,}", hexed)]
    parts = [F.when(text.rlike(p), F.array(F.struct(_runs(text, p, f).alias("content"), F.lit(name).alias("encoding")))).otherwise(F.array().cast(_ROW)) for name, p, f in kinds]
    return F.concat(*parts)


def utf16(data: Column) -> Column:
    """Text of UTF-16 bytes with a mark in front, an odd last byte left out; null for other bytes."""
    mark = F.hex(F.substring(data, 1, 2))
    even = F.substring(data, F.lit(1), F.octet_length(data) - F.octet_length(data) % 2)
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(even, "UTF-16"))


def variants(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(path, content, encoding): each content as it is (plain), then its decoded variants."""
    text = F.col(content_col)
    all_of = F.concat(F.array(F.struct(text.alias("content"), F.lit("plain").alias("encoding"))), base64_chunks(text), unescaped(text))
    return files.select("path", F.explode(all_of).alias("v")).select("path", "v.*")


def chain(files: DataFrame, depth: int = 5, content_col: str = "content") -> DataFrame:
    """(path, content, encoding, depth): decodings of decodings, each content of a path once.

    Each level is written before the next one reads it, so nothing is decoded twice; only decoded
    contents are shuffled, and digests of the rest. It ends at a level with nothing new.
    """
    key = F.sha2("content", 256)
    out = level = files.select("path", F.col(content_col).alias("content"), F.lit("plain").alias("encoding"), F.lit(0).alias("depth"))
    seen = level.select("path", key.alias("key"))
    for d in range(1, depth + 1):
        new = variants(level).where("encoding <> 'plain'").withColumns({"depth": F.lit(d), "key": key}).dropDuplicates(["path", "key"])
        new = cut(new.join(seen, ["path", "key"], "left_anti").select("path", "content", "encoding", "depth", "key"))
        if new.isEmpty():
            break
        level, seen = new.drop("key"), seen.unionByName(new.select("path", "key"))
        out = out.unionByName(level)
    return out
