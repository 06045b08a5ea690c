"""Quality rules with host verdicts.

Each document is measured by rules over its whole text. Failures are counted by host, failure rates
are shrunk by a beta prior fitted to the hosts' rates by moments, and a host whose shrunk rate is too
high takes its documents along. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import let, materialize, stage

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only a text with an equal pair of windows is sorted.
    """
    hashes = F.transform(
        F.slice(words, F.lit(1), F.size(words) - 2),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.get(at, k + 1) - p)), F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)),
        )
        return let(F.array_sort(F.transform(same, lambda p: p["i"])), covered)

    def counted(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(pairs, repeated))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, counted))


def _measures(text: Column) -> Column:
    def of(parts: Column) -> Column:
        return let(
            F.array_remove(parts, ""),
            lambda words: F.struct(
                F.size(words).cast("long").alias("n_words"),
                (F.length(text) - F.size(parts) + 1).cast("long").alias("word_chars"),
                _repeated_words(words).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(F.split(text, SPACE, -1), of)


def measure(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words: all counts 0, base_failed true. Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = ("n_words", "word_chars", "n_repeat_words", "n_symbols", "n_dup_lines", "base_failed")
    out = stage(
        docs.drop(*[prefix + n for n in names]),
        **{
            f"{prefix}m": _measures(text),
            f"{prefix}n_symbols": (F.size(F.split(text, SYMBOL, -1)) - 1).cast("long"),
            f"{prefix}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        },
    )
    out = out.withColumns({f"{prefix}{c}": F.col(f"{prefix}m.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop(f"{prefix}m")
    n = F.col(f"{prefix}n_words")
    return out.withColumn(f"{prefix}base_failed", (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n))


def host_rates(measured: DataFrame, host_col: str = "source", failed_col: str = "base_failed", strength: float = 10.0) -> DataFrame:
    """host, n, failed and rate: (failed + a) / (n + a + b) with the beta prior (a, b) by moments.

    With mean m and variance v of the hosts' rates, a + b = m (1 - m) / v - 1, at least 1 and at most
    1000; `strength` where v is 0. Null hosts are one host.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(failed_col)).alias("failed"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    # one row of three numbers
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m = 0.0 if m is None else m
    total = strength if not v else min(1000.0, max(1.0, m * (1 - m) / v - 1))
    return hosts.withColumn("rate", (F.col("failed") + F.lit(m * total)) / (F.col("n") + F.lit(total)))


def judge(measured: DataFrame, hosts: DataFrame, host_col: str = "source", most: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """measured with host_rate and kept: false if base_failed, or if the host's rate is over `most`.

    The table of hosts is broadcast if it has at most broadcast_rows rows, and joined by a shuffle
    otherwise.
    """
    side = hosts.select(F.col("host").alias("__host"), F.round("rate", 6).alias("host_rate"))
    side = F.broadcast(side) if hosts.count() <= broadcast_rows else side
    out = measured.drop("host_rate", "kept").join(side, F.col(host_col).eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = 0.8) -> DataFrame:
    """One row per document: its id, the measures, base_failed, host_rate and kept.

    Null ids stay null, repeated rows are each returned, other columns aren't read, an empty table
    gives no rows. Texts are read once: the measures are written to the shared folder.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("__source"), F.col(text_col).alias("__text"))
    measured = materialize(measure(narrow, "__text").drop("__text"), "measures")
    out = judge(measured, host_rates(measured, "__source"), "__source", most)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    return out.select(*names)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", most: float = 0.8) -> DataFrame:
    """docs' rows that are kept, with docs' columns.

    Rows are measured twice, for the hosts and for the verdict, so that no text is shuffled or
    written.
    """
    columns = docs.columns
    one = docs.select(F.col(host_col).alias("__source"), F.col(text_col).alias("__text"))
    hosts = host_rates(measure(one, "__text").drop("__text"), "__source")
    bad = hosts.where(F.col("rate") > most).select(F.col("host").alias("__host"))
    bad = F.broadcast(bad) if bad.count() <= 200_000 else bad
    rows = docs.join(bad, docs[host_col].eqNullSafe(bad["__host"]), "left_anti")
    return measure(rows, text_col, "__q_").where(~F.col("__q_base_failed")).select(*columns)
