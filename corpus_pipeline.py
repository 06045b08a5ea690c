"""A training-corpus pipeline over `documents`: language ID, quality rules, near-duplicates,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next stage's docs; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, language, packing, quality, simhash
from siftlake.llm._shared import materialize, table

#: Up to so many keys of rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `__txt`, a key of the row's text: what a stage decides depends on a row's id and text."""
    return docs.withColumn("__txt", simhash.text_key(F.col("text").cast("string")))


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs (with __txt) whose id and text are among keys (doc_id, txt), or aren't."""
    keys = materialize(keys.select(F.col("doc_id").alias("__id"), F.col("txt").alias("__key")).distinct(), "keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    same = (docs["__txt"] == side["__key"]) & docs["doc_id"].cast("long").eqNullSafe(side["__id"])
    return docs.join(side, same, how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and rejected scores go."""
    return language.predict(docs, language.fit(docs), rejected=False).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts whose shrunk failure rate isn't too high."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts of 0.8 or more in five-word shingles: the one with the least
    id, a null id last; of rows with the same id and text, one."""
    columns, docs = docs.columns, _keyed(docs)
    found = materialize(simhash.near_copies(docs).select("doc_id", "txt", "first"), "near-copies")
    rest = _matching(docs, found.where("not first"), "left_anti")
    again = found.where("first").groupBy("doc_id", "txt").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again, "repeated")
    if again.isEmpty():
        return rest.select(*columns)
    once = _matching(rest, again, "left_semi").dropDuplicates(["doc_id", "__txt"])
    return _matching(rest, again, "left_anti").unionByName(once).select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Rows are told apart by id and text."""
    columns, docs = docs.columns, _keyed(docs)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("__txt",))
    hit = found.where("contaminated").select("doc_id", F.col("__txt").alias("txt"))
    return _matching(docs, hit, "left_anti").select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no trained classifier and no XXH64: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
