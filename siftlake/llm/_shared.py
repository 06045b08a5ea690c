"""Helpers that the operators of this subpackage share: table access and shared storage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing ASCII letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session has none, one in the temporary folder
    of a local session; a cluster needs the setting, as its machines don't share such folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor costs only the tasks it ran, and nothing upstream runs again. The files go
    when the driver's file system client closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    df.write.parquet(path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def join_sized(rows: DataFrame, keyed: DataFrame, key: str, size: str, large: int = 1000, most: int = 200_000) -> DataFrame:
    """rows joined to `keyed`, which has one row for each key with its number of rows in `size`.

    Keys with many rows are joined by a broadcast, the others by a shuffle, so no task gets a large
    key. A key is large from `large` rows on, or a higher number, so that at most `most` keys are: there
    can't be more than all rows divided by it.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(large, total // most + 1)
    heavy = F.broadcast(keyed.where(hot))
    light = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(heavy, key).unionByName(light)


def release() -> None:
    """Give memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that leaves no freed memory behind. A worker serves many tasks and waits
    between them; it would keep the most that any of them took, beside the heap of its executor."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def groups(batches: Iterable[pa.RecordBatch], size: int = 1 << 23) -> Iterator[pa.Table]:
    """The rows of the batches, in order, in tables of about `size` bytes: small batches go together,
    and large ones are cut, but for a row that is larger by itself."""
    held, n = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            n += held[-1].nbytes
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], size: int = 1 << 23) -> Iterator[pa.Table]:
    """Tables like those of groups(), of rows that are sorted by keys, in which no group of equal keys
    is cut: the last group of a table waits for the next."""
    held = None
    for t in groups(batches, size):
        t = t if held is None else pa.concat_tables([held, t])
        last = np.ones(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            last &= c == c[-1]
        begin = int(np.argmax(last))
        held = t.slice(begin)
        if begin:
            yield t.slice(0, begin)
    if held is not None:
        yield held


def let(value, body):
    """body(value) with value evaluated once a row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stage(df: DataFrame, **columns) -> DataFrame:
    """df with more columns, computed once a row: a generator of one row keeps projections and
    filters above from taking the expressions in and repeating them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def ascii_lower(text):
    """Lower-case A-Z only; an all-ASCII text takes the fast path."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
