"""Token ids in a binary file format, compressed by a Re-Pair grammar.

Documents are range-partitioned by id, and each partition is cut into shards, runs of documents of
about a million ids. Within a shard, rounds replace frequent pairs of neighbouring ids by nonterminals
until no pair occurs `least` times. A shard stores its rules, the expansion length of each
nonterminal, the sequence that is left, and where each document begins, so that one document decodes
without the rest.

Shard layout, little-endian: magic, then counts as uint64 (documents, ids, rules, symbols, first
nonterminal, ids of the partition before this shard), then left and right sides of the rules (uint32),
expansion lengths (uint32), symbols (uint16 if all fit, else uint32), ids (int64) and null flags
(uint8) of the documents, and the end of each document in ids (uint64).

Shards are rows of a Parquet table, so any store that Spark writes to will hold them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm._shared import groups, lean, shared_dir
from siftlake.llm.segments import encoder

MAGIC = b"RPT1"
_HEAD = struct.Struct("<4s6Q")


def _frequent(seq: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left << 32 | right) that occur at least `least` times, the most frequent first; where
    they occur; and which of them each place holds.

    Counts are taken by hash, so the pairs of a full bucket are counted again exactly.
    """
    mixed = seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)
    hashed = (mixed >> np.uint32(32 - bits)).astype(np.int64)
    counts = np.bincount(hashed, minlength=1 << bits)
    full = np.flatnonzero(counts >= least)
    bucket_of = np.full(1 << bits, -1, np.int32)
    bucket_of[full] = np.arange(len(full))
    bucket = bucket_of[hashed]
    at = np.flatnonzero(bucket >= 0)
    bucket = bucket[at]
    pair = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    # a bucket has one pair as a rule; the places of any other are counted by sorting
    one = np.zeros(len(full), np.uint64)
    one[bucket] = pair
    other = pair != one[bucket]
    rest, rest_n = np.unique(pair[other], return_counts=True)
    found = np.concatenate([one, rest])
    n = np.concatenate([np.bincount(bucket[~other], minlength=len(full)), rest_n])
    bucket[other] = len(full) + np.searchsorted(rest, pair[other])
    order = np.lexsort((found, -n))
    order = order[n[order] >= least]
    rank = np.full(len(found), -1, np.int64)
    rank[order] = np.arange(len(order))
    slot = rank[bucket]
    return found[order], at[slot >= 0], slot[slot >= 0]


def compress(ids: np.ndarray, least: int = 64, bits: int = 20):
    """(left, right, first nonterminal, sequence): the grammar of a shard's ids.

    A round replaces all pairs that occur at least `least` times; rounds go on until there are none.
    Of occurrences that overlap, every second one is taken, from the leftmost.
    """
    seq = np.asarray(ids, np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 0
    left, right, rules = [], [], 0
    while len(seq) > least:
        top, at, slot = _frequent(seq, least, bits)
        if not len(top):
            break
        # in a run of neighbouring positions every second one is taken, from the first
        starts = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, slot = at[take], slot[take]
        # a pair that was never taken has no rule
        used, slot = np.unique(slot, return_inverse=True)
        seq = seq.copy()
        seq[at] = first + rules + slot
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        left.append((top[used] >> np.uint64(32)).astype(np.uint32))
        right.append((top[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        rules += len(used)
    none = np.zeros(0, np.uint32)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), first, seq


class Shard:
    """A shard that was read; ids() decodes documents by number without decoding the rest."""

    def __init__(self, payload: bytes):
        magic, self.docs, self.n_ids, rules, symbols, self.first, self.before = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = part("<u4", rules), part("<u4", rules), part("<u4", rules)
        self.seq = part("<u2" if self.first + rules <= 1 << 16 else "<u4", symbols).astype(np.int64)
        self.doc_ids, self.nulls, self.ends = part("<i8", self.docs), part("u1", self.docs), part("<u8", self.docs)
        self._grown: tuple[np.ndarray, np.ndarray] | None = None
        self._ends_of_symbols = np.cumsum(self._length_of(self.seq))

    def _length_of(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.first
        lengths = np.ones(len(symbols), np.int64)
        lengths[rule >= 0] = self.lengths[rule[rule >= 0]]
        return lengths

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions one after another, and where each begins."""
        if self._grown is None:
            begin = np.r_[0, np.cumsum(self.lengths.astype(np.int64))]
            flat = np.zeros(int(begin[-1]), "<u4")
            for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
                at = int(begin[r])
                for side in (a, b):
                    if side < self.first:
                        flat[at] = side
                        at += 1
                    else:
                        k = side - self.first
                        n = int(self.lengths[k])
                        flat[at : at + n] = flat[begin[k] : begin[k] + n]
                        at += n
            self._grown = flat, begin[:-1]
        return self._grown

    def _decode(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        lengths = self._length_of(symbols)
        out = np.repeat(symbols, lengths)
        nested = out >= self.first
        within = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[nested] = flat[begin[out[nested] - self.first] + within[nested]]
        return out.astype("<u4")

    def ids(self, first: int, last: int | None = None) -> np.ndarray:
        """Ids of document number `first`, or of first..last - 1."""
        last = first + 1 if last is None else last
        lo, hi = (int(self.ends[first - 1]) if first else 0), int(self.ends[last - 1])
        a = int(np.searchsorted(self._ends_of_symbols, lo, "right"))
        b = int(np.searchsorted(self._ends_of_symbols, hi, "left")) + 1
        skipped = lo - (int(self._ends_of_symbols[a - 1]) if a else 0)
        return self._decode(self.seq[a:b])[skipped : skipped + hi - lo]


def to_shard(doc_ids: list[int | None], ids: list[np.ndarray], before: int = 0, **how) -> bytes:
    flat = np.concatenate([np.zeros(0, "<u4"), *ids])
    left, right, first, seq = compress(flat, **how)
    lengths = np.ones(len(left), np.int64)
    for r, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        lengths[r] = sum(1 if x < first else lengths[x - first] for x in (a, b))
    kind = "<u2" if first + len(left) <= 1 << 16 else "<u4"
    ends = np.cumsum([len(x) for x in ids]).astype("<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], "u1")
    head = _HEAD.pack(MAGIC, len(doc_ids), len(flat), len(left), len(seq), first, before)
    parts = (left.astype("<u4"), right.astype("<u4"), lengths.astype("<u4"), seq.astype(kind), known, nulls, ends)
    return head + b"".join(x.tobytes() for x in parts)


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    shard_ids: int = 1 << 20,
    least: int = 64,
) -> None:
    """Encode all documents and write shards of about shard_ids ids, in ascending id order.

    A null or empty text is the end id alone; null ids come first; rows of equal id are ordered by
    their texts' hash, and each is written; other columns aren't read.
    """
    schema = "part int, shard int, n_docs long, n_ids long, payload binary"
    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode_column, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        doc_ids, ids, held, before, number = [], [], 0, 0, 0

        def shard():
            nonlocal doc_ids, ids, held, before, number
            row = [[part], [number], [len(doc_ids)], [held], [to_shard(doc_ids, ids, before, least=least)]]
            before, number, doc_ids, ids, held = before + held, number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)

        for some in groups(batches):
            for doc_id, found in zip(some.column(0).to_pylist(), encode(some.column(1))):
                got = np.concatenate([found, end])
                doc_ids.append(doc_id)
                ids.append(got)
                held += len(got)
                if held >= shard_ids:
                    yield shard()
        if doc_ids:
            yield shard()

    keys = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    keys = keys.withColumn("tie", F.xxhash64("text"))
    ordered = keys.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32.

    The driver takes one number for each partition that was written."""
    shards = spark.read.parquet(path)
    sizes = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases = dict(zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist()))
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = Shard(payload.as_py())
                ids, ends = b.ids(0, b.docs), b.ends.astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(b.doc_ids, pa.int64(), mask=b.nulls.astype(bool)), pa.array(starts + bases[part] + b.before), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return shards.select("part", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the documents' ids to path (a new folder in the shared one if None) and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, **how)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return read(spark, path)
