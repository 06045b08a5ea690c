"""Hierarchical multi-length packing of token ids into training sequences.

Each document is encoded and ended; its full windows of the longest tier are sequences of their own,
and what is left over goes to the shortest tier that holds it. Tiers are packed from the longest
down: a window opens with the longest piece of its tier, whole pieces of shorter tiers fill the gap,
longest fit first, and where none fits the next piece is cut to close the window. What remains at the
end of a partition is cut at powers of two, so that no sequence needs padding. Sequences of one tier
form step groups of equal token counts.

The work is one pass over each input partition without a shuffle: memory holds `pool` left-over
pieces at most, a task that is lost runs again by itself, and sequence ids depend only on the
partition and the order in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftlake.llm._shared import groups, lean, release
from siftlake.llm.segments import encoder

TIERS = (1024, 512, 256, 128)
#: Bytes of texts that are encoded at a time: a worker takes some fifty times as much for them.
TOGETHER = 1 << 21

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier long, step_group long"
)


class Packer:
    """Takes documents with add(), gives finished pieces with take(); see the module."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16_384, pool: int = 4096, base: int = 0):
        if any(a <= b or a & (a - 1) for a, b in zip(tiers, [*tiers[1:], 0])):
            raise ValueError("tiers are falling powers of two")
        self._tiers, self._step_tokens, self._pool_size, self._base = tiers, step_tokens, pool, base
        self._pools: dict[int, list] = {t: [] for t in tiers}  # (length, number, piece), rising
        self._held = self._made = self._number = self._groups = 0
        self._open: dict[int, tuple[int, int]] = {}  # tier: step group, tokens in it
        self._out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        longest, n = self._tiers[0], len(ids)
        full = n - n % longest
        for start in range(0, full, longest):
            self._emit(longest, [(doc_id, start, ids[start : start + longest], n)])
        if full < n:
            self._put((doc_id, full, ids[full:].copy(), n))
        if self._held >= self._pool_size:
            self._pack(end=False)

    def finish(self) -> None:
        self._pack(end=True)

    def take(self) -> list[tuple]:
        out, self._out = self._out, []
        return out

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        tier = min(t for t in self._tiers if t >= n)
        self._number += 1
        insort(self._pools[tier], (n, self._number, piece))
        self._held += 1

    def _longest_fit(self, gap: int):
        """The longest whole piece of at most gap tokens."""
        for tier in self._tiers:
            if (at := bisect_right(self._pools[tier], (gap, 1 << 62))):
                self._held -= 1
                return self._pools[tier].pop(at - 1)[2]
        return None

    def _shortest(self):
        for tier in reversed(self._tiers):
            if self._pools[tier]:
                self._held -= 1
                return self._pools[tier].pop(0)[2]
        return None

    def _pack(self, end: bool) -> None:
        for tier in self._tiers:
            pool = self._pools[tier]
            while pool:
                self._held -= 1
                window = [pool.pop()[2]]
                gap = tier - len(window[0][2])
                while gap:
                    if (piece := self._longest_fit(gap)) is None:
                        if (piece := self._shortest()) is None:
                            break
                        doc_id, start, ids, n = piece
                        self._put((doc_id, start + gap, ids[gap:], n))
                        piece = (doc_id, start, ids[:gap], n)
                    window.append(piece)
                    gap -= len(piece[2])
                if not gap:
                    self._emit(tier, window)
                elif end:
                    self._tail(window)
                else:  # nothing is left to fill it: it waits for more documents
                    for piece in window:
                        self._put(piece)
                    return

    def _tail(self, window: list[tuple]) -> None:
        """The last window, cut at powers of two, the largest first."""
        left = sum(len(x[2]) for x in window)
        while left:
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, start, ids, n = window.pop(0)
                if len(ids) > size:
                    window.insert(0, (doc_id, start + size, ids[size:], n))
                    ids = ids[:size]
                part.append((doc_id, start, ids, n))
                size -= len(ids)
            self._emit(sum(len(x[2]) for x in part), part)

    def _emit(self, tier: int, window: list[tuple]) -> None:
        group, tokens = self._open.get(tier, (None, 0))
        if group is None or tokens + tier > self._step_tokens:
            group, tokens = self._base + self._groups, 0
            self._groups += 1
        self._open[tier] = (group, tokens + tier)
        sequence, offset = self._base + self._made, 0
        self._made += 1
        for doc_id, start, ids, n in window:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self._out.append((doc_id, start, len(ids), crc, n, sequence, offset, tier, group))
            offset += len(ids)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 16_384,
    pool: int = 4096,
    cached_words: int = 150_000,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with SCHEMA's columns.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each by
    itself; other columns aren't read; an empty table gives no rows. Sequences have at most tiers[0]
    tokens, and each length is a power of two. cached_words trades a worker's memory (about 40 bytes
    for each) for speed, and doesn't change the result.
    """
    schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cached_words, TOGETHER).encode_column
        packer = Packer(tiers, step_tokens, pool, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4")

        def done():
            columns = list(zip(*packer.take())) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for some in groups(batches, TOGETHER):
            for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                packer.add(doc_id, np.concatenate([ids, end]))
            yield done()
            release()
        packer.finish()
        yield done()

    keys = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return keys.mapInArrow(run, SCHEMA)
