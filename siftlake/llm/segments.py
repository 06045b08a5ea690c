"""Exact byte-level BPE encoding of whole texts, with a bounded cache of words.

The pre-tokenizer of a byte-level BPE always starts a new piece at a blank that stands between two
characters that aren't white space, and its matches look neither back past that blank nor ahead past
the end of such a segment. A line feed between two such characters is a piece of its own. So the ids
of a text are the ids of its segments one after another, each segment but the first carrying its
leading blank or line feed.

Many texts are cut at once and their distinct segments found in Arrow; only segments that weren't seen
lately go through the tokenizers library, many joined in one call; and the ids of all segments are
gathered in numpy. Nothing is done word by word in Python.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line feeds, next to other white space, or at an end.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
_SPACE = r"[ \t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A letter below U+0250 and marks after it, at the end.
_MARKED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][,.!?]+\z"
#: First character of a text's first segment among the keys of segments.
_FIRST = "\t"
#: Segments that go through the library in one text.
_JOINED = 512

_large = functools.partial(pa.scalar, type=pa.large_string())

_held: dict[tuple[str, int, int], "SegmentEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None, cached: int = 400_000, together: int = 1 << 23) -> "SegmentEncoder":
    """This worker process's encoder for a tokenizer file; later tasks of the worker use it again."""
    path = path or default_path()
    key = (path, cached, together)
    if key not in _held:
        _held[key] = SegmentEncoder(*key)
    return _held[key]


class _Segments:
    """Segments and their ids: one flat array of ids, and where each segment's begin."""

    def __init__(self, keys: pa.Array, ids: np.ndarray, begin: np.ndarray):
        self.keys, self.ids, self.begin = keys, ids, begin

    @classmethod
    def of(cls, parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> "_Segments":
        """From (keys, ids, number of ids of each key)."""
        none = np.zeros(0, "<u4")
        lengths = np.concatenate([np.zeros(1, np.int64), *[n for _, _, n in parts]])
        keys = pa.concat_arrays([pa.array([], pa.large_string()), *[k for k, _, _ in parts]])
        return cls(keys, np.concatenate([none, *[i for _, i, _ in parts]]), np.cumsum(lengths))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these segments one after another, and where each one's end."""
        start, n = self.begin[which], self.begin[which + 1] - self.begin[which]
        after = np.cumsum(n)
        at = np.repeat(start - (after - n), n)
        at += np.arange(len(at))
        return self.ids[at], after

    def subset(self, which: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, after = self.take(which)
        return self.keys.take(pa.array(which)), ids, np.diff(after, prepend=0)


class SegmentEncoder:
    """encode(text): its ids as little-endian unsigned 32-bit integers; None encodes as empty.

    At most `cached` segments are held, those of the last call in any case: about 40 bytes each. When
    there are more, those that the last call didn't use go. Texts of about `together` bytes are taken
    at a time.
    """

    def __init__(self, path: str, cached: int = 400_000, together: int = 1 << 23):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._cached, self._together = cached, together
        self._known = _Segments.of([])
        pieces = self._tokenizer.get_vocab()
        self._begins = np.zeros(max(pieces.values()) + 1, bool)
        blank, feed = (self._tokenizer.encode(c, add_special_tokens=False).tokens for c in " \n")
        self._begins[[i for piece, i in pieces.items() if piece.startswith(blank[0])]] = True
        self._feed = pieces[feed[0]]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The ids of each text of a column of strings, in order."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self._together, "right")))
            flat, begin = self._encode(texts.slice(at, to - at))
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                yield flat[a:b]
            at = to

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_large(_FIRST), plain, _large("")), "\n", " \n"), " ")
        keys, counts = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        if odd.any():
            cuts = [_CUT.split(_FIRST + t) for t in texts.filter(pa.array(odd)).to_pylist()]
            keys = pa.concat_arrays([keys, pa.array([s for c in cuts for s in c], pa.large_string())])
            counts = np.r_[counts, [len(c) for c in cuts]]
        coded = keys.dictionary_encode()
        flat, after = self._distinct(coded.dictionary).take(coded.indices.to_numpy())
        begin = np.r_[0, after][np.r_[0, np.cumsum(counts)]]
        if not odd.any():
            return flat, begin
        place = np.empty(len(odd), np.int64)
        place[np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]] = np.arange(len(odd))
        return np.concatenate([flat[begin[k] : begin[k + 1]] for k in place]), np.r_[0, np.cumsum(np.diff(begin)[place])]

    def _distinct(self, keys: pa.Array) -> _Segments:
        """Distinct keys with their ids. A mark after a letter is encoded apart from its stem: a match
        ends between them, whatever else stands around."""
        marked = pc.match_substring_regex(keys, _MARKED)
        tailed = marked.to_numpy(zero_copy_only=False)
        tails = pc.replace_substring_regex(keys.filter(marked), r"(?s)\A.*[^,.!?]", _FIRST)
        stems = pc.if_else(marked, pc.replace_substring_regex(keys, r"[,.!?]+\z", ""), keys)
        coded = pa.concat_arrays([stems, tails]).dictionary_encode()
        slots = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        pairs = np.full((len(keys), 2), -1, np.int64)
        pairs[:, 0], pairs[tailed, 1] = slots[: len(keys)], slots[len(keys) :]
        ids, after = self._known.take(pairs[pairs >= 0])
        return _Segments(keys, ids, np.r_[0, after[np.cumsum(1 + tailed) - 1]])

    def _slots(self, keys: pa.Array) -> np.ndarray:
        """The places of distinct keys among the known segments, where they are put if they aren't there."""
        at = pc.index_in(keys, value_set=self._known.keys)
        new = pc.is_null(at)
        missing = new.to_numpy(zero_copy_only=False)
        slots = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not missing.any():
            return slots
        fresh = self._library(keys.filter(new))
        known = self._known
        if len(known.keys) + int(missing.sum()) > self._cached:
            used, slots[~missing] = np.unique(slots[~missing], return_inverse=True)
            parts = [known.subset(used)]
        else:
            parts = [(known.keys, known.ids, np.diff(known.begin))]
        self._known = made = _Segments.of([*parts, *fresh])
        # what the library gave comes kind by kind
        slots[missing] = pc.index_in(keys.filter(new), value_set=made.keys).to_numpy(zero_copy_only=False)
        return slots

    def _library(self, keys: pa.Array) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(keys, ids, number of ids of each) of distinct keys. They are joined, and the ids part where
        a blank or a line feed begins; a key with other white space goes by itself."""
        feed = pc.match_substring_regex(keys, r"\A[\t\n]")
        body = pc.replace_substring_regex(keys, r"\A[\t\n]", "")
        alone = pc.or_(pc.match_substring_regex(body, _SPACE), pc.equal(body, ""))
        out = []
        for mark, some in ((" ", pc.and_not(pc.invert(feed), alone)), ("\n", pc.and_not(feed, alone))):
            bodies, named = body.filter(some), keys.filter(some)
            if not len(bodies):
                continue
            cuts = pa.array([*range(0, len(bodies), _JOINED), len(bodies)], pa.int64())
            lists = pa.LargeListArray.from_arrays(cuts, bodies)
            flat = self._ids([mark + t for t in pc.binary_join(lists, _large(mark)).to_pylist()])
            starts = np.flatnonzero(self._begins[flat] if mark == " " else flat == self._feed)
            if len(starts) != len(bodies):
                raise ValueError("segments and their ids don't agree")
            lengths = np.diff(np.r_[starts, len(flat)])
            if mark == "\n":
                # the line feed belongs to a segment that isn't a text's first
                first = pc.starts_with(named, _FIRST).to_numpy(zero_copy_only=False)
                flat, lengths = np.delete(flat, starts[first]), lengths - first
            out.append((named, flat, lengths))
        if len(rest := keys.filter(alone)):
            whole = [key[1:] if key[0] == _FIRST else key if key[0] == "\n" else " " + key for key in rest.to_pylist()]
            each = [self._ids([t]) for t in whole]
            out.append((rest, np.concatenate(each), np.array([len(x) for x in each], np.int64)))
        return out

    def _ids(self, texts: list[str]) -> np.ndarray:
        out = array("I")
        for at in range(0, len(texts), 32):
            for e in self._tokenizer.encode_batch_fast(texts[at : at + 32], add_special_tokens=False):
                out.extend(e.ids)
        return np.frombuffer(out, "<u4")
