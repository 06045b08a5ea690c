"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Pre-tokens are the blank-separated words of a text with a leading word mark. A node of the trie of
distinct ones has the best score of its prefix and the number of pieces in it, computed once for all
words that share the prefix. At the end of a word the count is stored, and a document's count is the
sum over its words.

Scores are log-probabilities by Zipf's law on the rank of a piece in the vocabulary file: -ln(rank +
1) - ln(H), H the harmonic number of the vocabulary's size. A character that no piece covers counts as
its UTF-8 bytes, at a score below all pieces each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import groups, lean

MARK = "▁"
#: Bytes of texts whose distinct words share a trie.
TOGETHER = 1 << 21

_held: dict[tuple[str, int], "PrefixTrie"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file, control and byte pieces left out, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    total = math.log(sum(1 / (k + 1) for k in range(n)))
    return {sp.id_to_piece(k): -math.log(k + 1) - total for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}


class PrefixTrie:
    """counts(words): the pieces in the best segmentation of each; of equal scores, the fewest.

    Sorted distinct words are the trie in depth-first order: the path from the root to the current
    node is all that is held of it, with the forward score and the piece count of each prefix on it.
    Counts of words (the terminals) are held in two generations of at most `terminals` each, so
    memory is bounded; words of more than 64 characters aren't held.
    """

    def __init__(self, scores: dict[str, float], terminals: int = 300_000):
        # every end of a piece: its score, or None if it is only the end of a longer one
        self._ends: dict[str, float | None] = {}
        for piece in scores:
            for k in range(len(piece)):
                self._ends.setdefault(piece[k:], None)
        self._ends.update(scores)
        self._byte = min(scores.values(), default=0.0) - 10.0
        self._most = terminals
        self._young: dict[str, int] = {}
        self._old: dict[str, int] = {}
        self.nodes = 0

    def counts(self, words: set[str]) -> dict[str, int]:
        young, old = self._young, self._old
        new, known = [], {}
        for w in words:
            n = young.get(w)
            if n is None and (n := old.get(w)) is not None:
                young[w] = n
            if n is None:
                new.append(w)
            else:
                known[w] = n
        for w, n in self._walk(sorted(new)):
            known[w] = n
            if len(w) <= 64:
                young[w] = n
        if len(young) > self._most:
            self._old, self._young = young, {}
        return known

    def _walk(self, words: list[str]) -> Iterator[tuple[str, int]]:
        ends, byte, none = self._ends, self._byte, ()
        best, pieces, last = [0.0], [0], ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            self.nodes += len(word) - shared
            for i in range(shared + 1, len(word) + 1):
                n = 1 if (char := word[i - 1]) < "\x80" else len(char.encode("utf-8", "surrogatepass"))
                top, fewest = best[i - 1] + n * byte, pieces[i - 1] + n
                for j in range(i - 1, -1, -1):
                    score = ends.get(word[j:i], none)
                    if score is none:
                        break
                    if score is not None:
                        score += best[j]
                        if score > top or score == top and pieces[j] + 1 < fewest:
                            top, fewest = score, pieces[j] + 1
                best.append(top)
                pieces.append(fewest)
            last = word
            yield word, pieces[len(word)]


def trie(path: str, terminals: int) -> PrefixTrie:
    """This worker process's trie; later tasks of the worker use it again."""
    if (path, terminals) not in _held:
        _held[path, terminals] = PrefixTrie(piece_scores(path), terminals)
    return _held[path, terminals]


def count_texts(t: PrefixTrie, texts: list[str | None]) -> list[tuple[int, int]]:
    """(tokens, pre-tokens) of each whole text."""
    split = [[MARK + w for w in x.split()] if x else [] for x in texts]
    known = t.counts({w for words in split for w in words})
    return [(sum(map(known.__getitem__, words)), len(words)) for words in split]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, terminals: int = 300_000) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every whole text, in one pass without a shuffle.

    A null, empty or blank text counts 0; null ids stay null; repeated rows are each counted; other
    columns aren't read; an empty table gives no rows.
    """
    path = model or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(path, terminals)
        for some in groups(batches, TOGETHER):
            got = count_texts(t, some.column(1).to_pylist())
            columns = [some.column(0).combine_chunks(), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return keys.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
