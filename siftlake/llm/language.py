"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 1 to 4 letters, blanks as word ends,
hashed to a fixed number of buckets); a linear softmax over it gives the languages. Both are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows, whose whole texts are
counted on executors: the driver gets the counts of buckets only. Part of the sample is held back to calibrate: a temperature for the scores, and the score below which a text is rejected.

Since the model is linear in the embeddings, embedding and softmax weights fold into one table of
buckets x languages, which is all that workers need (buckets * languages * 4 bytes, whatever the
corpus).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import lean, release

UNKNOWN = "und"
#: Characters of a text that are worked on at a time.
CHUNK = 1 << 18
ROWS = 256
#: Buckets that subwords are hashed to.
BUCKETS = 1 << 14

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str, buckets: int) -> tuple[np.ndarray, int]:
    """(count of each bucket, number of letters) over the whole text, whatever its length."""
    counts, letters, table = np.zeros(buckets, np.int64), 0, _letter_table()
    for at in range(0, max(len(text), 1), CHUNK):
        # three characters more, so that no subword across the cut is lost or counted twice
        piece = text[max(0, at - 3) : at + CHUNK].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = table[c]
        new = len(piece) if at == 0 else max(0, len(piece) - 3)
        letters += int(is_letter[len(piece) - new :].sum())
        c = np.where(is_letter, c, 32).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, 5):
            if len(c) < n:
                break
            # h[i] covers c[i : i + n]
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            index = (mixed >> np.uint64(40)).astype(np.int64) % buckets
            used = is_letter[: len(h)] if n == 1 else is_letter[: len(h)] | is_letter[n - 1 :]
            ends = np.arange(n - 1, len(c))
            if at:
                used = used & (ends >= len(piece) - new)
            counts += np.bincount(index[used], minlength=buckets)
    return counts, letters


@dataclass
class Model:
    """table: buckets x languages. Scores are divided by temperature; below `reject` a text is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); a text that is null or has no letter is `und`, 0, rejected."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, True
        counts, letters = subwords(text, len(self.table))
        if not letters:
            return UNKNOWN, 0.0, True
        seen = np.flatnonzero(counts)
        weights = counts[seen] / counts[seen].sum()
        p = _softmax((weights @ self.table[seen] + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best])), bool(p[best] < self.reject)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _views(text: str) -> list[str]:
    """The text and a few short stretches of it, so that short texts are learnt as well."""
    words = text.split()
    cuts = [words[k : k + n] for k, n in ((0, 4), (len(words) // 3, 8), (len(words) // 2, 16), (2 * len(words) // 3, 2))]
    return [text, *[" ".join(c) for c in cuts if c]]


#: A view of a text: its buckets, their shares, and whether it is the whole text.
View = tuple[np.ndarray, np.ndarray, bool]


def views(text: str, buckets: int) -> list[View]:
    """The views with a letter."""
    out = []
    for number, view in enumerate(_views(text)):
        counts, letters = subwords(view, buckets)
        if letters:
            seen = np.flatnonzero(counts)
            out.append((seen.astype(np.int32), (counts[seen] / counts[seen].sum()).astype(np.float32), number == 0))
    return out


def labelled(docs: DataFrame, per_language: int, most: int, text_col: str, lang_col: str, id_col: str, buckets: int) -> list[tuple[str, list[View]]]:
    """A bounded sample of labelled rows, as (language, views): those of each language with the least
    hash of id, text and place in the table, so rows that repeat are drawn one by one.

    Two aggregations over all rows set a rate for each language; the rows below it are few enough to
    sort on the driver, and their whole texts stay on the executors.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # of many languages the most frequent get their share first
    sizes = {r[lang_col]: r["n"] for r in known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(max(1, most // 8)).collect()}
    each = min(per_language, most // max(1, len(sizes)))
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.monotonically_increasing_id(), F.lit("language sample"))
    chance = drawn.bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.3 * each / n))).otherwise(rate)
    rows = known.select(F.col(lang_col).alias("lang"), chance.alias("chance"), F.col(text_col).cast("string").alias("text")).where(F.col("chance") < rate)
    schema = pa.schema([("lang", pa.string()), ("chance", pa.float64()), ("seen", pa.list_(pa.binary())), ("share", pa.list_(pa.binary())), ("whole", pa.list_(pa.bool_()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                made = [views(t.as_py(), buckets) for t in some.column(2)]
                parts = [[[x.tobytes() for x, _, _ in v] for v in made], [[x.tobytes() for _, x, _ in v] for v in made], [[x for _, _, x in v] for v in made]]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c, f.type) for c, f in zip(parts, list(schema)[2:])]], schema=schema)

    out, taken = [], dict.fromkeys(sizes, 0)
    found = rows.mapInArrow(run, "lang string, chance double, seen array<binary>, share array<binary>, whole array<boolean>").collect()
    for r in sorted(found, key=lambda r: (r.lang, r.chance, r.seen)):
        if taken[r.lang] < each:
            taken[r.lang] += 1
            out.append((r.lang, [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32), w) for a, b, w in zip(r.seen, r.share, r.whole)]))
    return out


def train(
    sample: list[tuple[str, list[View]]],
    buckets: int = BUCKETS,
    width: int = 12,
    epochs: int = 6,
    rate: float = 20.0,
    batch: int = 32,
    lost: float = 0.002,
    seed: int = 17,
) -> Model:
    """Train on (language, views) pairs; every fifth pair is held back for calibration.

    `reject` is the score below which lie at most the share `lost` of the held-back whole texts that
    are predicted rightly.
    """
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rows: dict[bool, list] = {True: [], False: []}
    for k, (lang, seen) in enumerate(sample):
        rows[k % 5 == 4] += [(index, share, languages.index(lang), whole) for index, share, whole in seen]
    embedding, weights, bias = learn(rows[False] or rows[True], len(languages), buckets, width, epochs, rate, batch, seed)
    table = (embedding @ weights).astype(np.float32)
    check = rows[True] or rows[False]
    if not check:
        return Model(languages, table, bias, 1.0, 0.0)
    raw = np.array([x[1] @ table[x[0]] + bias for x in check])
    truth = np.array([x[2] for x in check])
    temperatures = np.geomspace(0.05, 5, 60)
    losses = [-np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    p = _softmax(raw / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    scores = score[right & np.array([x[3] for x in check])]
    reject = float(np.quantile(scores, lost, method="lower")) if len(scores) else 0.0
    return Model(languages, table, bias, temperature, reject)


def learn(rows: list[tuple], languages: int, buckets: int, width: int, epochs: int, rate: float, batch: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embedding, weights, bias) by stochastic gradient descent on rows (buckets, shares, language, whole)."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    weights, bias = np.zeros((width, languages), np.float32), np.zeros(languages, np.float32)
    steps, done = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[k] for k in order[at : at + batch]]
            index, share = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
            begin = np.r_[0, np.cumsum([len(x[0]) for x in some])[:-1]]
            mean = np.add.reduceat(embedding[index] * share[:, None], begin)
            step = rate * (1 - done / steps)
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(some)), [x[2] for x in some]] -= 1
            error = (error / len(some)).astype(np.float32)
            back = np.repeat(error @ weights.T, [len(x[0]) for x in some], axis=0) * share[:, None]
            weights -= step * mean.T @ error
            bias -= step * error.sum(axis=0)
            used, slot = np.unique(index, return_inverse=True)
            for d in range(width):
                embedding[used, d] -= step * np.bincount(slot, back[:, d], len(used)).astype(np.float32)
            done += 1
    return embedding, weights, bias


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = 400,
    most: int = 4000,
    **how,
) -> Model:
    """Learn from at most per_language rows of a language and `most` rows in all, from their whole texts;
    null labels and null texts aren't learnt from. Of more than most / 8 languages, the most frequent
    are learnt."""
    model = train(labelled(docs, per_language, most, text_col, lang_col, id_col, how.get("buckets", BUCKETS)), **how)
    release()  # the driver goes on without the sample
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, rejected: bool | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with lang_pred, score and rejected, for every whole text.

    Null texts, and texts without a letter, get `und`, 0.0 and true. Columns of docs that have these
    names are replaced. An empty table gives no rows; repeated rows are each predicted. With
    `rejected` set, only rows of that verdict are returned.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(F.col(text_col).cast("string").alias("__text"), *[docs[c] for c in keep])
    out = docs.select(*[docs[c] for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                got = [m.predict(t.as_py()) for t in some.column(0)]
                columns = [*some.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
                made = pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])
                yield made if rejected is None else made.filter(pa.array([g[2] is rejected for g in got], pa.bool_()))

    return source.mapInArrow(run, out)
