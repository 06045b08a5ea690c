"""Context windows, the keyword score, and the hook for a trained classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V


def context_window(content: Column, line_no: Column, around: int = 10) -> Column:
    """The lines around a line, the line itself marked; empty outside the content."""

    def of(ls: Column) -> Column:
        first = F.greatest(line_no - around, F.lit(1))
        n = F.least(line_no + around, F.size(ls)) - first + 1
        marked = F.transform(F.slice(ls, first, n), lambda x, i: F.when(i + first == line_no, F.concat(F.lit(">>> LINE "), line_no.cast("string"), F.lit(" <<<\n"), x)).otherwise(x))
        return F.when((line_no < 1) | (line_no > F.size(ls)), "").otherwise(T.blank_trim(F.array_join(marked, "\n")))

    return T.let(F.split(content, "\n", -1), of)


def keyword_score(window: Column) -> Column:
    """struct(label, label_name, confidence): 0.5, 0.15 up for each credential word that is there, 0.2
    down for each other word, clamped; label 1 from 0.55."""
    low = F.lower(window)
    score = F.lit(0.0)
    for w in V.ML_POSITIVE:
        score = score + F.when(low.contains(w), 0.15).otherwise(0.0)
    for w in V.ML_NEGATIVE:
        score = score - F.when(low.contains(w), 0.2).otherwise(0.0)
    p = T.clamp(0.5 + score)
    return T.let(p, lambda c: F.struct(F.when(c >= 0.55, 1).otherwise(0).alias("label"), F.when(c >= 0.55, "SECRET").otherwise("NOT_SECRET").alias("label_name"), F.round(c, 4).alias("confidence")))


def wordpiece(text: str, vocab: dict[str, int], max_length: int = 512) -> list[int]:
    """Greedy longest-match word pieces with [CLS] and [SEP], padded by [PAD]."""
    import re

    unknown, out = vocab.get("[UNK]", 100), [vocab.get("[CLS]", 101)]
    for word in re.findall(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]", text.lower()):
        at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
            out.append(vocab[("##" if at else "") + word[at:end]] if end else unknown)
            at = end or at + 1
    out = out[: max_length - 1] + [vocab.get("[SEP]", 102)]
    return out + [vocab.get("[PAD]", 0)] * (max_length - len(out))


def onnx_score(rows: DataFrame, model_path: str, vocab_path: str, text_col: str = "window", max_length: int = 512) -> DataFrame:
    """rows with ml_label and ml_score by an ONNX classifier; model and vocabulary lie on all workers."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, ml_label int, ml_score double"

    def run(batches):
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)
        with open(vocab_path, encoding="utf-8") as f:
            vocab = {w.rstrip("\n"): k for k, w in enumerate(f)}
        for pdf in batches:
            ids = np.array([wordpiece(t or "", vocab, max_length) for t in pdf[text_col]], np.int64).reshape(-1, max_length)
            logits = session.run(None, {"input_ids": ids, "attention_mask": (ids != vocab.get("[PAD]", 0)).astype(np.int64)})[0]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            yield pdf.assign(ml_label=p.argmax(axis=1).astype("int32"), ml_score=p.max(axis=1).astype("float64"))

    return rows.mapInPandas(run, schema)


#: A line that one of these finds is a candidate for training.
CANDIDATE_PATTERNS = [
    r"""([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*["']([^"']{8,})["']""",
    r"export\s+([A-Z_][A-Z0-9_]*)\s*=\s*(\S{8,})",
    r"^([A-Z_][A-Z0-9_]*)\s*=\s*([^\s#]{8,})",
    r'"([A-Za-z_]\w*)"\s*:\s*"([^"]{8,})"',
    r"(-----BEGIN\s+\w[\w ]*PRIVATE\s+KEY-----)",
    r"((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|mssql)://\S+)",
    r"//registry\.npmjs\.org/:_authToken=([A-Za-z0-9_-]{36,})",
    r"(Server=[^;]+;.*Password=[^;]+)",
]


def candidate_line(line: Column) -> Column:
    return T.any_of(line.rlike(p) for p in CANDIDATE_PATTERNS)


def training_samples(files: DataFrame, truth: DataFrame, source: str, around: int = 10, negatives_per_file: int = 3, most_negatives: int | None = None, content_col: str = "content") -> DataFrame:
    """(text, label, source, file, line): windows of candidate lines; truth (path, line_no, label) gives
    labels, the rest are negatives, at most negatives_per_file of a file, lowest lines first, and
    most_negatives in all, by a hash of their place."""
    from pyspark.sql import Window

    rows = files.select("path", F.col(content_col).alias("content"), F.posexplode(F.split(content_col, "\n", -1)).alias("n", "line")).withColumn("line_no", F.col("n") + 1)
    rows = rows.join(truth, ["path", "line_no"], "left").where(F.col("label").isNotNull() | candidate_line(F.col("line")))
    known = F.col("label").isNotNull()
    rank = F.row_number().over(Window.partitionBy("path", known).orderBy("line_no"))
    rows = rows.withColumn("rank", rank).where(known | (F.col("rank") <= negatives_per_file))
    out = rows.select(context_window(F.col("content"), F.col("line_no"), around).alias("text"), F.coalesce("label", F.lit(0)).alias("label"), F.lit(source).alias("source"), F.col("path").alias("file"), F.col("line_no").alias("line"))
    out = out.dropDuplicates(["source", "file", "line"])
    if most_negatives is None:
        return out
    extra = out.where("label = 0").orderBy(F.xxhash64("file", "line"), "file", "line").limit(most_negatives)
    return out.where("label <> 0").unionByName(extra)


def dataset(*samples: DataFrame, seed: int = 42) -> DataFrame:
    """All samples, one of each source, file and line, in an order that the seed fixes."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, samples).dropDuplicates(["source", "file", "line"])
    return rows.orderBy(F.xxhash64("source", "file", "line", F.lit(seed)), "source", "file", "line")


def load_model(folder: str) -> dict:
    """What a model folder has: metadata, vocabulary and mode (onnx, or heuristic without a model)."""
    import json
    from pathlib import Path

    at = Path(folder)
    meta = json.loads((at / "metadata.json").read_text()) if (at / "metadata.json").exists() else {}
    if not (at / "vocab.txt").exists():
        raise FileNotFoundError(f"{folder} has no vocab.txt")
    model = at / "model.onnx"
    return {"metadata": meta, "vocab": str(at / "vocab.txt"), "model": str(model) if model.exists() else None, "mode": "onnx" if model.exists() else "heuristic"}


def predict_lines(files: DataFrame, at: DataFrame, model: dict | None = None, around: int = 10) -> DataFrame:
    """(path, line_no, ml_label, ml_score) of places (path, line_no), by a model or by keywords."""
    rows = files.join(at, "path").select("path", "line_no", context_window(F.col("content"), F.col("line_no"), around).alias("window"))
    if model and model["mode"] == "onnx":
        return onnx_score(rows, model["model"], model["vocab"]).drop("window")
    return rows.select("path", "line_no", keyword_score(F.col("window")).alias("s")).select("path", "line_no", F.col("s.label").alias("ml_label"), F.col("s.confidence").alias("ml_score"))


def training_gate(samples: DataFrame, artifacts: list[str] = (), least: int = 50) -> list[str]:
    """What keeps a training from going on: too few samples, or artifacts that aren't there."""
    from pathlib import Path

    n = samples.limit(least).count()
    return ([f"{n} samples, {least} are needed"] if n < least else []) + [f"{a} is missing" for a in artifacts if not Path(a).exists()]


def scores(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, precision, recall and f1 of 0/1 labels."""
    l, p = F.col(label) == 1, F.col(predicted) == 1
    c = predictions.agg(F.count_if(l & p).alias("tp"), F.count_if(~l & p).alias("fp"), F.count_if(l & ~p).alias("fn"), F.count(F.lit(1)).alias("n"))
    zero = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = c.withColumns({"accuracy": F.coalesce((F.col("n") - F.col("fp") - F.col("fn")) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), "precision": zero("tp", F.col("tp") + F.col("fp")), "recall": zero("tp", F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
