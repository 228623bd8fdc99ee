"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among_least, cut, held_out, table

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: The training sample: so many rows of a language, of at most so many UTF-8 bytes each; with many languages the rows of
#: each become fewer, so that all together are ``SAMPLE_TOTAL`` at most, or ten of each.
SAMPLE_ROWS, SAMPLE_TOTAL = 400, 40_000
SAMPLE_BYTES = 32_768
#: Follow-the-regularised-leader: step, smoothing, and the two elastic-net penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.001
EPOCHS = 4
#: Scale of the term frequencies, which sum to it over a text.
SCALE = 30.0
_RUN = re.compile(r"[^\W\d_]+")
#: Places of a text whose n-grams are made at once.
_CHUNK = 1 << 20


def letter_runs(text: str) -> list[str]:
    """Runs of letters of the lower-cased text; figures that are no letters, such as superscripts, part them."""
    out: list[str] = []
    for run in _RUN.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the letter runs, a slice of the text at a time; anything between two runs is one bound.

    Slices overlap by the longest n-gram less one, so that cutting neither adds nor loses any.
    """
    points = np.frombuffer(("\0" + "\0".join(letter_runs(text)) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), _CHUNK):
        out, stop = [], min(at + _CHUNK, len(points))
        code = np.zeros(stop - at, np.uint64)
        for n in range(1, max(ORDERS) + 1):
            code = code[: max(0, len(points) - n + 1 - at)]
            code = code * np.uint64(0x100000001B3) + points[at + n - 1 : at + n - 1 + len(code)] + np.uint64(n)
            if n in ORDERS:
                out.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS))
        yield np.concatenate(out).astype(np.int64)


def gram_ids(text: str) -> np.ndarray:
    return np.concatenate(list(gram_slices(text)))


def train(rows: list[tuple[str, str]], seed: int = 7) -> dict:
    """Model of ``(text, label)`` rows: ``weights`` (idf x coefficient, a row a bucket), ``bias``, ``labels``, ``temperature``."""
    labels = sorted({y for _, y in rows})
    if not labels:
        return {"labels": []}
    rng = np.random.default_rng(seed)
    samples, size = [], 1 << BUCKET_BITS
    for text, label in rows:  # each text, and a short cut of it, so that short texts are known too
        samples.append((gram_ids(text), labels.index(label)))
        if len(text) > 40:
            at = int(rng.integers(0, len(text) - 40))
            samples.append((gram_ids(text[at : at + int(rng.integers(12, 80))]), labels.index(label)))
    seen = np.zeros(size)
    for ids, _ in samples:
        seen[np.unique(ids)] += 1
    idf = np.log((1 + len(samples)) / (1 + seen)) + 0.1
    data = []
    for ids, y in samples:
        found, count = np.unique(ids, return_counts=True)
        data.append((found, SCALE * count / len(ids) * idf[found], y))
    order = rng.permutation(len(data))
    rest = order[: len(order) // 5]
    fit = order[len(rest) :] if len(order) >= 10 else order
    k = len(labels)
    z, n, zb, nb = np.zeros((size, k), np.float32), np.zeros((size, k), np.float32), np.zeros(k), np.zeros(k)

    def solve(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, values, y = data[i]
            w, b = solve(z[ids], n[ids], L1), solve(zb, nb, 0)
            error = softmax(values @ w + b)
            error[y] -= 1
            for gradient, zs, ns, ws, at in ((values[:, None] * error, z, n, w, ids), (error, zb, nb, b, slice(None))):
                more = ns[at] + gradient**2
                zs[at] += gradient - (np.sqrt(more) - np.sqrt(ns[at])) / ALPHA * ws
                ns[at] = more
    w, b = solve(z, n, L1), solve(zb, nb, 0)
    logits = np.array([data[i][1] @ w[data[i][0]] + b for i in (rest if len(rest) else fit)])
    truth = np.array([data[i][2] for i in (rest if len(rest) else fit)])
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 41))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in grid]
    return {"labels": labels, "weights": (SCALE * w * idf[:, None]).astype(np.float32), "bias": b, "temperature": float(grid[int(np.argmin(loss))]), "zeros": float((w == 0).mean())}


def predict(model: dict, text: str | None) -> tuple[str, float]:
    """Label and calibrated probability; ``und`` with 0 where there is no letter or nothing was learned."""
    if not text or not model["labels"] or not any(map(str.isalpha, text)):
        return "und", 0.0
    total, n = np.zeros(len(model["labels"])), 0
    for ids in gram_slices(text):
        total += model["weights"][ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    x = (total / n + model["bias"]) / model["temperature"]
    e = np.exp(x - x.max())
    best = int(np.argmax(e))
    return model["labels"][best], float(e[best] / e.sum())


def training_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample, in an order that only the rows decide; rows of the held-out fold never enter."""
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("y"), F.col(f"`{doc_id}`").alias("i"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")) & (F.octet_length("t") <= SAMPLE_BYTES))
    rows = rows.select("t", "y", F.shiftrightunsigned(F.xxhash64("i", "t"), 1).alias("h"))
    known = cut(rows.groupBy("y").agg(F.count("*").alias("n")))  # a row a language
    languages = known.count()
    most = max(10, min(SAMPLE_ROWS, SAMPLE_TOTAL // max(1, languages)))
    near = rows.join(F.broadcast(known) if languages <= 100_000 else known, "y").filter(among_least("h", "n", most)).drop("n")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))).filter(F.col("r") <= most)
    return sorted((r["t"], r["y"]) for r in best.select("t", "y").collect())


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row of ``docs``.

    The model learns from a bounded sample of the rows outside the held-out fold; its size is bounded by the parameters
    above. Every language of those rows can be predicted; the weights take 262 KB for each. Whole texts are scored. Null texts and texts without a letter get ``und`` with score 0, as does everything
    where no row can be learned from. Repeated rows each get a row; an empty table gives none; extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, text, doc_id, lang)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model.value, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))
