"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among_least, held_out, packed, table, unpacked

#: The training sample: so many rows of each label at most, of at most so many UTF-8 bytes each.
SAMPLE_ROWS = 700
SAMPLE_BYTES = 16_384
#: Windows of words, and the words from one window's start to the next: half a window, so that some window holds
#: every passage of up to 17 words whole.
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 4, 4
WORD_DIM, WORD_BITS = 3, 12
CHAR_DIM, CHAR_BITS = 3, 12
CHAR_ORDERS = (3, 4, 5)
#: Hash bits of the evidence tables: smoothed log-odds of words and of character n-grams in the training sample.
EVIDENCE_BITS = 18
EPOCHS, STEP, BATCH = 6, 0.03, 128
#: Words whose input projections a worker keeps; beyond, it starts anew.
CACHE = 200_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def hash_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words; hashes of all their character n-grams (with bounds) and the word that each is in."""
    points = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    grams, owners, code = [], [], np.zeros(len(points), np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, max(CHAR_ORDERS) + 1):
        code = (code[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * odd
        code ^= code >> np.uint64(31)
        if n in CHAR_ORDERS:
            inside = owner[: len(code)] == owner[n - 1 :]
            grams.append(code[inside])
            owners.append(owner[: len(code)][inside])
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(points)) - np.repeat(starts, lengths)).astype(np.uint64)
    whole = np.add.reduceat((points + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * odd, starts)
    whole = (whole ^ (whole >> np.uint64(29))) * odd
    gram, own = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return whole, gram[order], own[order]


def _log_odds(sets: Iterable[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket between toxic and other texts, nearer to 0 by two standard errors: what is rare proves little."""
    seen = np.zeros((2, 1 << EVIDENCE_BITS))
    for s, y in zip(sets, labels):
        seen[y, s] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * error)).astype(np.float32)


def _inputs(model: dict, words: list[str]) -> tuple[np.ndarray, tuple]:
    """Input vectors of different words: word embedding, mean character embedding, and three figures of evidence."""
    whole, gram, own = hash_words(words)
    first = np.searchsorted(own, np.arange(len(words)))
    w = (whole >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    c = (gram >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    evidence = model["char_odds"][(gram >> np.uint64(64 - EVIDENCE_BITS)).astype(np.int64)]
    count = np.diff(np.append(first, len(own)))[:, None]
    chars = np.add.reduceat(model["chars"][c], first) / count
    top = np.maximum.reduceat(evidence, first)[:, None]
    mean = np.add.reduceat(evidence, first)[:, None] / count
    odds = model["word_odds"][(whole >> np.uint64(64 - EVIDENCE_BITS)).astype(np.int64)][:, None]
    return np.concatenate([model["words"][w], chars, odds, top, mean], axis=1).astype(np.float32), (w, c, own, count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _forward(model: dict, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Logit of each window. x: (time, 2, window, 3 hidden) projected inputs, the second direction reversed in time."""
    steps, _, count, _ = x.shape
    h, u = np.zeros((2, count, HIDDEN), np.float32), model["u"]
    states, saved = np.empty((steps, 2, count, HIDDEN), np.float32), []
    for t in range(steps):
        g = h @ u
        rz = _sigmoid(x[t, :, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN])
        r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
        n = np.tanh(x[t, :, :, 2 * HIDDEN :] + r * g[:, :, 2 * HIDDEN :])
        m = mask[t]
        new = h + m * (1 - z) * (n - h)
        if keep:
            saved.append((h, g, r, z, n, m))
        h = states[t] = new
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # (time, window, 2 hidden)
    a = np.tanh(both @ model["att"])
    score = np.where(mask[:, 0, :, 0] > 0, a @ model["att_v"], -1e9)
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * both).sum(0)
    return pooled @ model["out"] + model["bias"], [saved, both, a, weight, pooled]


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of all overlapping windows; the last one ends with the text."""
    count = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(0, np.minimum(k * STRIDE, lengths[doc] - WINDOW))
    return doc, start, np.minimum(lengths[doc], WINDOW)


def _project(model: dict, x: np.ndarray) -> np.ndarray:
    """(word, 2, 3 hidden), with a last row of zeros for the places behind a text's end."""
    out = np.einsum("wd,kdh->wkh", x, model["w"]) + model["b"]
    return np.concatenate([out, np.zeros((1, *out.shape[1:]), out.dtype)]).astype(np.float32)


def _gather(projected: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of windows for ``_forward``, their mask, and the word at each (time, direction, window)."""
    steps = int(size.max())
    t = np.arange(steps)[:, None]
    # both directions see the words in the window's order or reversed; short windows are padded behind and in front
    place = np.where(t < size, start + t, -1)
    at = np.stack([place, place[::-1]], axis=1)
    word = np.where(at >= 0, ids[np.maximum(at, 0)] if len(ids) else -1, -1)
    mask = (at >= 0).astype(np.float32)[..., None]
    x = np.empty((steps, 2, len(start), projected.shape[2]), np.float32)
    for k in (0, 1):
        x[:, k] = projected[word[:, k], k]
    return x, mask, word


def score_windows(model: dict, projected: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 4096) -> np.ndarray:
    out = np.empty(len(start), np.float32)
    for at in range(0, len(start), block):
        x, mask, _ = _gather(projected, ids, start[at : at + block], size[at : at + block])
        out[at : at + block] = _forward(model, x, mask, False)[0]
    return out


def _backward(model: dict, x: np.ndarray, mask: np.ndarray, tape: list, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the projected inputs; slope: of the loss by each logit."""
    saved, both, a, weight, pooled = tape
    g = {"out": pooled.T @ slope, "bias": slope.sum()}
    d_pooled = slope[:, None] * model["out"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = (both * d_pooled).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_a = d_score[:, :, None] * model["att_v"] * (1 - a * a)
    g["att_v"] = np.einsum("twa,tw->a", a, d_score)
    g["att"] = np.einsum("twh,twa->ha", both, d_a)
    d_both = d_both + d_a @ model["att"].T
    d_states = np.stack([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1)
    u, d_u = model["u"], np.zeros_like(model["u"])
    dh, dx = np.zeros_like(d_states[0]), np.empty_like(x)
    for t in range(len(saved) - 1, -1, -1):
        h, gate, r, z, n, m = saved[t]
        dh = dh + d_states[t]
        dn = dh * m * (1 - z) * (1 - n * n)
        dz = -dh * m * (n - h) * z * (1 - z)
        dr = dn * gate[:, :, 2 * HIDDEN :] * r * (1 - r)
        dg = np.concatenate([dr, dz, dn * r], axis=2)
        dx[t] = np.concatenate([dr, dz, dn], axis=2)
        d_u += np.einsum("kwh,kwg->khg", h, dg)
        dh = dh * (1 - m * (1 - z)) + dg @ u.transpose(0, 2, 1)
    return g | {"u": d_u}, dx


def _gradients(model: dict, words: list[str], ids: np.ndarray, start: np.ndarray, size: np.ndarray, slope_of: Callable[[np.ndarray], np.ndarray]) -> dict:
    """Gradients of all trained parameters over windows of the words ``ids``; ``slope_of`` gives the loss's slope by each logit."""
    vectors, (word_bucket, char_bucket, owner, count) = _inputs(model, words)
    x, mask, word = _gather(_project(model, vectors), ids, start, size)
    logit, tape = _forward(model, x, mask, True)
    gradient, dx = _backward(model, x, mask, tape, slope_of(logit))
    d_projected = np.zeros((len(words) + 1, 2, 3 * HIDDEN), dx.dtype)
    for k in (0, 1):
        np.add.at(d_projected[:, k], word[:, k], dx[:, k])
    d_projected = d_projected[:-1]
    gradient["w"] = np.einsum("wd,wkh->kdh", vectors, d_projected)
    gradient["b"] = d_projected.sum(0)
    d_vectors = np.einsum("wkh,kdh->wd", d_projected, model["w"])
    gradient["words"], gradient["chars"] = np.zeros_like(model["words"]), np.zeros_like(model["chars"])
    np.add.at(gradient["words"], word_bucket, d_vectors[:, :WORD_DIM])
    np.add.at(gradient["chars"], char_bucket, (d_vectors[:, WORD_DIM : WORD_DIM + CHAR_DIM] / count)[owner])
    return gradient


def train(rows: list[tuple[str, int]], seed: int = 11) -> dict:
    """Model from ``(text, label)`` rows. Without two labels to tell apart it only knows their share.

    A text is toxic if any of its windows is: each epoch takes the window of every text that scores highest now (at first
    the one with the most evidence) and, of texts that are not toxic, a random one.
    """
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.0}
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    ids_of = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t, _ in rows]
    vocabulary = list(known) or [""]
    whole, gram, own = hash_words(vocabulary)
    split = np.searchsorted(own, np.arange(len(vocabulary) + 1))
    ev = lambda h: (h >> np.uint64(64 - EVIDENCE_BITS)).astype(np.int64)
    word_bucket, gram_bucket = ev(whole), ev(gram)
    word_sets = (np.unique(word_bucket[ids]) for ids in ids_of)
    char_sets = (np.unique(np.concatenate([gram_bucket[split[i] : split[i + 1]] for i in np.unique(ids)] or [np.zeros(0, np.int64)])) for ids in ids_of)
    size = WORD_DIM + CHAR_DIM + 3
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    model = {"words": draw(1 << WORD_BITS, WORD_DIM) * 0.1, "chars": draw(1 << CHAR_BITS, CHAR_DIM) * 0.1, "word_odds": _log_odds(word_sets, labels), "char_odds": _log_odds(char_sets, labels), "w": draw(2, size, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "u": draw(2, HIDDEN, 3 * HIDDEN), "att": draw(2 * HIDDEN, ATTENTION), "att_v": draw(ATTENTION), "out": draw(2 * HIDDEN), "bias": np.float32(0)}
    trained = ("words", "chars", "w", "b", "u", "att", "att_v", "out", "bias")
    moments, step = {k: [np.zeros_like(model[k]), np.zeros_like(model[k])] for k in trained}, 0
    ids, lengths = np.concatenate(ids_of), np.array([len(t) for t in ids_of])
    doc, start, width = _windows(lengths)
    start = start + (np.cumsum(lengths) - lengths)[doc]
    inputs, _ = _inputs(model, vocabulary)
    evidence = np.concatenate([[0], np.cumsum(np.maximum(inputs[:, -3], inputs[:, -2])[ids] ** 3 if len(ids) else [])])
    current = evidence[start + np.minimum(width, len(ids) - start)] - evidence[start]
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    for epoch in range(EPOCHS):
        if epoch:
            current = score_windows(model, _project(model, _inputs(model, vocabulary)[0]), ids, start, width)
        order = np.lexsort((-current, doc))
        top = order[np.searchsorted(doc[order], np.arange(len(rows)))]
        harmless = np.flatnonzero(labels[doc] == 0)
        chosen = np.concatenate([top, rng.choice(harmless, min(len(harmless), int((labels == 0).sum())), replace=False)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            pick = chosen[at : at + BATCH]
            y = labels[doc[pick]].astype(np.float32)
            cut_ids = np.concatenate([ids[s : s + w] for s, w in zip(start[pick], width[pick])])
            used, local = np.unique(cut_ids if len(cut_ids) else np.zeros(1, np.int64), return_inverse=True)
            weight = (1 / share[labels[doc[pick]]] / (2 * len(pick))).astype(np.float32)
            slope_of = lambda logit: ((_sigmoid(logit) - y) * weight).astype(np.float32)  # noqa: B023, E731
            gradient = _gradients(model, [vocabulary[i] for i in used], local, np.cumsum(width[pick]) - width[pick], width[pick], slope_of)
            step += 1
            rate = STEP * (1 - 0.8 * epoch / EPOCHS)
            for k in trained:
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * gradient[k]
                m[1] = 0.99 * m[1] + 0.01 * gradient[k] ** 2
                model[k] = (model[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


class Scorer:
    """Scores texts and keeps the input projections of the words it has seen."""

    def __init__(self, model: dict) -> None:
        self.model, self.known = model, {}
        self.projected = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if "share" in self.model:
            return np.full(len(texts), self.model["share"])
        found = [words_of(t) for t in texts]
        if len(self.known) > CACHE:
            self.known, self.projected = {}, None
        known = self.known
        new = list(set().union(*found).difference(known))
        if new or self.projected is None:
            fresh = _project(self.model, _inputs(self.model, new or [""])[0])
            first = 0 if self.projected is None else len(self.projected) - 1
            self.projected = fresh if self.projected is None else np.concatenate([self.projected[:-1], fresh])
            known.update(zip(new, range(first, first + len(new))))
        lengths = np.array([len(ws) for ws in found])
        ids = np.array(list(map(known.__getitem__, chain.from_iterable(found))), np.int64)
        doc, start, width = _windows(lengths)
        logit = score_windows(self.model, self.projected, ids, start + (np.cumsum(lengths) - lengths)[doc], np.maximum(width, 1) if not len(ids) else width)
        return _sigmoid(np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(texts)))).astype(np.float64))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> list[tuple[str, int]]:
    """A bounded sample with both labels, in an order that only the rows decide; none of the held-out fold."""
    usable = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("t"))
    usable = usable.filter(F.col("t").isNotNull() & ~held_out(F.col("_id")) & (F.octet_length("t") <= SAMPLE_BYTES))
    named = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).groupBy("_id").agg(F.max("y").alias("y"))
    named = named.withColumn("h", F.shiftrightunsigned(F.xxhash64("_id"), 1))
    count = named.groupBy("y").agg(F.count("*").alias("n"))  # two rows
    named = named.join(F.broadcast(count), "y").filter(among_least("h", "n", 2 * SAMPLE_ROWS)).drop("n")
    rows = usable.join(F.broadcast(named), "_id")  # about 16 SAMPLE_ROWS labels, however many there are
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "_id", "t"))).filter(F.col("r") <= SAMPLE_ROWS)
    return sorted((r["t"], r["y"]) for r in best.select("t", "y").collect())


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """All columns of ``docs`` but its text, with ``held_out``, ``score`` and ``predicted``.

    The network learns from a bounded sample of labelled rows outside the held-out fold (a row with two labels counts as
    toxic); its size is bounded by the parameters above. Then all overlapping windows of every whole text are scored; a
    text's score is that of its worst window. Null and empty texts and those without words are one empty window. Without
    rows of both labels the score is the label's share (0 without any). Repeated rows each get a row; an empty table gives
    none; columns named like the added ones are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels, text, doc_id, label)))
    rest = [c for c in docs.columns if c not in (text, "held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts, parts, size = batch.column(0).to_pylist(), [[]], 0
            for t in texts:  # parts of bounded size; a longer text is a part of its own
                if parts[-1] and size + len(t or "") > 2_000_000:
                    parts.append([])
                    size = 0
                parts[-1].append(t)
                size += len(t or "")
            score = np.concatenate([scorer.scores(p) if p else np.zeros(0) for p in parts])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["_row", "score", "predicted"])

    rows = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(packed(rest).alias("row"), held_out(F.col(f"`{doc_id}`")).alias("held_out")).alias("_row"))
    out = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, score double, predicted int")
    return out.select(*unpacked("_row.row", rest), "_row.held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with its columns, whatever their names.

    Null and empty texts are scored as one empty window. Without rows of both labels to learn from, the score is the
    label's share, so that nothing goes unless half of the labelled rows are toxic. Repeated rows are judged alike; an
    empty table gives none.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), packed(docs.columns).alias("row"))
    return toxicity(rows, labels.withColumnRenamed(doc_id, "doc_id")).filter("predicted = 0").select(*unpacked("row", docs.columns))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
